"""Column profiles over all rows: one pass of counts for all columns, one aggregation over (column, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DATE_SHAPES, PATTERNS, holds
from ..sources import scratch

#: Texts that count as null, and how values look by type.
NULL_TEXTS = ("", "null", "none", "na")
INTEGER, DECIMAL, BOOLEAN = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^(?i:true|false|yes|no|y|n)$"


#: Names of columns that hold personal data.
PERSONAL_NAMES = "first_name last_name email phone mobile date_of_birth dob address postcode ssn national_id passport aadhaar pan".split()


def long_form(df: DataFrame, columns: tuple[str, ...] = (), null_texts: tuple[str, ...] = NULL_TEXTS) -> DataFrame:
    """column, value (null where it counts as null), rows: values of all columns as text, counted."""
    named = columns or tuple(df.columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in named]))
    rows = df.select(pairs.alias("p")).select("p.column", "p.value")
    value = F.when(~F.lower(F.trim("value")).isin(*null_texts), F.col("value"))
    return rows.withColumn("value", value).groupBy("column", "value").agg(F.count("*").alias("rows"))


def profile(df: DataFrame, columns: tuple[str, ...] = (), *, null_texts: tuple[str, ...] = NULL_TEXTS, share: float = 0.7, list_up_to: int = 20, over: bool = False) -> DataFrame:
    """One row per column: rows, nulls, distinct_values, null_ratio, distinct_ratio (3 places), inferred_type, pattern,
    min_number, max_number, mean_number, sample (the least value), min_length, max_length, values (all, if at most list_up_to), is_key, is_reference.

    A type or pattern counts if at least `share` of the values (more than that, with over) have its shape: integers (with commas), decimals, booleans,
    dates, in that order, else string. is_key: distinct ratio over 0.95 and under 1 % null; is_reference: 1 to 15 distinct
    values and a ratio under 5 %. Values are first counted by (column, value), so a frequent value is one row after the
    map side, and no column is gathered in one place.
    """
    counted = long_form(df, columns, null_texts)
    v, n = F.col("value"), F.col("rows")
    plain, bare = F.trim("value"), F.regexp_replace(F.trim("value"), ",", "")
    whole, dated = bare.rlike(INTEGER), plain.rlike("|".join(DATE_SHAPES))
    number = F.when(bare.rlike(DECIMAL), bare.try_cast("double"))
    shapes = {"integer": whole, "decimal": bare.rlike(DECIMAL) & ~whole, "boolean": plain.rlike(BOOLEAN), "date": dated}
    has = v.isNotNull()
    sums = counted.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        *[F.coalesce(F.sum(F.when(shape, n)), F.lit(0)).alias(f"_t_{k}") for k, shape in shapes.items()],
        *[F.coalesce(F.sum(F.when(plain.rlike(p), n)), F.lit(0)).alias(f"_p_{k}") for k, p in PATTERNS.items()],
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        F.round(F.sum(number * n) / F.sum(F.when(number.isNotNull(), n)), 3).alias("mean_number"),
        F.min("value").alias("sample"),
        F.min(F.char_length("value")).alias("min_length"),
        F.max(F.char_length("value")).alias("max_length"),
    )
    few = counted.filter(has).join(sums.filter(F.col("distinct_values") <= list_up_to).select("column"), "column")
    lists = few.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("values"))
    full = F.col("rows") - F.col("nulls")
    enough = lambda n: n > share * full if over else n >= share * full
    kind = F.lit("string")
    for k in reversed(list(shapes)):
        kind = F.when((full > 0) & enough(F.col(f"_t_{k}")), k).otherwise(kind)
    best = F.array_max(F.array_compact(F.array(*[F.when((full > 0) & enough(F.col(f"_p_{k}")), F.struct((F.col(f"_p_{k}") / full).alias("share"), F.lit(k).alias("name"))) for k in PATTERNS])))
    ratio = F.when(full > 0, F.col("distinct_values") / full).otherwise(0.0)
    null_ratio = F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(0.0)
    out = sums.join(lists, "column", "left")
    return out.select(
        "column",
        "rows",
        "nulls",
        "distinct_values",
        F.round(null_ratio, 3).alias("null_ratio"),
        F.round(ratio, 3).alias("distinct_ratio"),
        kind.alias("inferred_type"),
        best["name"].alias("pattern"),
        "min_number",
        "max_number",
        "mean_number",
        "sample",
        "min_length",
        "max_length",
        "values",
        ((ratio > 0.95) & (null_ratio < 0.01)).alias("is_key"),
        (F.col("distinct_values").between(1, 15) & (ratio < 0.05)).alias("is_reference"),
        F.when(full > 0, F.round(F.col("_p_email") / full, 4)).otherwise(0.0).alias("email_share"),
    )


def trigger_profile(df: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """The variant of the loading trigger: `na` is a value, at most 10 values are listed, shares must exceed their limits,
    and is_pii says that a column is named like personal data or that over half its values are e-mail addresses."""
    out = profile(df, columns, null_texts=("", "null", "none"), list_up_to=10, over=True)
    return out.withColumn("is_pii", F.lower("column").isin(*PERSONAL_NAMES) | (F.col("email_share") > 0.5))


def without_values(profiled: DataFrame) -> DataFrame:
    """A profile that shows no values but those of reference columns."""
    return profiled.withColumn("values", F.when(F.col("is_reference"), F.col("values"))).drop("min_number", "max_number")


def top_values(df: DataFrame, columns: tuple[str, ...] = (), n: int = 5) -> DataFrame:
    """column, value, rows, rank: the n most frequent values of each column, ties by value."""
    order = Window.partitionBy("column").orderBy(F.desc("rows"), "value")
    return long_form(df, columns).filter("value IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def exact_quantiles(df: DataFrame, column: str, by: tuple[str, ...] = (), shares: tuple[float, ...] = (0.25, 0.5, 0.75), *, cells: int = 1024, few: int = 10_000) -> DataFrame:
    """by, q (an array): exact quantiles of each group, linear between neighbours, for all groups at once.

    A pass counts a group's values by cells between its least and greatest; only the cells that hold the wanted ranks are
    cut again, until each has one value or at most `few`, which alone are ranked. So no group's values meet in one place,
    and a value that repeats is one row of counts. NaN and null are left out; a group without numbers has no row.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    v = df.select(*[F.coalesce(F.struct(F.col(c)), F.struct(F.lit(None).cast(dict(df.dtypes)[c]).alias(c))).alias(k) for k, c in zip(keys, by)], F.col(column).cast("double").alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    group = [*keys, "_one"]
    v = v.withColumn("_one", F.lit(0))
    stats = v.groupBy(*group).agg(F.count("*").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(q) * (F.col("n") - 1)), F.ceil(F.lit(q) * (F.col("n") - 1))) for q in shares])))
    targets = scratch.materialize(stats.select(*group, "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.explode(wanted).alias("rank")), "ranks")
    for _ in range(64):
        open_ = targets.filter((F.col("low") < F.col("high")) & (F.col("inside") > few))
        cut = open_.select(*group, "low", "high", "below").distinct()
        if cut.isEmpty():
            break
        share = (F.col("_x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves do not overflow
        place = F.least(F.floor(share * cells), F.lit(cells - 1)).alias("_cell")
        counted = v.join(cut, group).filter("_x >= low AND _x <= high").groupBy(*group, "low", "high", "below", place).agg(F.count("*").alias("c"), F.min("_x").alias("cl"), F.max("_x").alias("ch"))
        before = Window.partitionBy(*group, "low").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # `cells` rows at most
        counted = counted.withColumn("cb", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        own = open_.drop("below", "inside").join(counted.drop("below"), [*group, "low", "high"]).filter("rank >= cb AND rank < cb + c")
        done = targets.filter((F.col("low") >= F.col("high")) | (F.col("inside") <= few))
        targets = scratch.materialize(done.unionByName(own.select(*group, F.col("cl").alias("low"), F.col("ch").alias("high"), F.col("cb").alias("below"), F.col("c").alias("inside"), "rank")), "ranks")
    flat = targets.filter("low = high").select(*group, "rank", F.col("low").alias("_x"))
    last = targets.filter("low < high").select(*group, "low", "high", "below").distinct()
    ranked = v.join(last, group).filter("_x >= low AND _x <= high").withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy(*group, "low").orderBy("_x")) - 1)
    found = flat.unionByName(ranked.select(*group, "rank", "_x").join(targets.filter("low < high").select(*group, "rank"), [*group, "rank"], "left_semi"))
    values = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_x"))).alias("m"))  # two ranks a share
    rows = values.join(stats.select(*group, "n"), group)

    def at(q: float) -> F.Column:
        place = F.lit(q) * (F.col("n") - 1)
        low, high = F.element_at("m", F.floor(place)), F.element_at("m", F.ceil(place))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise(low + (high - low) * (place - F.floor(place)))

    return rows.select(*[F.col(f"{k}.{c}").alias(c) for k, c in zip(keys, by)], F.array(*[at(q) for q in shares]).alias("q"))


def quantiles(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quartiles, mean and sample deviation."""
    q = exact_quantiles(df, column, by).select(*by, *[F.col("q")[k].alias(n) for k, n in enumerate(("q25", "q50", "q75"))])
    rest = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    if not by:
        return rest.join(q, how="left").select("q25", "q50", "q75", "mean", "std")
    own, same = rest.alias("r"), [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    return own.join(q.alias("q"), same, "left").select(*[F.col(f"r.{c}") for c in by], "q25", "q50", "q75", "mean", "std")


#: HLL sketches of 2 ** 12 cells: a relative error of 1.04 / 2 ** 6, about 1.6 %; KLL sketches of k 200: ranks within about 1.7 %.
HLL_BITS, KLL_K = 12, 200


def sketches(df: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """column, rows, filled, distinct_sketch, rank_sketch (of numbers, else null): a row for each column, to be stored with a batch.

    One aggregation over the rows as they are. Sketches of batches merge (merged_sketches), so a table's profile needs no
    second reading of the batches before.
    """
    kinds, named = dict(df.dtypes), columns or tuple(df.columns)
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(named):
        numeric = kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
        ranks = F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)) if numeric else F.lit(None).cast("binary")
        aggs += [F.count(c).alias(f"_n{i}"), F.hll_sketch_agg(F.col(c).cast("string"), HLL_BITS).alias(f"_d{i}"), ranks.alias(f"_r{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("filled"), F.col(f"_d{i}").alias("distinct_sketch"), F.col(f"_r{i}").alias("rank_sketch")) for i, c in enumerate(named)])
    return df.agg(*aggs).select(F.inline(rows))


def merged_sketches(stored: DataFrame) -> DataFrame:
    """Sketches of the same columns of several batches as one row a column."""
    return stored.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.when(F.count("rank_sketch") > 0, F.kll_merge_agg_double("rank_sketch")).alias("rank_sketch"))


def estimates(merged: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column, rows, filled, distinct_values (estimated), q (estimated quantiles of numbers)."""
    q = F.when(F.col("rank_sketch").isNotNull(), F.array(*[F.kll_sketch_get_quantile_double("rank_sketch", F.lit(s)) for s in shares]))
    return merged.select("column", "rows", "filled", F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"), q.alias("q"))


def fingerprint_codes(df: DataFrame, codes: DataFrame, columns: tuple[str, ...] = (), least: float = 0.3) -> DataFrame:
    """column, code_set, score, unmatched (up to 5): the code set that holds most of a column's distinct lower-case values.

    codes: code_set, value.
    """
    values = long_form(df, columns).filter("value IS NOT NULL").select("column", F.lower(F.trim("value")).alias("value")).distinct()
    sizes = values.groupBy("column").agg(F.count("*").alias("n"))
    own = codes.select("code_set", F.lower(F.trim("value")).alias("value")).distinct()
    hits = values.join(own, "value").groupBy("column", "code_set").agg(F.count("*").alias("hits"))
    scored = hits.join(sizes, "column").withColumn("score", F.round(F.col("hits") / F.col("n"), 3)).filter(F.col("score") >= least)
    best = Window.partitionBy("column").orderBy(F.desc("score"), "code_set")
    chosen = scored.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("column", "code_set", "score")
    rest = values.join(chosen.select("column", "code_set"), "column").join(own, ["code_set", "value"], "left_anti")
    order = Window.partitionBy("column").orderBy("value")
    few = rest.withColumn("_r", F.row_number().over(order)).filter("_r <= 5").groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("unmatched"))
    return chosen.join(few, "column", "left")


def pattern_shares(df: DataFrame, column: str, by: tuple[str, ...], patterns: dict[str, str]) -> DataFrame:
    """by, rows, and for each pattern how many rows hold it (name) and their share (name_share, 4 places)."""
    counts = df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(holds(F.col(column), p)).alias(n) for n, p in patterns.items()])
    return counts.select(*by, "rows", *[x for n in patterns for x in (n, F.round(F.col(n) / F.col("rows"), 4).alias(f"{n}_share"))])


def is_cdc(df: DataFrame) -> bool:
    return "_cdc_operation" in df.columns
