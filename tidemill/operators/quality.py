"""Data quality: rejects, flags, scores, roll-ups and rule tables. All rules of a table share one pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMAIL_IN_TEXT, PATTERNS, holds
from ..spec import DqRules, TableSpec


class Split(NamedTuple):
    passed: DataFrame
    rejected: DataFrame


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _numeric(df: DataFrame, c: str) -> bool:
    return dict(df.dtypes)[c].startswith(_NUMERIC)


def violations(df: DataFrame, rules: DqRules, *, dialect: str = "lenient") -> dict[str, Column]:
    """Rule name -> true where a row breaks it, for the rules whose columns df has.

    lenient: POSITIVE passes nulls and skips columns that are not numeric; ACCEPTED_VALUES ignores case. strict: POSITIVE
    rejects nulls; ACCEPTED_VALUES heeds case and skips numeric and boolean columns. Null passes ACCEPTED_VALUES in both.
    """
    kinds, found = dict(df.dtypes), {}
    for c in dict.fromkeys(rules.not_null):
        if c in kinds:
            found[f"NULL_{c.upper()}"] = F.col(c).isNull()
    for c in rules.positive:
        if c in kinds and dialect == "strict":
            found[f"NON_POSITIVE_{c.upper()}"] = ~F.coalesce(F.col(c) > 0, F.lit(False))
        elif c in kinds and _numeric(df, c):
            found[f"NON_POSITIVE_{c.upper()}"] = F.coalesce(F.col(c) <= 0, F.lit(False))
    for c, values in rules.accepted_values.items():
        if c in kinds and dialect == "strict" and not _numeric(df, c) and kinds[c] != "boolean":
            found[f"INVALID_{c.upper()}"] = F.coalesce(~F.col(c).isin(list(values)), F.lit(False))
        elif c in kinds and dialect != "strict":
            found[f"INVALID_{c.upper()}"] = F.coalesce(~F.lower(F.col(c).cast("string")).isin([str(v).lower() for v in values]), F.lit(False))
    for c, (low, high) in rules.range.items():
        if c in kinds:
            found[f"OUT_OF_RANGE_{c.upper()}"] = F.coalesce(~F.col(c).between(low, high), F.lit(False))
    for c, pattern in rules.format.items():
        if c in kinds:
            found[f"BAD_FORMAT_{c.upper()}"] = F.coalesce(~F.col(c).cast("string").rlike(pattern), F.lit(False))
    return found


def flag(df: DataFrame, rules: DqRules, *, dialect: str = "lenient") -> DataFrame:
    """df with _dq_flags, the names of the rules that a row breaks. No row goes."""
    said = [F.when(broken, F.lit(name)) for name, broken in violations(df, rules, dialect=dialect).items()]
    return df.withColumn("_dq_flags", F.array_compact(F.array(*said)) if said else F.array().cast("array<string>"))


def reject(df: DataFrame, spec: TableSpec, *, dialect: str = "lenient") -> Split:
    """Rows that keep all rules, and the others with _dq_flags. The primary key must not be null."""
    rules = spec.dq_rules
    rules = DqRules(not_null=tuple(dict.fromkeys((*spec.primary_key, *rules.not_null))), positive=rules.positive, accepted_values=rules.accepted_values, range=rules.range, format=rules.format)
    flagged = flag(df, rules, dialect=dialect)
    return Split(flagged.filter(F.size("_dq_flags") == 0).drop("_dq_flags"), flagged.filter(F.size("_dq_flags") > 0))


def reject_summary(df: DataFrame, rules: DqRules, *, dialect: str = "lenient", warn_share: float = 0.5) -> DataFrame:
    """rule, rejected, total, warn: one row per rule, from one aggregation."""
    found = violations(df, rules, dialect=dialect)
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(broken).alias(name) for name, broken in found.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("rejected")) for name in found]))
    return counts.select("total", rows.alias("r")).select("r.rule", "r.rejected", "total", (F.col("r.rejected") > warn_share * F.col("total")).alias("warn"))


def flag_report(flagged: DataFrame) -> DataFrame:
    """flag, rows."""
    return flagged.select(F.explode("_dq_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("rows"))


def check_rules(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """column, rule, fail_count, total, passed, error: rules of columns, all in one aggregation.

    rules: column -> {not_null: True, unique: True, accepted_values: [...], pattern: regex, min_value: x, max_value: x,
    positive: True, range: [x, y], format: regex}. A rule set to False is not checked. Comparisons ignore nulls; unique
    counts rows less distinct values, so nulls fail it. An unknown rule, or one on a column that df lacks, is reported.
    """
    counts, errors = [], []
    for c, own in rules.items():
        for name, value in own.items():
            if value is False:
                continue
            x = F.col(c)
            fails = {
                "not_null": lambda: F.count_if(x.isNull()),
                "unique": lambda: F.count("*") - F.countDistinct(x),
                "accepted_values": lambda: F.count_if(~x.cast("string").isin([str(v) for v in value])),
                "pattern": lambda: F.count_if(~x.cast("string").rlike(value)),
                "format": lambda: F.count_if(~x.cast("string").rlike(value)),
                "min_value": lambda: F.count_if(x < value),
                "max_value": lambda: F.count_if(x > value),
                "positive": lambda: F.count_if(x <= 0),
                "range": lambda: F.count_if(~x.between(*value)),
            }
            if c not in df.columns or name not in fails:
                errors.append((c, name, "no such column" if c not in df.columns else "unknown rule"))
            else:
                counts.append((c, name, fails[name]().cast("long")))
    once = df.agg(F.count("*").alias("total"), *[n.alias(f"f{k}") for k, (_, _, n) in enumerate(counts)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"f{k}").alias("fail_count"), F.lit(None).cast("string").alias("error")) for k, (c, r, _) in enumerate(counts)]
    rows += [F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.lit(None).cast("long").alias("fail_count"), F.lit(e).alias("error")) for c, r, e in errors]
    out = once.select("total", F.explode(F.array(*rows)).alias("r")).select("r.*", "total")
    return out.select("column", "rule", "fail_count", "total", (F.col("fail_count") == 0).alias("passed"), "error")


def column_scores(checks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, column, score: 100 less, for each rule, the rounded fail rate times 200, at most 40; 0 at least."""
    loss = F.when(F.col("total") > 0, F.least(F.lit(40.0), F.bround(F.col("fail_count") / F.col("total") * 200))).otherwise(0.0)
    return checks.filter("error IS NULL").groupBy(*by, "column").agg(F.greatest(F.lit(0.0), 100 - F.sum(loss)).alias("score"))


def table_score(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rounded mean of column scores; 100 without any."""
    return scores.groupBy(*by).agg(F.coalesce(F.bround(F.avg("score")), F.lit(100.0)).alias("score"))


def roll_up(scores: DataFrame, elements: DataFrame, applications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(element, element_score, tables), (application, application_score): means of column scores by business element, and
    of the distinct elements of an application. scores: table, column, score; elements: table, column, element;
    applications: table, application."""
    own = scores.join(elements, ["table", "column"])
    by_element = own.groupBy("element").agg(F.bround(F.avg("score")).alias("element_score"), F.array_sort(F.collect_set("table")).alias("tables"))
    pairs = own.join(applications, "table").select("application", "element").distinct()
    by_application = pairs.join(by_element, "element").groupBy("application").agg(F.bround(F.avg("element_score")).alias("application_score"))
    return by_element, by_application


def inherit_rules(fields: DataFrame, term_rules: DataFrame, field_rules: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """table, column, rule, value, origin: rules of each field, its own before those of its term.

    fields: table, column, term, confidence, is_key. Terms count from least_confidence; their `unique` goes to keys only.
    """
    kinds = ("not_null", "positive", "unique", "accepted_values", "range", "format")
    matched = fields.filter(F.col("confidence") >= least_confidence).join(term_rules.filter(F.col("rule").isin(*kinds)), "term")
    theirs = matched.filter("rule <> 'unique' OR is_key").select("table", "column", "rule", F.col("value").alias("term_value"))
    own = field_rules.select("table", "column", "rule", F.col("value").alias("own_value"), F.lit(True).alias("_own"))
    both = own.join(theirs, ["table", "column", "rule"], "full_outer")
    return both.select("table", "column", "rule", F.when(F.col("_own"), F.col("own_value")).otherwise(F.col("term_value")).alias("value"), F.when(F.col("_own"), "field").otherwise("term").alias("origin"))


def contract_rows(fields: DataFrame, inherited: DataFrame) -> DataFrame:
    """table, column, is_pii, rules: fields with a rule or personal data."""
    rules = inherited.groupBy("table", "column").agg(F.array_sort(F.collect_list(F.struct("rule", "value", "origin"))).alias("rules"))
    return fields.select("table", "column", "is_pii").join(rules, ["table", "column"], "left").filter("rules IS NOT NULL OR is_pii")


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key, if not null, parent lacks."""
    known = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("_parent"), "left_anti")


def freshness(df: DataFrame, column: str, as_of, hours: int) -> DataFrame:
    """latest, fresh: whether the newest value is within so many hours of as_of."""
    at = F.max(F.col(column).cast("timestamp"))
    return df.agg(at.alias("latest"), F.coalesce(at >= F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours)), F.lit(False)).alias("fresh"))


def sla_report(checks: DataFrame, targets: dict[str, float], newest: DataFrame | None = None, as_of=None) -> DataFrame:
    """dimension, measured, target, met. completeness, validity and uniqueness in percent of checked values, met from the
    target on; with newest (of freshness) also freshness, in hours behind as_of, met up to the target."""
    kind = F.when(F.col("rule") == "not_null", "completeness").when(F.col("rule") == "unique", "uniqueness").otherwise("validity")
    measured = checks.filter("error IS NULL").groupBy(kind.alias("dimension")).agg(F.round(100 * (1 - F.sum("fail_count") / F.sum("total")), 2).alias("measured"))
    target = F.element_at(F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, float(v))]), F.col("dimension"))
    out = measured.withColumn("target", target).withColumn("met", F.col("measured") >= F.col("target"))
    if newest is None:
        return out
    hours = F.round((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("latest").cast("timestamp"))) / 3600, 2)
    late = newest.select(F.lit("freshness").alias("dimension"), hours.alias("measured"), F.lit(float(targets["freshness"])).alias("target"))
    return out.unionByName(late.withColumn("met", F.coalesce(F.col("measured") <= F.col("target"), F.lit(False))))


def suggest_rules(profile: DataFrame) -> DataFrame:
    """column, rule, value suggested by a profile (operators.profile.profile)."""
    rows = F.array(
        F.when(F.col("null_ratio") < 0.05, F.struct(F.lit("not_null").alias("rule"), F.lit("true").alias("value"))),
        F.when(F.col("is_key"), F.struct(F.lit("unique").alias("rule"), F.lit("true").alias("value"))),
        F.when(F.col("inferred_type").isin("integer", "decimal") & F.col("min_number").isNotNull(), F.struct(F.lit("range").alias("rule"), F.concat_ws("..", "min_number", "max_number").alias("value"))),
        F.when(F.col("pattern").isNotNull(), F.struct(F.lit("pattern").alias("rule"), F.col("pattern").alias("value"))),
        F.when(F.col("is_reference"), F.struct(F.lit("accepted_values").alias("rule"), F.array_join("values", ",").alias("value"))),
    )
    return profile.select("column", F.explode(F.array_compact(rows)).alias("r")).select("column", "r.rule", "r.value")


def governance(df: DataFrame, conditions: list[tuple[str, str, str]]) -> DataFrame:
    """field, severity, violations, total of (field, SQL condition that must hold, severity)."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"v{k}") for k, (_, c, _) in enumerate(conditions)])
    rows = [F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"), F.col(f"v{k}").alias("violations")) for k, (f, _, s) in enumerate(conditions)]
    return counts.select("total", F.explode(F.array(*rows)).alias("r")).select("r.*", "total")


def leaked_columns(product: DataFrame, pii_fields: tuple[str, ...]) -> list[str]:
    """Columns of a product that its sources declare personal."""
    return [c for c in product.columns if c in set(pii_fields)]


def leaked_values(product: DataFrame, share: float = 0.7) -> DataFrame:
    """column, pattern, hits, filled: text columns of which at least `share` of the values look personal, whatever their names."""
    own = [c for c, kind in product.dtypes if kind == "string" and not c.startswith("_")]
    counts = product.agg(*[F.count(c).alias(f"n{k}") for k, c in enumerate(own)], *[F.count_if(holds(F.trim(c), p)).alias(f"h{k}_{n}") for k, c in enumerate(own) for n, p in PATTERNS.items()])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("pattern"), F.col(f"h{k}_{n}").alias("hits"), F.col(f"n{k}").alias("filled")) for k, c in enumerate(own) for n in PATTERNS]
    return counts.select(F.inline(F.array(*rows))).filter(F.col("hits") > 0).filter(F.col("hits") >= share * F.col("filled"))


def flag_free_text(df: DataFrame, columns: tuple[str, ...], pattern: str = EMAIL_IN_TEXT) -> DataFrame:
    """df with _pii_in_text: whether one of the text columns holds what looks personal."""
    return df.withColumn("_pii_in_text", F.greatest(F.lit(False), *[holds(F.col(c), pattern) for c in columns]))


def new_values(df: DataFrame, column: str, accepted: DataFrame) -> DataFrame:
    """column, rows: values of df that accepted (same column name) lacks."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    return counts.join(accepted.select(column).distinct(), column, "left_anti")
