"""Matching of fields to terms, by name and by evidence. Fields, terms, synonyms and rules are rows, so an estate of any
size is a few joins by key: names that hold one another meet by their n-grams.
"""

from __future__ import annotations

import csv
from functools import partial
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weights of the signals.
WEIGHTS = {"keyword": 0.30, "pattern": 0.25, "fingerprint": 0.25, "stat": 0.20}


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")


def _grams(text: Column) -> Column:
    """Distinct one-, two- and three-character strings of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))
    whole = lambda n: F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))), lambda g: F.char_length(g) == n)
    return F.array_distinct(F.concat(whole(1), whole(2), whole(3)))


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner_text, outer_text: each distinct text of inner (inner_text) with the texts of outer (outer_text) that contain it.

    Outer texts are posted under their n-grams; an inner text looks itself up under the one of its own trigrams (of its
    whole, if it is shorter) that fewest outer texts have, so candidates come by an equi join and are then checked. Empty
    and null texts meet nothing.
    """
    i, o = inner.select("inner_text").filter("inner_text <> ''").distinct(), outer.select("outer_text").filter("outer_text <> ''").distinct()
    posted = o.select("outer_text", F.explode(_grams(F.col("outer_text"))).alias("gram"))
    common = posted.groupBy("gram").agg(F.count("*").alias("_texts"))
    own = i.select("inner_text", F.explode(F.filter(_grams(F.col("inner_text")), lambda g: F.char_length(g) == F.least(F.char_length("inner_text"), F.lit(3)))).alias("gram"))
    asked = own.join(common, "gram", "left").groupBy("inner_text").agg(F.min_by("gram", F.struct(F.coalesce("_texts", F.lit(0)), "gram")).alias("gram"))
    return asked.join(posted, "gram").filter(F.contains("outer_text", "inner_text")).select("inner_text", "outer_text")


def keyword_scores(fields: DataFrame, synonyms: DataFrame) -> DataFrame:
    """fields' columns, term, keyword: 1 for an equal name, else the best ratio of lengths where one holds the other.

    fields: table, column (and further ones, which are kept); synonyms: term, synonym. Both may be of any size: names meet
    by n-grams (containing), in either direction.
    """
    f = fields.withColumn("_f", _plain(F.col("column")))
    s = synonyms.select("term", _plain(F.col("synonym")).alias("_s")).distinct()
    inside = containing(s.select(F.col("_s").alias("inner_text")), f.select(F.col("_f").alias("outer_text"))).select(F.col("inner_text").alias("_s"), F.col("outer_text").alias("_f"))
    around = containing(f.select(F.col("_f").alias("inner_text")), s.select(F.col("_s").alias("outer_text"))).select(F.col("outer_text").alias("_s"), F.col("inner_text").alias("_f"))
    pairs = inside.unionByName(around).distinct()
    short, long_ = F.least(F.char_length("_f"), F.char_length("_s")), F.greatest(F.char_length("_f"), F.char_length("_s"))
    scored = pairs.withColumn("_score", F.when(F.col("_f") == F.col("_s"), 1.0).otherwise(F.round(short / long_, 3)))
    best = scored.join(s, "_s").groupBy("_f", "term").agg(F.max("_score").alias("keyword"))
    return f.join(best, "_f").select(*fields.columns, "term", "keyword")


def synonym_matches(fields: DataFrame, synonyms: DataFrame, top: int = 3) -> DataFrame:
    """fields' columns, term, score, rank: 0.95 for an equal name, else, where one name holds the other, 0.9 times the share of
    name parts in common (2 places), from a half. Only names with a part in common meet."""
    parts = lambda c: F.array_distinct(F.filter(F.split(_plain(F.col(c)), "_"), lambda p: p != ""))
    f = fields.select(*fields.columns, parts("column").alias("fp"), F.explode(parts("column")).alias("part"))
    s = synonyms.select("term", "synonym", parts("synonym").alias("sp"), F.explode(parts("synonym")).alias("part"))
    pairs = f.join(s, "part").select(*fields.columns, "fp", "term", "synonym", "sp").distinct()
    share = F.size(F.array_intersect("fp", "sp")) / F.greatest(F.size("fp"), F.size("sp"))
    name, synonym = _plain(F.col("column")), _plain(F.col("synonym"))
    holds = name.contains(synonym) | synonym.contains(name)
    score = F.when(name == synonym, 0.95).when(holds & (share >= 0.5), F.round(0.9 * share, 2))
    best = pairs.withColumn("score", score).filter("score IS NOT NULL").groupBy(*fields.columns, "term").agg(F.max("score").alias("score"))
    order = Window.partitionBy("table", "column").orderBy(F.desc("score"), "term")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def stat_scores(profiled: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (table, column, term) with stat: type 0.5, range with a fifth of slack 0.3, key 0.2, reference 0.3; 1 at most.

    terms: term, expected_type, min_value, max_value, is_key, is_reference.
    """
    t = terms.select("term", "expected_type", "min_value", "max_value", F.col("is_key").alias("t_key"), F.col("is_reference").alias("t_ref"))
    rows = pairs.join(profiled, ["table", "column"]).join(t, "term")
    inside = (F.col("min_number") >= F.col("min_value") * 0.8) & (F.col("max_number") <= F.col("max_value") * 1.2)
    points = [(F.col("inferred_type") == F.col("expected_type"), 0.5), (inside, 0.3), (F.col("is_key") & F.col("t_key"), 0.2), (F.col("is_reference") & F.col("t_ref"), 0.3)]
    total = sum((F.when(c, p).otherwise(0.0) for c, p in points), F.lit(0.0))
    return rows.select("table", "column", "term", F.least(F.lit(1.0), F.round(total, 3)).alias("stat"))


def composite(signals: DataFrame) -> DataFrame:
    """signals (keyword, fingerprint, stat: numbers; pattern: a name) with score, 3 places. Any pattern counts 0.9."""
    pattern = F.when(F.col("pattern").isNotNull(), 0.9).otherwise(0.0)
    parts = {"keyword": F.coalesce("keyword", F.lit(0.0)), "pattern": pattern, "fingerprint": F.coalesce("fingerprint", F.lit(0.0)), "stat": F.coalesce("stat", F.lit(0.0))}
    return signals.withColumn("score", F.round(sum((w * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0)), 3))


def best_match(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("table", "column").orderBy(F.desc("score"), "term")
    return scored.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def information_type(profiled: DataFrame, term_type: Column | None = None) -> DataFrame:
    numeric = F.col("inferred_type").isin("integer", "decimal")
    own = F.when(F.col("is_key"), "Identifier").when(numeric & (F.col("distinct_ratio") > 0.3), "Measure").when(F.col("inferred_type") == "date", "Temporal").when(F.col("is_reference"), "Reference").otherwise("Dimension")
    return profiled.withColumn("information_type", F.coalesce(term_type, own) if term_type is not None else own)


RULES = "rule_type string, rule string, pattern string, value string, confidence double, is_key boolean, suggests string"
#: The rules that come with the library.
OWN_RULES = Path(__file__).resolve().parents[1] / "config" / "name_rules.csv"


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Rules as rows of RULES, from a CSV file with a header (# begins a comment): those at path, or the library's own."""
    if path is not None:
        return spark.read.schema(RULES).csv(path, header=True, comment="#")
    lines = [x for x in OWN_RULES.read_text().splitlines() if not x.startswith("#")]
    rows = [(*r[:4], float(r[4]), r[5] == "true", r[6] or None) for r in list(csv.reader(lines))[1:]]
    return spark.createDataFrame(rows, RULES)


def name_rules(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """fields' columns less data_type, rule_type, rule, value, confidence, is_key, suggests (an array): what rules say of fields.

    fields: table, column, data_type (and further ones, which are kept). A pattern's * becomes a key to join by: *_x the
    last part of a name, x* its beginning, *x* a text inside it (containing), a plain name itself or a type. naming rules
    of one group count once for a field; of pii levels the one with the highest confidence counts; {stem} and {name} in a
    value are the field's name without its ending and with it.
    """
    named = fields.withColumns({"_name": F.lower("column"), "_type": F.regexp_extract(F.lower("data_type"), r"^\w+", 0)})
    p, core = F.col("pattern"), F.regexp_replace("pattern", r"[*]", "")
    starred, ending = p.startswith("*"), p.endswith("*")
    how = F.when(F.col("rule_type") == "type", "type").when(starred & ending, "inside").when((F.col("rule_type") == "naming") & p.startswith("*_"), "part").when(starred, "end").when(ending, "begin").otherwise("name")
    r = rules.withColumns({"_how": how, "_key": F.lower(F.when(how == "part", F.substring(core, 2, 1000)).otherwise(core))})
    names = named.select("_name", "_type").distinct()
    parts = lambda n, c: F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substring(c, F.lit(1) if n == "begin" else i, i if n == "begin" else F.lit(1000)))
    key = lambda n, x: F.struct(F.lit(n).alias("_how"), x.alias("_key"))
    keys = F.array(key("type", F.col("_type")), key("name", F.col("_name")), key("part", F.element_at(F.split("_name", "_"), -1)))
    edges = F.flatten(F.array(*[F.transform(parts(n, F.col("_name")), partial(key, n)) for n in ("begin", "end")]))
    posted = names.select("_name", "_type", F.inline(F.concat(keys, edges)))
    met = posted.join(r, ["_how", "_key"])
    inside = r.filter("_how = 'inside'")
    held = containing(inside.select(F.col("_key").alias("inner_text")), names.select(F.col("_name").alias("outer_text")))
    by_text = held.select(F.col("inner_text").alias("_key"), F.col("outer_text").alias("_name")).join(names, "_name").join(inside, "_key")
    all_ = met.unionByName(by_text)
    group = F.when(F.col("rule_type") == "pii", "").otherwise(F.col("rule"))
    best = all_.groupBy("_name", "_type", "rule_type", group.alias("_group")).agg(F.max_by(F.struct("rule", "value", "confidence", "is_key", "suggests"), F.struct("confidence", "pattern")).alias("s")).select("_name", "_type", "rule_type", "s.*")
    stem = F.regexp_replace("_name", "_id", "")
    value = F.replace(F.replace("value", F.lit("{stem}"), stem), F.lit("{name}"), F.col("_name"))
    told = best.withColumns({"value": value, "suggests": F.when(F.col("suggests").isNotNull(), F.split("suggests", " ")).otherwise(F.array().cast("array<string>"))})
    kept = [c for c in fields.columns if c != "data_type"]
    return named.join(told, ["_name", "_type"]).select(*kept, "rule_type", "rule", "value", "confidence", "is_key", "suggests")


def application_matches(datasets: DataFrame, applications: DataFrame, top: int = 3) -> DataFrame:
    """table, application, hits, rank. datasets: table, words (array); applications: application, keywords (array)."""
    d = datasets.select("table", F.explode(F.array_distinct(F.transform("words", lambda w: F.lower(w)))).alias("word"))
    a = applications.select("application", F.explode(F.array_distinct(F.transform("keywords", lambda w: F.lower(w)))).alias("word"))
    hits = d.join(a, "word").groupBy("table", "application").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("table").orderBy(F.desc("hits"), "application")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def primary_key(profiled: DataFrame) -> DataFrame:
    """table, primary_key, measured_unique: an _id field named like its table first, then one not of customers, then any candidate."""
    name, stem = F.lower("column"), F.regexp_replace(F.lower("table"), "s$", "")
    ends = name.endswith("_id")
    rank = F.when(ends & (stem.contains(F.regexp_replace(name, "_id$", "")) | name.contains(stem)), 0).when(ends & ~name.contains("customer"), 1).when(F.col("is_key"), 2)
    order = Window.partitionBy("table").orderBy("_rank", F.desc("is_key"), "column")
    return profiled.withColumn("_rank", rank).filter("_rank IS NOT NULL").withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("table", F.col("column").alias("primary_key"), F.col("is_key").alias("measured_unique"))


def foreign_keys(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """table, column, parent_table: fields named as another table's primary key. keys: table, primary_key."""
    k = keys.select(F.col("table").alias("parent_table"), F.col("primary_key").alias("column"))
    return fields.join(k, "column").filter(F.col("table") != F.col("parent_table")).select("table", "column", "parent_table")


def containment(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """values, contained, ratio: how many of the child's distinct keys the parent has."""
    c = child.select(F.col(child_key).alias("k")).filter("k IS NOT NULL").distinct()
    p = parent.select(F.col(parent_key).alias("k")).distinct().withColumn("_in", F.lit(True))
    return c.join(p, "k", "left").agg(F.count("*").alias("values"), F.count("_in").alias("contained")).withColumn("ratio", F.when(F.col("values") > 0, F.round(F.col("contained") / F.col("values"), 4)))


def contradictions(matches: DataFrame, profiled: DataFrame, terms: DataFrame) -> DataFrame:
    """matches with linked: false where the term expects a type or pattern that the data lacks. terms: term, expected_type, expected_pattern."""
    rows = matches.join(profiled.select("table", "column", "inferred_type", "pattern"), ["table", "column"], "left").join(terms, "term", "left")
    wrong = (F.col("expected_type") != F.col("inferred_type")) | (F.col("expected_pattern").isNotNull() & ~F.col("expected_pattern").eqNullSafe(F.col("pattern")))
    return rows.select(*matches.columns, (~F.coalesce(wrong, F.lit(False))).alias("linked"))


def with_evidence(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """matches with is_pii, is_key, accepted_from and confidence raised by at most 0.1, to 0.99 at most.

    evidence: table, column, pattern, is_key, code_set, fingerprint.
    """
    e = evidence.select("table", "column", "pattern", F.col("is_key").alias("_key"), "code_set", "fingerprint")
    rows = matches.join(e, ["table", "column"], "left")
    boost = F.when(F.col("pattern").isNotNull(), 0.05).otherwise(0.0) + F.when(F.coalesce("fingerprint", F.lit(0.0)) >= 0.5, 0.05).otherwise(0.0)
    return rows.select(
        *[c for c in matches.columns if c != "confidence"],
        F.coalesce(F.col("pattern").isin("pan", "aadhaar", "email", "phone", "credit_card"), F.lit(False)).alias("is_pii"),
        F.coalesce("_key", F.lit(False)).alias("is_key"),
        F.when(F.col("fingerprint") >= 0.5, F.col("code_set")).alias("accepted_from"),
        F.least(F.lit(0.99), F.round(F.col("confidence") + boost, 3)).alias("confidence"),
    )
