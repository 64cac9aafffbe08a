from datetime import datetime

import numpy as np
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, IntegerType, LongType, StringType, StructField, StructType

from tidemill.functions import text, vectors
from tidemill.operators import cdc, dedup, late, match, monitor, profile, quality, schema
from tidemill.spec import DqRules, TableSpec, load_specs

AT = datetime(2024, 3, 10)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_hash_tells_null_places_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|b", None, None)], "x string, y string, z string")
    assert len({r.row_hash for r in dedup.with_row_hash(df).collect()}) == 3
    assert len({r.row_hash for r in dedup.with_row_hash(df, null_token=None).collect()}) == 2
    odd = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a\\", "|b"), ("a\\|", "b"), (None, "b"), ("\\N", "b"), ("\x00null", "b")], "x string, y string")
    assert len({r.row_hash for r in dedup.with_row_hash(odd).collect()}) == 7


def test_latest_is_total_and_skips_missing_order(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (2, None, "c")], "k long, t long, v string")
    assert rows(dedup.latest(df, ("k",), "t DESC")) == [(1, 5, "b"), (2, None, "c")]
    assert rows(dedup.latest(df, ("k",), "t ASC, v DESC")) == [(1, 5, "b"), (2, None, "c")]
    assert dedup.latest(df, ("k",), "nope DESC").count() == 4
    assert dedup.latest(df.limit(0), ("k",), "t DESC").count() == 0


def test_cdc_insert_update_delete_in_one_batch(spark):
    b = spark.createDataFrame([("INSERT", 1, 1, "a", 1.0), ("UPDATE", 1, 2, None, 2.0), ("DELETE", 1, 3, None, None), ("INSERT", 1, 4, "n", None), ("UPDATE", 1, 5, None, None), ("UPDATE", 9, 1, "q", None)], "_cdc_operation string, k long, t long, a string, b double")
    got = rows(cdc.rebuild(b, None, ("k",), "t").select("k", "t", "a", "b"), "k", "t")
    assert got == [(1, 1, "a", 1.0), (1, 2, "a", 2.0), (1, 3, None, None), (1, 4, "n", None), (1, 5, "n", None), (9, 1, "q", None)]
    old = spark.createDataFrame([("INSERT", 9, 0, "o", 7.0)], b.schema)
    assert rows(cdc.rebuild(b.filter("k = 9"), old, ("k",), "t").select("a", "b")) == [("q", 7.0)]
    assert cdc.without_deletes(b).count() == 5


def test_quality_dialects_flags_and_split(spark):
    df = spark.createDataFrame([(1, 5.0, "Web"), (2, 0.0, "web"), (3, None, "x"), (None, -1.0, None)], "k long, amount double, channel string")
    rules = DqRules(positive=("amount",), accepted_values={"channel": ["Web"], "amount": ["5.0"]})
    spec = TableSpec("t", ("k",), dq_rules=DqRules(positive=("amount",), accepted_values={"channel": ["Web"]}))
    lenient, strict = quality.reject(df, spec), quality.reject(df, spec, dialect="strict")
    assert rows(lenient.passed.select("k")) == [(1,)] and rows(strict.passed.select("k")) == [(1,)]
    assert lenient.passed.count() + lenient.rejected.count() == 4
    flags = {r.k: r._dq_flags for r in quality.flag(df, spec.dq_rules).collect()}
    assert flags[1] == [] and flags[2] == ["NON_POSITIVE_AMOUNT"] and flags[3] == ["INVALID_CHANNEL"]
    assert "NON_POSITIVE_AMOUNT" in {r.k: r._dq_flags for r in quality.flag(df, spec.dq_rules, dialect="strict").collect()}[3]
    assert "INVALID_AMOUNT" in quality.violations(df, rules) and "INVALID_AMOUNT" not in quality.violations(df, rules, dialect="strict")
    assert {r.rule: r.rejected for r in quality.reject_summary(df, spec.dq_rules).collect()} == {"NON_POSITIVE_AMOUNT": 2, "INVALID_CHANNEL": 1}


def test_scores_roll_up_and_unknown_rules(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id")).alias("q"), F.when(F.col("id") < 4, -1).otherwise(1).alias("n"))
    checks = quality.check_rules(df, {"q": {"not_null": True}, "n": {"positive": True, "unique": False, "odd": True}, "id": {"unique": True}, "gone": {"not_null": True}})
    by = {(r.column, r.rule): r for r in checks.collect()}
    assert by["q", "not_null"].fail_count == 10 and by["id", "unique"].passed and ("n", "unique") not in by
    assert by["n", "odd"].error == "unknown rule" and by["gone", "not_null"].error == "no such column"
    scores = {r.column: r.score for r in quality.column_scores(checks).collect()}
    assert scores == {"q": 60.0, "n": 80.0, "id": 100.0}
    s = spark.createDataFrame([("t", "a", 80.0), ("t", "b", 85.0), ("u", "c", 50.0)], "table string, column string, score double")
    e = spark.createDataFrame([("t", "a", "E"), ("t", "b", "E"), ("u", "c", "F")], "table string, column string, element string")
    apps = spark.createDataFrame([("t", "A"), ("u", "A")], "table string, application string")
    elements, applications = quality.roll_up(s, e, apps)
    assert rows(elements.select("element", "element_score")) == [("E", 82.0), ("F", 50.0)]  # half to even
    assert rows(applications) == [("A", 66.0)]


def test_leaks_service_levels_and_table_scores(spark):
    df = spark.createDataFrame([("a@x.org", "n", "1"), ("b@x.org", None, "2"), (None, "m", "3")], "c string, d string, _e string")
    assert [(r.column, r.pattern, r.hits, r.filled) for r in quality.leaked_values(df).collect()] == [("c", "email", 2, 2)]
    assert quality.leaked_values(df.limit(0)).count() == 0
    checks = quality.check_rules(df, {"c": {"not_null": True}})
    newest = quality.freshness(spark.createDataFrame([(datetime(2024, 3, 9),)], "t timestamp"), "t", AT, 48)
    got = {r.dimension: (r.measured, r.met) for r in quality.sla_report(checks, {"completeness": 99, "freshness": 12}, newest, AT).collect()}
    assert got == {"completeness": (66.67, False), "freshness": (24.0, False)}
    assert rows(quality.table_score(quality.column_scores(checks).limit(0))) == [(100.0,)]


def test_contract_is_checked(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (None, "b", 3)], "k long, s string, n long")
    said = schema.Contract("1.0.0", {"k": "bigint", "s": "string", "gone": "date"}, {"n": "int"}, ("k",))
    assert {tuple(r) for r in schema.contract_violations(df, said).collect()} == {("gone", "missing", None), ("n", "type", None), ("k", "null", 1), ("s", "null", 1), ("k", "repeated", 2)}
    assert schema.contract_violations(df.filter("n = 1").drop("n"), schema.Contract("1", {"k": "bigint"}, {"n": "int"}, ("k",))).count() == 0


def test_rule_inheritance_and_contract(spark):
    fields = spark.createDataFrame([("t", "a", "T1", 0.9, True, True), ("t", "b", "T1", 0.9, False, False), ("t", "c", "T1", 0.4, False, True)], "table string, column string, term string, confidence double, is_key boolean, is_pii boolean")
    terms = spark.createDataFrame([("T1", "unique", "true"), ("T1", "not_null", "true"), ("T1", "magic", "x")], "term string, rule string, value string")
    own = spark.createDataFrame([("t", "b", "not_null", None)], "table string, column string, rule string, value string")
    got = rows(quality.inherit_rules(fields, terms, own))
    assert got == [("t", "a", "not_null", "true", "term"), ("t", "a", "unique", "true", "term"), ("t", "b", "not_null", None, "field")]
    assert rows(quality.contract_rows(fields, quality.inherit_rules(fields, terms, own)).select("column")) == [("a",), ("b",), ("c",)]


def test_late_rows(spark):
    df = spark.createDataFrame([("2024-03-03 00:00:00",), ("2024-03-02 23:59:59",), (None,), ("soon",)], "t string")
    split = late.split_late(df, "t", AT, 7)
    assert rows(split.late.select("t")) == [("2024-03-02 23:59:59",)] and split.on_time.count() == 3
    assert late.split_late(df, "t", AT, 7, first_load=True).late.count() == 0


def test_cleaning_and_masking(spark):
    df = spark.createDataFrame([(" a\x07b€ Ж\xa0 ", "joe@x.org", "1234567890", "1990-05-06", None)], "s string, e string, n string, d string, z string")
    out = text.trim_all(text.strip_non_printable(df.select("s")), ("s",)).collect()[0].s
    assert out == "AB \xa0"
    m = text.apply_masking(df, {"e": "email", "n": "last_4", "d": "year_only", "z": "tokenise", "s": "redact"}).collect()[0]
    assert (m.e, m.n, m.d, m.z, m.s) == ("j***@x.org", "******7890", "1990", None, "REDACTED")
    key = F.lit("0123456789abcdef")
    assert df.select(text.decrypt(text.encrypt(F.col("e"), key), key).alias("x")).collect()[0].x == "joe@x.org"
    dates = spark.createDataFrame([("2024-01-02",), ("02/01/2024",), ("02-01-2024",), ("2024-01-02T10:11",), ("x",)], "d string")
    assert [r[0] for r in dates.select(text.to_iso_date(F.col("d"))).collect()] == ["2024-01-02"] * 4 + [None]


def f(name, kind):
    return StructField(name, kind)


def test_schema_changes_and_policies(spark):
    was = StructType([f("a", IntegerType()), f("b", StringType()), f("_x", StringType()), f("d", DecimalType(10, 2))])
    now = StructType([f("a", LongType()), f("c", StringType()), f("d", DecimalType(12, 3))])
    assert {(c.kind, c.column) for c in schema.diff(now, was)} == {("added", "c"), ("retyped", "a"), ("retyped", "d"), ("dropped", "b")}
    said = schema.decide(now, was, schema.SILVER)
    assert not said.violations and said.target["a"].dataType == LongType() and "b" in said.target.names and "c" in said.target.names
    narrow = schema.decide(StructType([f("a", StringType())]), StructType([f("a", BooleanType())]), schema.SILVER)
    assert [c.column for c in narrow.violations] == ["a"]
    assert schema.decide(now, was, schema.Policy.for_classification("pii")).violations
    assert schema.widens("bigint", "string") and schema.widens("int", "decimal(12,2)") and not schema.widens("int", "decimal(10,2)") and not schema.widens("string", "bigint")
    assert schema.widens("decimal(10,2)", "decimal(12,3)") and not schema.widens("decimal(10,2)", "decimal(10,3)") and schema.widens("x", "y", ("x -> y",))
    df = spark.createDataFrame([("7",), ("x",)], "a string")
    aligned = schema.align(df, StructType([f("z", LongType()), f("a", IntegerType())]))
    assert aligned.dtypes == [("z", "bigint"), ("a", "int")] and rows(aligned) == [(None, None), (None, 7)]
    assert rows(schema.values_lost(df, StructType([f("a", IntegerType())]))) == [("a", 1)]
    good, bad, said = schema.evolve(df, StructType([f("a", BooleanType())]), schema.SILVER)
    assert good is None and bad.columns == ["a", "_quarantine_reason", "_schema_diff"]
    audit = schema.audit_rows(spark, said, "t", "silver", "r", AT)
    assert rows(schema.drift_report(audit)) == [("t", 1, 1, "CRITICAL", False)]
    assert schema.fingerprint(was) == schema.fingerprint(StructType(list(reversed(was.fields)))) != schema.fingerprint(now)
    assert [schema.version_bump(was, x) for x in (was, StructType([*was.fields, f("q", LongType())]), now)] == ["patch", "minor", "major"]
    assert schema.apply_aliases(df, {"a": "b", "q": "r"}).columns == ["b"]


def test_profile_boundaries(spark):
    values = ["1,000"] * 7 + ["x"] * 3 + ["NA", "", "null", None]
    df = spark.createDataFrame([(i, v, f"u{i}@x.org") for i, v in enumerate(values)], "id long, v string, e string")
    p = {r.column: r for r in profile.profile(df).collect()}
    assert p["v"].inferred_type == "integer" and p["v"].nulls == 4 and p["v"].distinct_values == 2 and p["v"].values == ["1,000", "x"]
    assert p["e"].pattern == "email" and p["id"].is_key and not p["v"].is_reference
    assert rows(profile.top_values(df, ("v",), 1)) == [("v", "1,000", 7, 1)]
    kinds = spark.createDataFrame([("y", "1.5", "2024-01-02T10:00:00Z"), ("No", "-2e3", "01/02/2024"), ("true", ".5", "01-02-2024")], "b string, f string, d string")
    assert {r.column: r.inferred_type for r in profile.profile(kinds).collect()} == {"b": "boolean", "f": "decimal", "d": "date"}
    none = profile.profile(spark.createDataFrame([(None,)], "x string")).collect()[0]
    assert none.nulls == 1 and none.inferred_type == "string" and not none.is_key
    codes = spark.createDataFrame([("s", "X"), ("s", "y")], "code_set string, value string")
    got = profile.fingerprint_codes(df, codes, ("v",)).collect()[0]
    assert (got.code_set, got.score, got.unmatched) == ("s", 0.5, ["1,000"])
    assert quality.suggest_rules(profile.profile(df)).filter("column = 'e'").count() >= 2


def test_matching(spark, tmp_path):
    fields = spark.createDataFrame([("loans", "customer_pan"), ("loans", "loan_id"), ("loans", "customer_id")], "table string, column string")
    syn = spark.createDataFrame([("PAN", "pan"), ("LOAN", "Loan ID")], "term string, synonym string")
    scores = {(r.column, r.term): r.keyword for r in match.keyword_scores(fields, syn).collect()}
    assert scores["loan_id", "LOAN"] == 1.0 and scores["customer_pan", "PAN"] == 0.25
    best = {(r.column, r.term): r.score for r in match.synonym_matches(fields, syn).collect()}
    assert best["loan_id", "LOAN"] == 0.95 and best["customer_pan", "PAN"] == 0.45 and len(best) == 2
    typed = spark.createDataFrame([("t", "customer_id", "bigint"), ("t", "is_first_name", "boolean"), ("t", "total", "decimal(10,2)"), ("t", "x", "int")], "table string, column string, data_type string")
    told = {(r.column, r.rule_type, r.rule, r.value, r.confidence) for r in match.name_rules(typed, match.load_rules(spark)).collect()}
    assert told == {("customer_id", "naming", "identifiers:end", "Identifier", 0.85), ("customer_id", "fk", "customer_id", "customers.customer_id", 0.8), ("customer_id", "fk", "stem", "customers.customer_id", 0.5), ("is_first_name", "naming", "flags:begin", "Dimension", 0.8), ("is_first_name", "pii", "high_confidence", "PII", 0.9), ("is_first_name", "type", "data_type", "Dimension", 0.7), ("total", "naming", "measures:end", "Measure", 0.85), ("total", "type", "data_type", "Measure", 0.7)}
    keyed = {(r.column, r.is_key, tuple(r.suggests)) for r in match.name_rules(typed, match.load_rules(spark)).filter("rule_type = 'naming'").collect()}
    assert keyed == {("customer_id", True, ("not_null", "unique")), ("is_first_name", False, ("accepted_values",)), ("total", False, ("not_null", "positive"))}
    (tmp_path / "rules.csv").write_text("# own rules\nrule_type,rule,pattern,value,confidence,is_key,suggests\nnaming,own,*_x,X,0.5,false,\npii,some,*tot*,PII,0.6,false,\npii,more,*otal,PII,0.7,true,unique\n")
    own = match.name_rules(typed, match.load_rules(spark, str(tmp_path / "rules.csv"))).collect()
    assert {(r.column, r.rule, r.value, r.confidence, r.is_key) for r in own} == {("x", "own", "X", 0.5, False), ("total", "more", "PII", 0.7, True)}
    prof = fields.withColumn("is_key", F.col("column") == "loan_id")
    assert rows(match.primary_key(prof)) == [("loans", "loan_id", True)]
    keys = spark.createDataFrame([("customers", "customer_id")], "table string, primary_key string")
    assert rows(match.foreign_keys(fields, keys)) == [("loans", "customer_id", "customers")]
    sig = spark.createDataFrame([(1.0, "pan", None, 0.5)], "keyword double, pattern string, fingerprint double, stat double")
    assert match.composite(sig).collect()[0].score == 0.625


def test_monitoring_and_lineage(spark):
    df = dedup.with_row_hash(spark.range(5))
    checks = [monitor.reconcile_counts(df, df), monitor.reconcile_hashes(df, df.filter("id < 3"))]
    log = monitor.reconciliation_log(checks, "r", "t", AT)
    assert rows(monitor.table_status(log)) == [("r", "t", "SUCCESS")]
    assert monitor.missing_hashes(df, df.filter("id < 3")).count() == 2
    assert rows(monitor.content_checksum(df)) == rows(monitor.content_checksum(df.repartition(3)))
    e1 = monitor.lineage_event(spark, "r", "bronze", ["landing.t"], ["bronze.t"], spark.range(1).schema, df.schema, 5, 5, AT)
    e2 = monitor.lineage_event(spark, "r", "silver", ["bronze.t"], ["silver.t"], df.schema, df.schema, 5, 3, datetime(2024, 3, 11))
    said = schema.decide(df.drop("id").schema, df.schema, schema.SILVER)
    facets = monitor.lineage_event(spark, "r", "gold", [], [], df.schema, df.schema, 5, 3, AT, "FAIL", audit=said.audit, checks=quality.check_rules(df, {"id": {"unique": True}})).collect()[0]
    assert [tuple(c) for c in facets.schema_changes] == [("drop", "id", "bigint", None, "graceful_null_fill")] and [tuple(c) for c in facets.quality] == [("id", "unique", 0, 5)]
    assert rows(monitor.audit("r", "s", "v", {"t": ("OK", df, None)}, AT).select("table_name", "source_count", "target_count")) == [("t", 5, 0)]
    history = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "dataset_name string, event_time long")
    assert [r.event_time for r in monitor.dataset_history(history, "a", 1).collect()] == [3]
    nodes, edges = monitor.lineage_graph(e1.unionByName(e2))
    assert edges.count() == 4 and nodes.count() == 5
    assert {r.column: r.path for r in monitor.column_paths(e1.unionByName(e2)).collect()} == {"id": "bronze:IDENTITY > silver:IDENTITY", "row_hash": "bronze:HASH > silver:IDENTITY"}


def test_vectors_and_chunks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "i long, v array<float>")
    got = rows(vectors.top_k_cosine(v.filter("i = 1"), v, id_col="i", vector_col="v", k=2), "rank")
    assert [(g[1], round(g[2], 3)) for g in got] == [(3, 0.707), (2, 0.0)]
    many = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)], "i long, v array<float>")
    whole, parts = (rows(vectors.top_k_cosine(many, many, id_col="i", vector_col="v", k=3, block=b)) for b in (1000, 7))
    assert whole == parts and len(whole) == 180
    t = spark.createDataFrame([(1, "x" * 1600), (2, None), (3, "short"), (4, "")], "doc_id long, text string")
    assert rows(vectors.chunks(t).select("doc_id", "chunk_index", F.length("chunk"))) == [(1, 0, 1500), (1, 1, 300)]
    names = spark.createDataFrame([("Abcabc é",), ("ab",), (None,)], "s string")
    for r in names.select("s", vectors.trigram_vector(F.col("s"), 16).alias("v")).collect():
        low, counts = (r.s or "").lower(), [0] * 16
        for k in range(len(low) - 2):
            h = xxhash.xxh64_intdigest(low[k : k + 3].encode(), 42)
            counts[(h - (1 << 64) if h >> 63 else h) % 16] += 1
        norm = sum(c * c for c in counts) ** 0.5
        assert r.v is None and r.s is None or all(abs(a - (c / norm if norm else 0)) < 1e-6 for a, c in zip(r.v, counts))
    vec = t.select(vectors.trigram_vector(F.col("text")).alias("v")).collect()
    assert abs(sum(x * x for x in vec[0].v) - 1) < 1e-5 and sum(vec[3].v) == 0


def test_specs(tmp_path):
    (tmp_path / "a.json").write_text('{"table": "a", "primary_key": "k", "dq_rules": {"not_null": ["k"]}}')
    (tmp_path / "b.json").write_text('{"table": "b", "primary_key": "k", "dq_rulez": {}}')
    assert list(load_specs(str(tmp_path))) == ["a"]


def test_names_meet_by_grams(spark):
    """200,000 synonyms, no nested loop."""
    names = spark.range(200_000).select(F.concat(F.lit("term"), F.col("id") % 1000).alias("term"), F.concat(F.lit("n"), F.hex(F.xxhash64("id"))).alias("synonym"))
    fields = spark.createDataFrame([("t", "my_n" + hex(5)[2:]), ("t", "x")], "table string, column string").unionByName(names.limit(3).select(F.lit("t").alias("table"), F.concat(F.lit("pre_"), "synonym").alias("column")))
    fields = spark.createDataFrame(fields.collect(), fields.schema)
    got = match.keyword_scores(fields, names)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.column for r in got.filter("keyword > 0.5").collect()} == {r.column for r in fields.filter("column LIKE 'pre%'").collect()}
    odd = spark.createDataFrame([("",), (None,), ("ab",), ("b",), ("xabc",), ("aba",)], "t string")
    met = {(r.inner_text, r.outer_text) for r in match.containing(odd.select(F.col("t").alias("inner_text")), odd.select(F.col("t").alias("outer_text"))).collect()}
    texts = ["ab", "b", "xabc", "aba"]
    assert met == {(a, b) for a in texts for b in texts if a in b}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.normal(size=3000)] + [("b", 1.0)] * 2000 + [("b", 2.0), (None, 5.0), (None, 7.0), ("c", None), ("d", float("nan")), ("d", 3.0)]
    rows += [("e", float(v)) for v in np.r_[rng.exponential(size=2000) ** 9, 1e300, -1e300]]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = (0.0, 0.1, 0.5, 0.99, 1.0)
    for few in (10, 10_000):
        got = profile.exact_quantiles(df, "x", ("g",), shares, cells=16, few=few)
        assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()
        got = {r.g: r.q for r in got.collect()}
        assert set(got) == {"a", "b", None, "d", "e"}
        for g, q in got.items():
            own = [x for k, x in rows if k == g and x is not None and x == x]
            assert np.allclose(q, np.quantile(own, shares), rtol=1e-9), g
    assert profile.exact_quantiles(df, "x").collect()[0].q[1] == np.quantile([x for _, x in rows if x is not None and x == x], 0.5)
    assert profile.exact_quantiles(df.limit(0), "x").collect() == []
    assert [r.q50 for r in profile.quantiles(df.filter("g = 'c'"), "x", ("g",)).collect()] == [None]


def test_search_in_cells_and_grid(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    x = np.vstack([c + 0.05 * rng.normal(size=(50, 8)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "i long, v array<double>")
    q, named = df.filter("i % 50 = 0"), {"id_col": "i", "vector_col": "v"}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scores = np.round(unit[::50] @ unit.T, 6)
    want = {(50 * a, b) for a in range(20) for b in [b for b in sorted(range(1000), key=lambda b: (-scores[a, b], b)) if b != 50 * a][:4]}
    for options in ({}, {"rows": 100, "block": 3}):
        got = vectors.top_k_cosine(q, df, k=4, **named, **options)
        assert {(r.query_id, r.id) for r in got.collect()} == want
    index = vectors.CellIndex(df, **named, cells=20, rows=30)  # cells are dealt into parts
    assert index.rows.count() == 1000
    assert vectors.recall(index.search(q, 4, probes=3), vectors.top_k_cosine(q, df, k=4, **named)).collect()[0].recall >= 0.95
    assert vectors.CellIndex(df.limit(0), **named).rows.count() == 0
    assert index.search(q.limit(0), 4).count() == 0


def test_sketches_merge(spark):
    df = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") % 7).cast("string").alias("b"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("c"))
    parts = [profile.sketches(df.filter(F.col("a") % 3 == k)) for k in range(3)]
    got = {r.column: r for r in profile.estimates(profile.merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2])), (0.5,)).collect()}
    assert got["a"].rows == got["b"].filled == 20_000 and got["c"].filled == 10_000 and got["b"].q is None
    assert abs(got["a"].distinct_values / 20_000 - 1) < 0.05 and got["b"].distinct_values == 7 and abs(got["c"].q[0] - 10_000) < 700


def test_generations(spark):
    kinds = ("a int, b string", "a int, b string", "a bigint, c string", "c string, b int, _batch string")
    rows = [schema.history_row(spark.createDataFrame([], k).schema, "t", n, f"b{n}", AT) for n, k in enumerate(kinds)]
    got = schema.generation_changes(spark.createDataFrame(rows, schema.SCHEMA_HISTORY)).collect()
    assert {tuple(r)[1:] for r in got} == {(2, "new", "c", None, "string"), (2, "removed", "b", "string", None), (2, "retyped", "a", "int", "bigint"), (3, "new", "b", None, "int"), (3, "removed", "a", "bigint", None)}
