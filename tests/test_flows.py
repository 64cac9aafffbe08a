import json
import time
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import __spark_entry__
from tidemill.plans import medallion, products
from tidemill.sources import files
from tidemill.sources.tables import Batches, HashStore, History
from tidemill.spec import DqRules, TableSpec
from tidemill.streaming import streams

DATA = "/root/testdata/sf0.001"
T = [datetime(2024, 1, d) for d in (1, 2, 3)]
SCHEMA = StructType([StructField("id", LongType()), StructField("kind", StringType()), StructField("later", StringType())])


def test_versions_and_watermark(spark, tmp_path):
    for v in (1, 2, 10):
        (tmp_path / f"v{v}").mkdir()
        (tmp_path / f"v{v}" / "a.json").write_text(json.dumps({"k": v, **({"extra": 1} if v == 10 else {})}) + "\n")
    (tmp_path / "v11").mkdir()
    assert files.latest_version(spark, str(tmp_path)) == "v10"
    done = spark.createDataFrame([("t", 1, datetime(2100, 1, 1)), ("t", 2, datetime(2000, 1, 1))], "table string, version int, processed_at timestamp")
    assert files.unprocessed(spark, str(tmp_path), done, "t") == [2, 10]
    both = files.all_versions(spark, str(tmp_path), "json")
    assert set(both.columns) == {"k", "extra", "_version"} and both.count() == 3
    with pytest.raises(ValueError):
        files.read_files(spark, str(tmp_path), "xml")


def test_batches_and_time_travel(spark, tmp_path):
    t = Batches(spark, str(tmp_path / "t"))
    assert not t.exists()
    t.append(spark.range(2), T[0], "a")
    assert t.append(spark.range(2, 5).withColumn("n", F.lit(1)), T[1], "b") == 2
    assert t.read().count() == 5 and t.read(version=1).count() == 2 and t.read(as_of=T[0]).count() == 2 and t.read(batch="b").count() == 3
    assert t.append(spark.range(7), T[2], "a") == 1  # loaded again: it replaces what it wrote
    assert t.read().count() == 10 and t.read(but="a").count() == 3 and t.read().columns == ["id", "n"]
    assert [(r.generation, len(r.fields)) for r in t.generations().orderBy("generation").collect()] == [(1, 2), (2, 3)]
    with pytest.raises(ValueError, match="stored as"):
        t.append(spark.range(2).select(F.lit(True).alias("id")), T[2])
    assert t.append(spark.range(0), T[2], "none") == 3 and t.read().count() == 10
    t.append(spark.range(2).select(F.concat(F.lit("x"), "id").alias("id")), T[2], "texts")  # a wider type: what is there is cast
    t.append(spark.range(2).select(F.lit("y").alias("id")), T[2], "a")
    assert sorted(r.id for r in t.read().collect()) == ["2", "3", "4", "x0", "x1", "y", "y"] and t.numbers() == {"a": 1, "b": 2, "none": 3, "texts": 4}


def test_a_failed_write_can_be_run_again(spark, tmp_path):
    t = Batches(spark, str(tmp_path / "t"))
    t.append(spark.range(2), T[0], "a")
    with pytest.raises(Exception, match="broken"):
        t.append(spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id")), T[1], "b")
    assert t.read().count() == 2
    assert t.append(spark.range(5), T[1], "b") == 2 and t.read().count() == 7


def test_history_rewrites_touched_buckets_only(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"), ("k",), 8)
    first = spark.range(800).select(F.col("id").alias("k"), F.lit("a").alias("row_hash"))
    h.merge(first, ("row_hash",), T[0], "b0")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "h" / "data-1").rglob("*.parquet")}
    before = files()
    own = first.filter(h.bucket() == 3).limit(8).withColumn("row_hash", F.lit("b"))
    h.merge(own, ("row_hash",), T[1], "b1")
    after = files()
    assert {p.parent.name for p in set(after) ^ set(before)} == {"_bucket=3"} and len({p.parent.name for p in before}) == 8
    assert sorted((r.version, r.is_current, r["count"]) for r in h.read().groupBy("version", "is_current").count().collect()) == [(1, False, 8), (1, True, 792), (2, True, 8)]
    h.merge(own, ("row_hash",), T[1], "b1")  # run again: nothing closes and nothing is lost
    assert h.read().count() == 808 and h.read([3]).count() < h.read().count()
    h.merge(own.withColumns({"row_hash": F.lit("c"), "n": F.lit(1)}), ("row_hash",), T[1], "b1n")
    h.merge(own.withColumns({"row_hash": F.lit("d"), "n": F.lit("text")}), ("row_hash",), T[2], "b1t")  # a wider type
    assert h.read().count() == 824 and sorted((r.version, r.n or "") for r in h.read([3]).filter("version > 1").distinct().select("version", "n").distinct().collect()) == [(2, ""), (3, "1"), (4, "text")]
    null = spark.createDataFrame([(None, "a"), (900, "a")], "k long, row_hash string")
    for at, batch in ((T[1], "b2"), (T[2], "b3")):
        h.merge(null, ("row_hash",), at, batch)
    assert h.read().filter("k IS NULL").count() == 1 and History(spark, str(tmp_path / "h"), ("k",), 99).buckets == 8


def test_medallion_twice(spark, tmp_path):
    landing, lake = tmp_path / "in", medallion.Lake(spark, str(tmp_path / "lake"))
    spec = TableSpec("c", ("k",), dedup_order_by="t DESC", hash_fields=("k", "name"), dq_rules=DqRules(positive=("n",)), masking={"name": "sha256"}, pii_fields=("name",))
    for v, lines in ((1, [{"k": 1, "name": "a", "n": 1, "t": 1}, {"k": 1, "name": "b", "n": 1, "t": 2}, {"k": 2, "name": "c", "n": 0, "t": 1}]), (2, [{"k": 1, "name": "z", "n": 3, "t": 3, "more": "x"}, {"k": 3, "name": "d", "n": 1, "t": 1, "more": None}])):
        (landing / f"v{v}").mkdir(parents=True)
        (landing / f"v{v}" / "x.json").write_text("\n".join(map(json.dumps, lines)))
    assert medallion.land_and_load(lake, spec, str(landing), datetime(2100, 1, 1)) == [1, 2]
    assert medallion.land_and_load(lake, spec, str(landing), datetime(2100, 1, 1)) == []
    history = lake.history(spec).read()
    assert sorted((r.k, r.version, r.is_current) for r in history.collect()) == [(1, 1, False), (1, 2, True), (3, 1, True)]
    assert lake.table("quarantine", "c").read().count() == 1
    out = medallion.gold(lake, spec, str(tmp_path / "gold"), T[2])
    assert out.count() == 2 and "row_hash" not in out.columns and all(len(r.name) == 64 for r in out.collect())


def test_silver_over_several_batches(spark, tmp_path):
    lake = medallion.Lake(spark, str(tmp_path / "lake"))
    spec = TableSpec("c", ("k",), dedup_order_by="t DESC", hash_fields=("k", "v"), dq_rules=DqRules(positive=("n",)))
    for b, own in enumerate(([(1, "A", 1, 1)], [(1, "B", 1, 2)], [(1, "A", 1, 3)], [(1, "A", 1, 4), (2, "x", 1, 4), (2, "y", -1, 5)])):
        medallion.bronze(lake, spec, spark.createDataFrame(own, "k long, v string, n long, t long"), f"b{b}", datetime(2024, 1, 1 + b))
        medallion.silver(lake, spec, datetime(2024, 1, 1 + b), f"b{b}")
    history = lake.history(spec).read()
    assert sorted((r.k, r.v, r.version, r.is_current) for r in history.collect()) == [(1, "A", 1, False), (1, "A", 3, True), (1, "B", 2, False), (2, "x", 1, True)]
    assert [(r.k, r.v) for r in lake.table("quarantine", "c").read().collect()] == [(2, "y")]


def test_silver_within_a_batch_and_by_key(spark, tmp_path):
    lake = medallion.Lake(spark, str(tmp_path / "lake"))
    spec = TableSpec("c", ("k",), dedup_order_by="t DESC", hash_fields=("v",))  # the hash lacks the key
    for b, own in enumerate(([(1, "A", 1)], [(1, "B", 2), (1, "A", 3), (2, "A", 2)], [(1, "B", 4), (3, None, 4)])):
        medallion.bronze(lake, spec, spark.createDataFrame(own, "k long, v string, t long"), f"b{b}", datetime(2024, 1, 1 + b))
        checks = medallion.silver(lake, spec, datetime(2024, 1, 1 + b), f"b{b}").collect()
        assert [(c.source_count, c.target_count, c.passed) for c in checks] == [(len(own), len(own), True)]
    history = lake.history(spec).read()
    assert sorted((r.k, r.version, r.v or "", r.is_current) for r in history.collect()) == [(1, 1, "A", False), (1, 2, "B", True), (2, 1, "A", True), (3, 1, "", True)]
    medallion.silver(lake, spec, datetime(2024, 1, 3), "b2")  # again
    assert lake.history(spec).read().count() == 4
    assert sorted((r.stage, r.rows_in, r.rows_out) for r in lake.notes("lineage").read("silver-c-b1").collect()) == [("silver", 3, 3)]


def test_values_lost_and_late_rows_are_recorded(spark, tmp_path):
    lake = medallion.Lake(spark, str(tmp_path / "lake"))
    spec = TableSpec("c", ("k",), dedup_order_by="t DESC", event_time_column="t", late_arrival_window_days=2)
    for b, rows in enumerate(([(1, "2024-01-01", "true")], [(1, "2024-01-01", "true"), (2, "2023-12-01", "x"), (3, "2024-01-04", "false")])):
        df = spark.createDataFrame(rows, "k long, t string, n string")
        medallion.bronze(lake, spec, df.withColumn("n", F.col("n").try_cast("boolean")) if b == 0 else df, f"b{b}", T[b])
        medallion.silver(lake, spec, datetime(2024, 1, 4 + b), f"b{b}")
    assert [(r.column, r.lost) for r in lake.notes("values_lost").read().collect()] == [("n", 1)]
    assert [(r.k, r._quarantine_reason) for r in lake.table("quarantine", "c").read().collect()] == [(2, "event time is over 2 days old")]
    assert sorted((r.k, r.n, r.version) for r in lake.history(spec).read().collect()) == [(1, True, 1), (3, False, 1)]


def test_change_data_by_state(spark, tmp_path):
    lake = medallion.Lake(spark, str(tmp_path / "lake"))
    spec = TableSpec("c", ("k",), is_cdc=True, dedup_order_by="t DESC")
    steps = [
        [(1, "INSERT", 1, "a", "x"), (2, "INSERT", 1, "b", None)],
        [(1, "UPDATE", 2, None, "y"), (2, "DELETE", 2, None, None), (3, "UPDATE", 2, "c", None)],
        [(1, "UPDATE", 4, "d", None), (2, "UPDATE", 3, None, "z"), (3, "UPDATE", 3, None, "w")],
        [(1, "UPDATE", 3, None, None), (2, "INSERT", 5, None, "q"), (2, "UPDATE", 6, "e", None)],  # key 1 late
        [(1, "UPDATE", 5, None, None)],
    ]
    kind = "k long, _cdc_operation string, t long, v string, w string"
    for b, own in enumerate(steps):
        for _ in range(1 + (b == 2)):  # one is loaded again
            medallion.bronze(lake, spec, spark.createDataFrame(own, kind), f"b{b}", T[0])
    got = sorted((r.k, r.t, r.v or "", r.w or "") for r in lake.table("bronze", "c").read().collect())
    assert got == [(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "a", "y"), (1, 4, "d", "y"), (1, 5, "d", "y"), (2, 1, "b", ""), (2, 2, "", ""), (2, 3, "b", "z"), (2, 5, "", "q"), (2, 6, "e", "q"), (3, 2, "c", ""), (3, 3, "c", "w")]
    assert lake.state(spec).read().count() == 3


def test_hashes_of_touched_partitions_only(spark, tmp_path):
    store = HashStore(spark, str(tmp_path / "s"), 1)
    both = [spark.createDataFrame([(x,) for x in own], "row_hash string") for own in (("a1", "a2", "b1"), ("a1", "c9"))]
    store.add(both[0], "0")
    store.add(both[1], "1")
    known = store.known(spark.createDataFrame([("a3",), ("c1",)], "row_hash string"), "1")
    assert sorted(r[0] for r in known.collect()) == ["a1", "a2"]
    scan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "_prefix" in scan.split("PartitionFilters")[1].split("]")[0]


def test_empty_landing_is_an_error(spark, tmp_path):
    (tmp_path / "in" / "v1").mkdir(parents=True)
    (tmp_path / "in" / "v1" / "x.json").write_text("\n")
    with pytest.raises(ValueError, match="no rows"):
        medallion.land_and_load(medallion.Lake(spark, str(tmp_path / "lake")), TableSpec("c", ("k",)), str(tmp_path / "in"), T[0])


def test_stream_rows_are_counted_as_they_pass(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\n2\n\n")
    log = Batches(spark, str(tmp_path / "lineage"))
    listener = streams.RowCounts(log, "clean", "came", "went", ["in"], ["out"], T[0])
    spark.streams.addListener(listener)
    try:
        rows = streams.observed(streams.observed(streams.text_source(spark, str(tmp_path / "in")), "came").filter("value <> ''"), "went")
        streams.append_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        for _ in range(100):
            if log.exists() and log.read().count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [(r.stage, r.rows_in, r.rows_out, r.outputs) for r in log.read().collect()] == [("clean", 3, 2, ["out"])]


def test_stream_dedup_and_malformed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [json.dumps({"id": i % 3, "kind": "a"}) for i in range(6)] + ["{broken", json.dumps({"id": None, "kind": "a"})]
    for name in ("one", "two"):
        (src / f"{name}.txt").write_text("\n".join(lines))
    target = Batches(spark, str(tmp_path / "sink"))
    for _ in range(2):
        parsed = streams.parse(streams.text_source(spark, str(src), 1), SCHEMA)
        valid = streams.keep_valid(parsed.rows, DqRules(not_null=("id",)))
        streams.dedup_into(valid, target, str(tmp_path / "cp"), ("id", "kind"), T[0]).awaitTermination()
    assert sorted(r.id for r in target.read().collect()) == [0, 1, 2]
    bad = streams.append_stream(parsed.malformed, str(tmp_path / "bad"), str(tmp_path / "cp2"))
    bad.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_stream_dedup_within_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\n1\n2\n")
    rows = streams.text_source(spark, str(tmp_path / "in")).withColumn("t", F.lit(T[0]).cast("timestamp"))
    streams.append_stream(streams.dedup_within(rows, "t", ("value",)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_stream_batches_by_bytes(spark, tmp_path):
    """Batches of a size in bytes: their number does not follow the number of files, and any number gives the same rows."""
    (tmp_path / "in").mkdir()
    for k in range(12):
        (tmp_path / "in" / f"{k}.txt").write_text(f"{k % 4}\nall\n")
    for name, size, batches in (("one", 1 << 30, 1), ("many", 1, 12)):
        rows = streams.text_source(spark, str(tmp_path / "in"), bytes_per_trigger=size).withColumn("t", F.lit(T[0]).cast("timestamp"))
        query = streams.append_stream(streams.dedup_within(rows, "t", ("value",)), str(tmp_path / name), str(tmp_path / f"cp-{name}"))
        query.awaitTermination()
        assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == batches
        assert sorted(r.value for r in spark.read.parquet(str(tmp_path / name)).collect()) == ["0", "1", "2", "3", "all"]


def test_products(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("plain")
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "twice.sql").write_text("-- note\nSELECT id * ${N} AS id FROM plain")
    assert sorted(r.id for r in products.refresh(spark, "twice", str(tmp_path / "sql"), str(tmp_path / "out"), {"N": "2"}).collect()) == [0, 2, 4]
    assert products.refresh(spark, "plain", str(tmp_path / "sql"), str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        products.build(products.ProductSpec((products.Source("p", spark.range(1), pii_fields=("id",)),), ("id",), {"n": "count(*)"}))


def beside_sql(spark, folder, name):
    """(rows of a query, rows of its SQL) over a folder's tables, by the names of their columns."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = __spark_entry__.queries()[name](spark, str(folder)), con.execute(__spark_entry__.oracle_sql()[name])
    cols, names = sorted(got.columns), [c[0] for c in want.description]
    assert sorted(names) == cols
    return sorted(([r[c] for c in cols] for r in got.collect()), key=str), sorted(([r[names.index(c)] for c in cols] for r in want.fetchall()), key=str)


def test_counts_of_groups_without_values(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{DATA}/customer.parquet' WHERE c_custkey < 5) TO '{tmp_path}/customer.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (o_custkey % 3 AS o_custkey, CASE WHEN o_custkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus) FROM '{DATA}/orders.parquet' LIMIT 50) TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-29 12:00:00' AS ts, CASE WHEN user_id > 0 THEN event_type END AS event_type) FROM '{DATA}/events.parquet' WHERE user_id < 3) TO '{tmp_path}/events.parquet'")
    for name in ("health_score", "engagement", "risk_window"):
        got, want = beside_sql(spark, tmp_path, name)
        assert got == want and any(None in r for r in got), name


def test_medallion_of_odd_balances(spark, tmp_path):
    own = "CASE c_custkey // 2 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 3.0 WHEN 3 THEN NULL WHEN 4 THEN 'nan'::DOUBLE WHEN 5 THEN 0.0 WHEN 6 THEN -1.0 ELSE c_acctbal END"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({own} AS c_acctbal, 5 AS c_nationkey) FROM '{DATA}/customer.parquet' WHERE c_custkey < 20) TO '{tmp_path}/customer.parquet'")
    got, want = beside_sql(spark, tmp_path, "medallion")
    assert got == want and len(got) == 20


def test_entry_and_oracles(spark):
    assert __spark_entry__.entry(spark).count() > 0
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    from tidemill.plans import queries

    def plain(v):
        return None if v is None else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)

    found = queries.oracle_sql()
    for name, sql in found.items():
        got = queries.queries()[name](spark, DATA)
        cols = sorted(got.columns)
        ours = sorted([[plain(r[c]) for c in cols] for r in got.collect()], key=str)
        theirs = con.execute(sql)
        names = [c[0] for c in theirs.description]
        assert sorted(names) == cols, name
        assert ours == sorted([[plain(r[names.index(c)]) for c in cols] for r in theirs.fetchall()], key=str), name
