"""Reconciliation, audit, monitoring and lineage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _check(kind: str, source, target, passed, details) -> F.Column:
    delta = (F.col(target) - F.col(source)).cast("long")
    pct = F.when(F.col(source) != 0, F.round(100 * delta / F.col(source), 2)).otherwise(F.lit(0.0))
    return F.struct(F.lit(kind).alias("check_type"), F.col(source).alias("source_count"), F.col(target).alias("target_count"), delta.alias("delta"), pct.alias("delta_pct"), passed.alias("passed"), F.lit(details).alias("details"))


def reconcile_counts(source: DataFrame, bronze: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Source rows against bronze rows of a batch (all, without batch_id): passes if none is missing."""
    own = bronze if batch_id is None else bronze.filter(F.col("_batch_id") == batch_id)
    both = source.agg(F.count("*").alias("s")).crossJoin(own.agg(F.count("*").alias("t")))  # one row each
    return both.select(_check("source_bronze", "s", "t", F.col("t") >= F.col("s"), "bronze holds every source row").alias("r")).select("r.*")


def reconcile_layers(bronze: DataFrame, silver: DataFrame, quarantine: DataFrame, most_pct: float = 5.0) -> DataFrame:
    """Bronze rows that neither silver (all versions) nor quarantine has: passes under most_pct of bronze."""
    counts = bronze.agg(F.count("*").alias("s")).crossJoin(silver.agg(F.count("*").alias("a"))).crossJoin(quarantine.agg(F.count("*").alias("b")))
    counts = counts.withColumn("t", F.col("a") + F.col("b"))
    share = F.when(F.col("s") != 0, 100 * F.abs(F.col("s") - F.col("t")) / F.col("s")).otherwise(0.0)
    return counts.select(_check("bronze_silver", "s", "t", share < most_pct, "unaccounted rows").alias("r")).select("r.*")


def reconcile_hashes(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Distinct hashes: silver may not have more than bronze."""
    both = bronze.agg(F.countDistinct("row_hash").alias("s")).crossJoin(silver.agg(F.countDistinct("row_hash").alias("t")))
    return both.select(_check("hash", "s", "t", F.col("t") <= F.col("s"), "distinct hashes").alias("r")).select("r.*")


def missing_hashes(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    return bronze.select("row_hash").distinct().join(silver.select("row_hash"), "row_hash", "left_anti")


def content_checksum(df: DataFrame) -> DataFrame:
    """rows, checksum: the sum of the hashes of all rows, the same in any order."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))


def counted(df: DataFrame, name: str, **more) -> tuple[DataFrame, Observation]:
    """df and an observation of its rows (and further plain aggregates): the first action over it counts as it goes."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in more.items()]), seen


def observed_layers(run_id: str, table: str, source: int, parts: dict[str, int], at, most_pct: float = 0.0) -> tuple:
    """A row of RECONCILIATION: a batch's rows against those that each way out of it took, from observations. Passes up to
    most_pct of them unaccounted for."""
    total = sum(parts.values())
    pct = 100 * (total - source) / source if source else 0.0
    return (run_id, table, "bronze_silver", source, total, total - source, round(pct, 2), abs(pct) <= most_pct, ", ".join(f"{k} {v}" for k, v in parts.items()), at)


def reconciliation_log(checks: list[DataFrame], run_id: str, table: str, at) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select(F.lit(run_id).alias("run_id"), F.lit(table).alias("table_name"), "*", F.lit(at).cast("timestamp").alias("reconciled_at"))


def table_status(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id", "table_name").agg(F.when(F.every("passed"), "SUCCESS").otherwise("WARN").alias("status"))


def table_stats(df: DataFrame, at: str | None = None) -> DataFrame:
    """rows, columns; with files: files, bytes and last_modified of the files that df reads."""
    counts = df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    if at is None:
        return counts
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
    return counts.crossJoin(files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("last_modified")))


def stage_summary(log: DataFrame, subject: str, stage: str, at: str, stages: list[str], status: str | None = None, failed: str = "FAILED") -> DataFrame:
    """subject, last_<stage> for each stage, failures, last_seen: one row per subject of an event log."""
    fails = F.count_if(F.col(status if status else stage) == failed)
    return log.groupBy(subject).agg(*[F.max(F.when(F.col(stage) == s, F.col(at))).alias(f"last_{s}") for s in stages], fails.alias("failures"), F.max(at).alias("last_seen"))


EVENTS = "dataset_name string, stage string, status string, details string, event_time timestamp"


def log_events(log, events: DataFrame, at, name: str | None = None) -> int:
    """Appends events (EVENTS; what they lack is null) to an event log (sources.tables.Batches); of a name given again the
    events replace those before. Returns the batch's number."""
    kinds = dict(events.dtypes)
    columns = [F.col(c).cast(t).alias(c) if c in kinds else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in EVENTS.split(", "))]
    return log.append(events.select(*columns), at, name)


def latest_runs(log: DataFrame, stage: str, n: int, at: str = "event_time", ties: tuple[str, ...] = ()) -> DataFrame:
    """The latest n rows of a stage; of equal times in the order of ties."""
    return log.filter(F.col("stage") == stage).orderBy(F.desc(at), *ties).limit(n)


def log_errors(logs: DataFrame, as_of, hours: int) -> DataFrame:
    """module, errors in the hours before as_of."""
    at = F.try_to_timestamp("timestamp")
    recent = at >= F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return logs.filter((F.col("level") == "ERROR") & recent).groupBy("module").agg(F.count("*").alias("errors"))


def log_latency(logs: DataFrame, path: str = "$.duration_seconds") -> DataFrame:
    """module, p50, p95 of a number in the metadata."""
    seconds = F.get_json_object("metadata", path).try_cast("double")
    return logs.withColumn("_s", seconds).filter("_s IS NOT NULL").groupBy("module").agg(F.percentile_approx("_s", 0.5).alias("p50"), F.percentile_approx("_s", 0.95).alias("p95"))


LINEAGE = "run_id string, stage string, status string, inputs array<string>, outputs array<string>, columns array<struct<column: string, inputs: array<string>, transform: string>>, rows_in long, rows_out long, details string, at timestamp, schema_changes array<struct<change: string, column: string, old: string, new: string, status: string>>, quality array<struct<column: string, rule: string, fail_count: long, total: long>>"


def _column_rows(source: StructType, target: StructType) -> list[tuple]:
    business = [c for c in source.names if not c.startswith("_") and c != "row_hash"]
    rows = []
    for c in target.names:
        if c.startswith("_"):
            rows.append((c, [], "ADDED"))
        elif c == "row_hash" and c not in source.names:
            rows.append((c, business, "HASH"))
        elif c in source.names:
            rows.append((c, [c], "IDENTITY"))
        else:
            rows.append((c, business, "DERIVED"))
    return rows


def column_lineage(spark: SparkSession, source: StructType, target: StructType) -> DataFrame:
    """column, inputs, transform: ADDED for _columns, HASH for row_hash, IDENTITY for equal names, else DERIVED."""
    return spark.createDataFrame(_column_rows(source, target), "column string, inputs array<string>, transform string")


def lineage_event(spark: SparkSession, run_id: str, stage: str, inputs: list[str], outputs: list[str], source: StructType, target: StructType, rows_in: int | None, rows_out: int | None, at, status: str = "COMPLETE", details: str | None = None, audit: list[tuple] = (), checks: DataFrame | None = None) -> DataFrame:
    """One row of LINEAGE. Row counts come from the caller, who has them from an observation or a count.

    audit: the changes of a schema.Decision; checks: a row per rule (quality.check_rules).
    """
    row = spark.createDataFrame([lineage_row(run_id, stage, inputs, outputs, source, target, rows_in, rows_out, at, status, details, audit)], LINEAGE)
    if checks is None:
        return row
    told = checks.agg(F.collect_list(F.struct("column", "rule", "fail_count", "total")).alias("_told"))  # one row a rule
    return row.crossJoin(told).withColumn("quality", F.col("_told")).drop("_told")


def lineage_row(run_id: str, stage: str, inputs: list[str], outputs: list[str], source: StructType, target: StructType, rows_in: int | None, rows_out: int | None, at, status: str = "COMPLETE", details: str | None = None, audit: list[tuple] = ()) -> tuple:
    """A row of LINEAGE without quality facets, as plain values."""
    return (run_id, stage, status, inputs, outputs, _column_rows(source, target), rows_in, rows_out, details, at, list(audit), [])


def lineage_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: name, kind, last_rows_out), (edges: source, target): datasets and stages, and what feeds what."""
    into = events.select(F.explode("inputs").alias("source"), F.col("stage").alias("target"))
    out = events.select(F.col("stage").alias("source"), F.explode("outputs").alias("target"))
    edges = into.unionByName(out).distinct()
    data = events.select(F.explode(F.concat("inputs", "outputs")).alias("name")).distinct().select("name", F.lit("dataset").alias("kind"), F.lit(None).cast("long").alias("last_rows_out"))
    jobs = events.groupBy(F.col("stage").alias("name")).agg(F.max_by("rows_out", "at").alias("last_rows_out")).select("name", F.lit("stage").alias("kind"), "last_rows_out")
    return data.unionByName(jobs), edges


def column_paths(events: DataFrame) -> DataFrame:
    """column, path: the transforms of each column over the stages in time."""
    rows = events.select("at", "stage", F.explode("columns").alias("c")).select("at", "stage", "c.*")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("at", "stage", "transform"))), lambda x: F.concat_ws(":", x["stage"], x["transform"]))
    return rows.groupBy("column").agg(F.array_join(steps, " > ").alias("path"))


RECONCILIATION = "run_id string, table_name string, check_type string, source_count long, target_count long, delta long, delta_pct double, passed boolean, details string, reconciled_at timestamp"
AUDIT = "run_id string, stage string, version string, table_name string, status string, source_count long, target_count long, audited_at timestamp"


def audit(run_id: str, stage: str, version: str, tables: dict[str, tuple[str, DataFrame | None, DataFrame | None]], at) -> DataFrame:
    """One row of AUDIT for each table of a run. tables: name -> (status, source rows, target rows); a layer that is not
    there counts 0. All counts are one plan."""
    out = None
    for name, (status, source, target) in tables.items():
        counts = [(df.agg(F.count("*").alias(c)) if df is not None else None, c) for df, c in ((source, "source_count"), (target, "target_count"))]
        known = [df for df, _ in counts if df is not None]
        row = known[0] if len(known) == 1 else known[0].crossJoin(known[1]) if known else None  # one row each
        if row is None:
            raise ValueError(f"{name}: neither source nor target is given")
        row = row.select(*[F.lit(v).alias(c) for c, v in (("run_id", run_id), ("stage", stage), ("version", version), ("table_name", name), ("status", status))], *[F.col(c) if df is not None else F.lit(0).cast("long").alias(c) for df, c in counts], F.lit(at).cast("timestamp").alias("audited_at"))
        out = row if out is None else out.unionByName(row)
    return out


def dataset_history(log: DataFrame, dataset: str, n: int, *, name: str = "dataset_name", at: str = "event_time", ties: tuple = ()) -> DataFrame:
    """The latest n events of a dataset; of equal times in the order of ties."""
    return log.filter(F.col(name) == dataset).orderBy(F.desc(at), *ties).limit(n)


def log_activity(logs: DataFrame, module: str, message: str, path: str = "$.asset_name") -> DataFrame:
    """dataset, events, last_seen of a module's messages, by what the metadata name."""
    own = logs.filter((F.col("module") == module) & (F.col("message") == message))
    return own.groupBy(F.get_json_object("metadata", path).alias("dataset")).agg(F.count("*").alias("events"), F.max("timestamp").alias("last_seen"))


def log_failures(logs: DataFrame, module: str) -> DataFrame:
    """timestamp, table_name, error of a module's errors."""
    own = logs.filter((F.col("module") == module) & (F.col("level") == "ERROR"))
    return own.select("timestamp", F.get_json_object("metadata", "$.table_name").alias("table_name"), F.get_json_object("metadata", "$.error").alias("error"))
