"""The layers: landed files to bronze, silver with history, gold products."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import apply_masking, strip_non_printable, trim_all
from ..operators import cdc, dedup, late, monitor, quality, schema
from ..sources import files
from ..sources.tables import Batches, History, Keyed, Notes
from ..spec import TableSpec

NOTES = {
    "lineage": monitor.LINEAGE,
    "reconciliation": monitor.RECONCILIATION,
    "schema_history": schema.SCHEMA_HISTORY,
    "schema_change_audit": schema.AUDIT,
    "values_lost": "table string, batch string, column string, lost long",
    "watermark": "table string, version string, processed_at timestamp",
}
INTERNAL = ("_ingested_at", "_source_file", "_batch_id", "_dq_flags")


class Lake(NamedTuple):
    """Where a run's tables are."""

    spark: SparkSession
    root: str

    def table(self, layer: str, name: str) -> Batches:
        return Batches(self.spark, f"{self.root}/{layer}/{name}")

    def notes(self, name: str) -> Notes:
        """A control table: lineage, reconciliation, schema_history, schema_change_audit, values_lost or watermark."""
        return Notes(self.spark, f"{self.root}/control/{name}", NOTES[name])

    def history(self, spec: TableSpec) -> History:
        return History(self.spark, f"{self.root}/silver/{spec.table}", spec.primary_key, spec.buckets)

    def state(self, spec: TableSpec) -> Keyed:
        """The latest complete row of each key of a table of change data."""
        return Keyed(self.spark, f"{self.root}/state/{spec.table}", spec.primary_key, spec.buckets)


def _completed(lake: Lake, spec: TableSpec, df: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """(change data with whole rows, the state of its keys after it)."""
    target, state = lake.table("bronze", spec.table), lake.state(spec)
    order = spec.dedup_order_by.split()[0] if spec.dedup_order_by else "_ingested_at"
    known = state.read(state.touched(df)) if state.exists() else None

    def stored(keys: DataFrame) -> DataFrame:
        return target.read(but=batch_id).join(keys, list(spec.primary_key), "left_semi").select(*[c for c in df.columns if c in target.fields().names])

    return cdc.rebuild_from_state(df, known, stored if known is not None else None, spec.primary_key, order)


def bronze(lake: Lake, spec: TableSpec, landed: DataFrame, batch_id: str, at, policy: schema.Policy = schema.BRONZE) -> int:
    """Writes a landed batch as it came, with hash, ingest columns and flags. Returns its number; a batch that is loaded
    again replaces what it wrote.

    landed: read_files(...) with ingest columns, or any rows. Updates that carry only changed fields are made whole first,
    from the state of their keys. Values that do not fit the stored types become null and are counted in control.values_lost.
    """
    target, df = lake.table("bronze", spec.table), schema.apply_aliases(landed, spec.aliases)
    mark, latest = f"{spec.table}-{batch_id}", None
    if spec.is_cdc:
        if "_ingested_at" not in df.columns:
            df = df.withColumn("_ingested_at", F.lit(at).cast("timestamp"))
        df, latest = _completed(lake, spec, df, batch_id)
    df = dedup.with_row_hash(df, spec.hash_fields)
    df = df.withColumn("_batch_id", F.lit(batch_id)).withColumn("_ingested_at", F.lit(at).cast("timestamp"))
    df = quality.flag(df, spec.dq_rules)
    stored, lost = target.fields(), None
    if stored is not None and not schema.unchanged(df.schema, schema.fingerprint(stored), stored):
        came = df
        df, quarantined, said = schema.evolve(df, stored, policy)
        lake.notes("schema_change_audit").put(schema.audit_tuples(said, spec.table, "bronze", batch_id, at), mark)
        if df is None:
            return lake.table("quarantine", f"{spec.table}_schema").append(quarantined.select(*[F.col(c).cast("string").alias(c) for c in quarantined.columns]), at, batch_id)
        lost = schema.values_lost(came, said.target)
    df, seen = monitor.counted(df, f"bronze-{mark}")
    number = target.append(df, at, batch_id)
    if lost is not None:
        lake.notes("values_lost").put([(spec.table, batch_id, r["column"], r["lost"]) for r in lost.collect()], mark)  # one row a column
    if latest is not None:
        _update_state(lake.state(spec), latest, at)
    rows = seen.get["rows"]
    lineage = monitor.lineage_row(batch_id, "bronze", [f"landing.{spec.table}"], [f"bronze.{spec.table}"], landed.schema, df.schema, rows, rows, at, audit=[] if lost is None else said.audit)
    lake.notes("lineage").put([lineage], f"bronze-{mark}")
    lake.notes("schema_history").put([schema.history_row(landed.schema, spec.table, number, batch_id, at)], mark)
    lake.notes("watermark").put([(spec.table, batch_id, at)], mark)
    return number


def _update_state(state: Keyed, latest: DataFrame, at) -> None:
    """Puts the latest rows of their keys beside what the same buckets hold of other keys."""
    rows = latest
    if state.exists():
        rows = rows.unionByName(state.read(state.touched(latest)).join(latest.select(*state.key), list(state.key), "left_anti"), allowMissingColumns=True)
    state.replace(rows, at)


def silver(lake: Lake, spec: TableSpec, at, batch_id: str | None = None, *, dialect: str = "lenient") -> DataFrame:
    """Takes bronze rows (of a batch, or all) into the history of the table; returns the reconciliation rows, which are
    also in control.reconciliation.

    Rows that break a rule and late rows leave on the way, to quarantine. Texts are cleaned and masked after the late check.
    Of the valid rows the latest per key is compared with its key's current row, so a rejected row hides no earlier one,
    values that come and go within a batch leave no trace, and values that a key had before count as a change when they
    return. Late rows that equal their key's current one are known and leave nothing. Rows are counted as they pass.
    """
    bronze_rows, target = lake.table("bronze", spec.table), lake.history(spec)
    first_load = not target.exists()
    source, read = monitor.counted(bronze_rows.read(batch=batch_id), f"read-{batch_id}")
    df = source
    if "_cdc_operation" in df.columns:
        df = cdc.without_deletes(df)
    if spec.record_filter:
        df = df.filter(F.expr(spec.record_filter))
    df, judged = monitor.counted(df, f"judged-{batch_id}")
    passed, rejected = quality.reject(schema.apply_type_overrides(df.drop("_dq_flags"), spec.type_overrides), spec, dialect=dialect)
    rejected, bad = monitor.counted(rejected.drop(*[c for c in INTERNAL if c != "_dq_flags"]), f"rejected-{batch_id}")
    rejected = rejected.withColumn("_quarantine_reason", F.array_join("_dq_flags", ",")).withColumn("_quarantined_at", F.lit(at).cast("timestamp")).drop("_dq_flags")
    name = batch_id or "full"
    quarantine = lake.table("quarantine", spec.table)
    quarantine.append(rejected, at, f"{name}-rejected")
    tardy = None
    if spec.event_time_column:
        split = late.split_late(passed, spec.event_time_column, at, spec.late_arrival_window_days, first_load=first_load)
        passed, (late_rows, tardy) = split.on_time, monitor.counted(split.late.drop(*INTERNAL), f"late-{batch_id}")
        if not first_load:
            late_rows = late_rows.join(target.current().select(*spec.primary_key, "row_hash"), [*spec.primary_key, "row_hash"], "left_anti")
        quarantine.append(late_rows, at, f"{name}-late")
    passed, good = monitor.counted(passed, f"passed-{batch_id}")
    passed = dedup.latest(passed, spec.primary_key, spec.dedup_order_by or "_ingested_at DESC").drop(*INTERNAL)
    clean = apply_masking(trim_all(strip_non_printable(passed)), spec.masking)
    if not first_load:
        said = schema.decide(clean.schema, StructType([f for f in target.fields() if f.name not in ("valid_from", "valid_to", "is_current", "version")]), schema.SILVER)
        clean = schema.align(clean, said.target)
    target.merge(clean, ("row_hash",), at, name)
    counts = {"filtered": read.get["rows"] - judged.get["rows"], "rejected": bad.get["rows"], "late": tardy.get["rows"] if tardy else 0, "passed": good.get["rows"]}
    mark, checks, lineage = f"{spec.table}-{name}", lake.notes("reconciliation"), lake.notes("lineage")
    checks.put([monitor.observed_layers(name, spec.table, read.get["rows"], counts, at)], mark)
    lineage.put([monitor.lineage_row(name, "silver", [f"bronze.{spec.table}"], [f"silver.{spec.table}", f"quarantine.{spec.table}"], source.schema, target.fields(), read.get["rows"], good.get["rows"], at)], f"silver-{mark}")
    return checks.read(mark)


def gold(lake: Lake, spec: TableSpec, out: str, at) -> DataFrame:
    """Current rows under the contract, one per key, published."""
    current = lake.history(spec).current()
    required = tuple(dict.fromkeys((*spec.primary_key, *spec.dq_rules.not_null)))
    df = dedup.unique_for_publishing(schema.check_contract(current, required), spec.primary_key)
    df = df.drop("row_hash", "valid_from", "valid_to", "is_current", "version").withColumn("_gold_published_at", F.lit(at).cast("timestamp"))
    if leaks := [c for c in quality.leaked_columns(df, spec.pii_fields) if c not in spec.masking]:
        raise ValueError(f"unmasked personal columns: {leaks}")
    df.write.mode("overwrite").parquet(out)
    return lake.spark.read.parquet(out)


def land_and_load(lake: Lake, spec: TableSpec, landing: str, at) -> list[int]:
    """Every landed version not yet processed, through bronze and silver."""
    done = lake.notes("watermark").read().select("table", F.regexp_extract("version", r"(\d+)", 1).try_cast("int").alias("version"), "processed_at")
    todo = files.unprocessed(lake.spark, landing, done, spec.table)
    for v in todo:
        landed = files.read_files(lake.spark, f"{landing}/v{v}", spec.source_format)
        if landed.isEmpty():
            raise ValueError(f"{landing}/v{v} holds no rows")
        bronze(lake, spec, landed, f"v{v}", at)
        silver(lake, spec, at, f"v{v}")
    return todo
