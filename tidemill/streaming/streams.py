"""Structured Streaming: parsing, quality, deduplication and sinks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from ..operators.dedup import drop_copies, with_row_hash
from ..operators.monitor import lineage_event
from ..operators.quality import violations
from ..sources.tables import Batches, HashStore
from ..spec import DqRules


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", per_trigger: int = 5000, **options: str) -> DataFrame:
    """key, value (text) and timestamp of a topic."""
    said = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "false", **options}
    return spark.readStream.format("kafka").options(**said).load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp")


def text_source(spark: SparkSession, path: str, files_per_trigger: int = 100, *, bytes_per_trigger: int | None = None) -> DataFrame:
    """value: lines of files as they land. With bytes_per_trigger (one file at least) a batch is as large whatever
    files the input lies in, so what each batch costs by itself does not grow with their number."""
    size = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    return spark.readStream.option(*size).text(path)


class Parsed(NamedTuple):
    rows: DataFrame
    malformed: DataFrame


def parse(stream: DataFrame, schema: StructType, keep: tuple[str, ...] = ()) -> Parsed:
    """The JSON in value as columns of schema, and the values that are no JSON object.

    A schema holds the columns of all its versions, nullable, so older and newer messages parse alike.
    """
    rows = stream.select(*keep, "value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("data"))
    bad = F.col("data").isNull() | F.get_json_object("value", "$").isNull()
    return Parsed(rows.filter(~bad).select(*keep, "data.*"), rows.filter(bad).select(*keep, "value"))


def keep_valid(stream: DataFrame, rules: DqRules) -> DataFrame:
    """Rows that keep the not_null and accepted_values rules."""
    out = stream
    for broken in violations(stream, DqRules(not_null=rules.not_null, accepted_values=rules.accepted_values)).values():
        out = out.filter(~broken)
    return out


def dedup_within(stream: DataFrame, event_time: str, hash_fields: tuple[str, ...], window: str = "1 hour") -> DataFrame:
    """First of rows with equal hash within a window of event time; the watermark bounds the state."""
    hashed = with_row_hash(stream, hash_fields)
    return hashed.withWatermark(event_time, window).dropDuplicatesWithinWatermark(["row_hash"])


def append_stream(stream: DataFrame, path: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Appends to a Parquet folder; with `every` at that interval, else until the input is read."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def dedup_into(stream: DataFrame, target: Batches, checkpoint: str, hash_fields: tuple[str, ...], at, *, every: str | None = None, digits: int = 2) -> StreamingQuery:
    """Appends rows whose hash the batch and the target have not had. Replayed batches write the same rows again.

    Exact and without state: hashes lie beside the target in partitions by their first `digits`, of which a batch reads
    those that its own hashes fall to. dedup_within is the way that is bounded by a watermark.
    """
    store = HashStore(target.spark, f"{target.path}/hashes", digits)

    def batch(df: DataFrame, batch_id: int) -> None:
        query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        name = f"{query}-{batch_id}"
        hashed = drop_copies(with_row_hash(df, hash_fields)).persist()
        try:
            fresh = hashed.join(store.known(hashed.select("row_hash"), name), "row_hash", "left_anti").select(*hashed.columns)
            target.append(fresh.withColumn("_batch_id", F.lit(str(batch_id))), at, name)
            store.add(target.read(batch=name).select("row_hash"), name)
        finally:
            hashed.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def create_empty(spark: SparkSession, schema: StructType, target: Batches, at) -> None:
    """The target with no rows, before the first batch."""
    if not target.exists():
        target.append(spark.createDataFrame([], schema), at)


def observed(stream: DataFrame, name: str) -> DataFrame:
    """stream whose progress tells how many rows each batch had, under a name: see RowCounts."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"))


class RowCounts(StreamingQueryListener):
    """Appends a lineage row for each batch of a stream, with the rows that its observations counted; no second count.

    into, out: the names given to observed on the stream's input and output.
    """

    def __init__(self, log: Batches, stage: str, into: str, out: str, inputs: list[str], outputs: list[str], at):
        self.log, self.stage, self.into, self.out, self.inputs, self.outputs, self.at = log, stage, into, out, inputs, outputs, at

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics
        if self.into not in seen and self.out not in seen:
            return
        rows = [seen[n].rows if n in seen else None for n in (self.into, self.out)]
        name, spark = f"{event.progress.id}-{event.progress.batchId}", self.log.spark
        self.log.append(lineage_event(spark, name, self.stage, self.inputs, self.outputs, StructType([]), StructType([]), *rows, self.at), self.at, name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
