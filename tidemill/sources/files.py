"""Landed files: formats, versions, and which versions are still to be loaded."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str | list[str], kind: str, schema: StructType | None = None) -> DataFrame:
    """JSON lines, CSV with a header, Parquet or Avro; types are inferred unless a schema is given."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind == "csv":
        return reader.options(header=True, inferSchema=schema is None).csv(path)
    if kind == "parquet":
        return reader.parquet(*([path] if isinstance(path, str) else path))
    if kind == "avro":
        return reader.format("avro").load(path)
    raise ValueError(f"unknown source format {kind!r}")


def listed(spark: SparkSession, path: str) -> list:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [store, list(store.listStatus(p))] if store.exists(p) else [store, []]


def read_small(spark: SparkSession, path: str) -> list[str]:
    """Lines of the small files of a folder, in the order of their names, read by the driver."""
    store, entries = listed(spark, path)
    lines = []
    for entry in sorted(entries, key=lambda e: e.getPath().getName()):
        stream = store.open(entry.getPath())
        try:
            lines += spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()
    return lines


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file, seen as a whole or not at all; one that is there is not replaced."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent().getParent(), f".{uuid.uuid4().hex}")
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = store.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    store.mkdirs(p.getParent())
    if not store.rename(part, p):
        store.delete(part, False)
        raise ValueError(f"{path} is there already: another writer's; run again")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def versions(spark: SparkSession, path: str) -> dict[int, int]:
    """Version folders v<digits> under path that hold a file with data, and the latest change of each (ms)."""
    store, entries = listed(spark, path)
    found = {}
    for entry in entries:
        name = re.fullmatch(r"v(\d+)", entry.getPath().getName())
        if name and entry.isDirectory():
            files = [f for f in store.listStatus(entry.getPath()) if f.isFile() and f.getLen() > 0]
            if files:
                found[int(name[1])] = max(f.getModificationTime() for f in files)
    return found


def latest_version(spark: SparkSession, path: str) -> str:
    """The folder name of the highest version, or "" for a flat dataset."""
    found = versions(spark, path)
    return f"v{max(found)}" if found else ""


def unprocessed(spark: SparkSession, path: str, processed: DataFrame, table: str) -> list[int]:
    """Versions not in the control table (table, version, processed_at), or changed since they were processed."""
    done = {r["version"]: r["at"] for r in processed.filter(F.col("table") == table).groupBy("version").agg(F.max(F.unix_millis(F.col("processed_at").cast("timestamp"))).alias("at")).collect()}
    return sorted(v for v, changed in versions(spark, path).items() if v not in done or changed > done[v])


def all_versions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All landed versions with the union of their columns; what a version lacks is null."""
    parts = [read_files(spark, f"{path}/v{v}", kind).withColumn("_version", F.lit(v)) for v in sorted(versions(spark, path))]
    if not parts:
        return read_files(spark, path, kind)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def json_log(spark: SparkSession, path: str) -> DataFrame:
    """Application log lines; their metadata stays JSON text, to be read with get_json_object."""
    return spark.read.schema("timestamp string, level string, module string, message string, metadata string").json(path)


def with_ingest_columns(df: DataFrame, batch_id: str, as_of) -> DataFrame:
    """_ingested_at, _source_file and _batch_id for rows read from files."""
    return df.select("*", F.lit(as_of).cast("timestamp").alias("_ingested_at"), F.col("_metadata.file_path").alias("_source_file"), F.lit(batch_id).alias("_batch_id"))
