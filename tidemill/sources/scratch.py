"""Folders for a session's own tables, where driver and executors both see them."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_REPO = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode where that is unset one temporary folder for the application."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-tidemill-")
        drop_at_exit(spark, _OWN[app])
    return _OWN[app]


def drop_at_exit(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/tidemill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: later reads do not run its lineage again and survive the loss of executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_import_this(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, whatever their working directory. On a cluster whose workers
    do not have that path, send the package with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *paths])
