"""What the operators of this subpackage share: intermediate tables, paths on workers, row batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources import scratch
from ..sources.scratch import new_path

#: Words are runs of bytes other than these; bytes.split() and bytes.lower() follow the same ASCII rules.
SPACE = r"\x20\x09-\x0D"


#: Written tables of each open passing_tables, with their paths; each thread of a driver has its own.
_PASSING: ContextVar[tuple[list[tuple[DataFrame, str]], ...]] = ContextVar("passing", default=())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: later reads do not run its lineage again and survive the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if open_ := _PASSING.get():
        open_[-1].append((out, path))
    return out


@contextmanager
def passing_tables(spark: SparkSession):
    """Tables that this thread writes inside are deleted at its end, but for those that are put into the list that it gives."""
    keep: list[DataFrame] = []
    outer, own = _PASSING.get(), []
    _PASSING.set((*outer, own))
    try:
        yield keep
    finally:
        _PASSING.set(outer)
        stay = [(df, path) for df, path in own if any(df is k for k in keep)]
        for _, path in own:
            if path not in [p for _, p in stay]:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if outer:
            outer[-1].extend(stay)


#: Arrow batches end at so many bytes, so that a worker's and an executor's buffers do not grow with the length of texts.
BATCH_BYTES = 4 << 20


def workers_import_this(spark: SparkSession) -> None:
    """Python workers find this package as the driver does, whatever their working directory, and are sent small batches:
    the session's limit in bytes is lowered to BATCH_BYTES where it is greater."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)) > BATCH_BYTES:
        spark.conf.set(limit, f"{BATCH_BYTES}b")
    scratch.workers_import_this(spark)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def each_text(texts: pa.Array, rows: int = 256) -> Iterator[str]:
    """Whole texts of a column, of which few are Python strings at a time; null reads as empty."""
    for at in range(0, len(texts), rows):
        for text in texts.slice(at, rows).to_pylist():
            yield text or ""


def slices(batches, rows: int = 256):
    """Batches of at most so many rows, for tasks whose output is as large as their input: neither side holds more at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_groups(batches, keys: list[str], rows: int = 1 << 16):
    """Tables of about so many rows, cut where the values of keys change: batches sorted by keys, whose groups stay whole."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(group_starts(table, keys)[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        count = rows - max(rows, table.num_rows - cut)  # a group that goes on is looked at again when it has doubled
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    if table is not None and table.num_rows:
        yield table


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin in a sorted table; its columns are one chunk each."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        column = table.column(key)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, max(table.num_rows - 1, 0))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def to_batch(columns: dict[str, tuple[pa.DataType, object]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for t, v in columns.values()], names=list(columns))
