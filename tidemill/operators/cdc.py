"""Change data: partial updates made whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _running(batch: DataFrame, history: DataFrame | None, key: tuple[str, ...], order_by: str, op: str) -> tuple[DataFrame, list[str]]:
    """Batch and history as one sequence by key, with _in_batch and, as _f_<column>, each field's last value since the key's last INSERT."""
    fields = [c for c in batch.columns if c not in (*key, op, order_by)]
    rows = batch.withColumn("_in_batch", F.lit(True))
    if history is not None:
        rows = rows.unionByName(history.select(*[c for c in batch.columns if c in history.columns]).withColumn("_in_batch", F.lit(False)), allowMissingColumns=True)
    sequence = (order_by, "_in_batch", F.when(F.col(op) == "INSERT", 0).otherwise(1))
    order = Window.partitionBy(*key).orderBy(*sequence)
    life = F.sum(F.when(F.col(op) == "INSERT", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_life", life)
    since = Window.partitionBy(*key, "_life").orderBy(*sequence).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(since) for c in fields}), fields


def _filled(running: DataFrame, columns: list[str], fields: list[str], op: str) -> DataFrame:
    update = F.col(op) == "UPDATE"
    return running.filter("_in_batch").select(*[F.when(update, F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in columns])


def rebuild(batch: DataFrame, history: DataFrame | None, key: tuple[str, ...], order_by: str, *, op: str = "_cdc_operation") -> DataFrame:
    """The rows of batch with what an UPDATE leaves out filled from the rows of its key before it.

    History and batch are one sequence by key, in order_by; a null field of an UPDATE takes the last value before it, back
    to the last INSERT of the key. An update without a base keeps its nulls; inserts and deletes stay as they are. A null
    means "unchanged": in JSON and CSV it cannot be told from a field set to null. batch and history must share order_by. Of
    the history only rows of the batch's keys are sorted.
    """
    if history is not None:
        history = history.join(batch.select(*key).distinct(), list(key), "left_semi")
    running, fields = _running(batch, history, key, order_by, op)
    return _filled(running, batch.columns, fields, op)


def rebuild_from_state(batch: DataFrame, state: DataFrame | None, history: Callable[[DataFrame], DataFrame] | None, key: tuple[str, ...], order_by: str, *, op: str = "_cdc_operation") -> tuple[DataFrame, DataFrame]:
    """(batch as rebuild makes it, the latest state of its keys) without reading what went before.

    state: one row a key, its fields' last values since its last INSERT, with order_by and op of the key's last row. Rows
    that come after their key's state are completed from it alone. A batch in which a key has a row that is not later than
    its state needs what lay between: history(keys) gives the stored rows of such keys, and of these only.
    """
    if state is None:
        running, fields = _running(batch, None, key, order_by, op)
    else:
        first = batch.groupBy(*key).agg(F.min(order_by).alias("_first"))
        known = state.select(*key, F.col(order_by).alias("_last"))
        late = first.join(known, list(key)).filter("_first <= _last").select(*key)
        own = state.join(late, list(key), "left_anti")
        base = own if history is None else own.unionByName(history(late), allowMissingColumns=True)
        running, fields = _running(batch, base.join(first.select(*key), list(key), "left_semi"), key, order_by, op)
    last = running.groupBy(*key).agg(F.max(F.struct(order_by, "_in_batch", F.when(F.col(op) == "INSERT", 0).otherwise(1).alias("_o"), op, *[f"_f_{c}" for c in fields])).alias("s"))
    latest = last.select(*key, *[F.col(f"s.{c}") for c in (order_by, op)], *[F.col(f"s._f_{c}").alias(c) for c in fields]).select(*batch.columns)
    return _filled(running, batch.columns, fields, op), latest


def without_deletes(df: DataFrame, op: str = "_cdc_operation") -> DataFrame:
    """Rows that are no DELETE (a null operation is none), without the operation column."""
    return df.filter(F.col(op).isNull() | (F.col(op) != "DELETE")).drop(op)
