"""Slowly changing dimensions. Each function takes the stored table and a batch with one row per key and returns the new table.

A row changes if any tracked column differs, null included. Keys that a batch lacks stay as they are.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType

END_OF_TIME = "9999-12-31 00:00:00"


def _end() -> Column:
    return F.lit(END_OF_TIME).cast("timestamp")


def _differs(columns: tuple[str, ...], old: str = "_t_", new: str = "_s_") -> Column:
    return reduce(lambda a, b: a | b, [~F.col(old + c).eqNullSafe(F.col(new + c)) for c in columns], F.lit(False))


def _renamed(df: DataFrame, prefix: str, key: tuple[str, ...]) -> DataFrame:
    return df.select(*key, *[F.col(c).alias(prefix + c) for c in df.columns if c not in key], F.lit(True).alias(prefix + "there"))


def _at(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


def classify(target: DataFrame, batch: DataFrame, key: tuple[str, ...], compared: tuple[str, ...] = ("row_hash",)) -> DataFrame:
    """batch with _change: new, changed or unchanged against target (one row per key)."""
    t = _renamed(target.select(*key, *compared), "_t_", key)
    s = batch.select("*", *[F.col(c).alias("_s_" + c) for c in compared])
    change = F.when(F.col("_t_there").isNull(), "new").when(_differs(compared), "changed").otherwise("unchanged")
    return s.join(t, list(key), "left").withColumn("_change", change).select(*batch.columns, "_change")


def empty_target(batch: DataFrame, scd_type: int, tracked: tuple[str, ...] = ()) -> StructType:
    """The schema of a type's table over the columns of batch."""
    more = {
        1: [("created_at", TimestampType()), ("updated_at", TimestampType())],
        2: [("valid_from", TimestampType()), ("valid_to", TimestampType()), ("is_current", BooleanType()), ("version", LongType())],
        3: [(f"prev_{c}", batch.schema[c].dataType) for c in tracked] + [("updated_at", TimestampType())],
        4: [("created_at", TimestampType()), ("updated_at", TimestampType())],
        6: [(f"{p}_{c}", batch.schema[c].dataType) for p in ("current", "prev") for c in tracked] + [("valid_from", TimestampType()), ("valid_to", TimestampType()), ("is_current", BooleanType()), ("version", LongType())],
    }[scd_type]
    return StructType([*batch.schema.fields, *[StructField(n, t) for n, t in more]])


def _merged(target: DataFrame, batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return _renamed(target, "_t_", key).join(_renamed(batch, "_s_", key), list(key), "full_outer")


def scd1(target: DataFrame, batch: DataFrame, key: tuple[str, ...], tracked: tuple[str, ...], as_of) -> DataFrame:
    """Overwrites the tracked columns of changed rows; target has created_at and updated_at."""
    rows = _merged(target, batch, key)
    new, both = F.col("_t_there").isNull(), F.col("_t_there") & F.col("_s_there")
    changed = F.coalesce(both & _differs(tracked), F.lit(False))
    columns = []
    for c in target.columns:
        if c in key:
            columns.append(F.col(c))
        elif c == "created_at":
            columns.append(F.when(new, _at(as_of)).otherwise(F.col("_t_created_at")).alias(c))
        elif c == "updated_at":
            columns.append(F.when(new | changed, _at(as_of)).otherwise(F.col("_t_updated_at")).alias(c))
        elif c in batch.columns:
            take = new | changed if c in tracked else new
            columns.append(F.when(take, F.col("_s_" + c)).otherwise(F.col("_t_" + c)).alias(c))
        else:
            columns.append(F.col("_t_" + c).alias(c))
    return rows.select(*columns)


def scd2(history: DataFrame, batch: DataFrame, key: tuple[str, ...], tracked: tuple[str, ...], as_of) -> DataFrame:
    """Closes the current row of changed keys and adds a row with the next version; new keys begin at version 1.

    history: batch's columns, valid_from, valid_to, is_current, version. tracked may be ("row_hash",).
    """
    s = _renamed(batch, "_s_", key)
    h = history.select("*", *[F.col(c).alias("_t_" + c) for c in tracked]).join(s, list(key), "left")
    closes = F.col("is_current") & F.col("_s_there").isNotNull() & _differs(tracked)
    closed = h.select(*[{"valid_to": F.when(closes, _at(as_of)).otherwise(F.col(c)), "is_current": F.col(c) & ~closes}.get(c, F.col(c)).alias(c) if c in ("valid_to", "is_current") else F.col(c) for c in history.columns])
    last = history.groupBy(*key).agg(F.max("version").alias("_version"), *[F.max_by(F.struct(c), "version").alias("_l_" + c) for c in tracked])
    b = batch.select("*", *[F.col(c).alias("_s_" + c) for c in tracked]).join(last, list(key), "left")
    b = b.select("*", *[F.col(f"_l_{c}.{c}").alias("_t_" + c) for c in tracked])
    added = b.filter(F.col("_version").isNull() | _differs(tracked)).select(*batch.columns, _at(as_of).alias("valid_from"), _end().alias("valid_to"), F.lit(True).alias("is_current"), (F.coalesce("_version", F.lit(0)) + 1).cast("long").alias("version"))
    return closed.unionByName(added)


def scd3(target: DataFrame, batch: DataFrame, key: tuple[str, ...], tracked: tuple[str, ...], as_of) -> DataFrame:
    """Keeps one former value: where any tracked column changed, all move to prev_ and take the new values."""
    rows = _merged(target, batch, key)
    new = F.col("_t_there").isNull()
    changed = F.coalesce(F.col("_t_there") & F.col("_s_there") & _differs(tracked), F.lit(False))
    columns = []
    for c in target.columns:
        if c in key:
            columns.append(F.col(c))
        elif c.startswith("prev_") and c[5:] in tracked:
            columns.append(F.when(changed, F.col("_t_" + c[5:])).otherwise(F.col("_t_" + c)).alias(c))
        elif c == "updated_at":
            columns.append(F.when(new | changed, _at(as_of)).otherwise(F.col("_t_updated_at")).alias(c))
        elif c in batch.columns:
            columns.append(F.when(new | changed if c in tracked else new, F.col("_s_" + c)).otherwise(F.col("_t_" + c)).alias(c))
        else:
            columns.append(F.col("_t_" + c).alias(c))
    return rows.select(*columns)


class Archived(NamedTuple):
    current: DataFrame
    history_rows: DataFrame


def scd4(target: DataFrame, batch: DataFrame, key: tuple[str, ...], tracked: tuple[str, ...], as_of) -> Archived:
    """Type 1, and the rows that it overwrites, with snapshot_at, for the history table."""
    t = target.select("*", *[F.col(c).alias("_t_" + c) for c in tracked])
    old = t.join(_renamed(batch, "_s_", key), list(key)).filter(_differs(tracked)).select(*target.columns, _at(as_of).alias("snapshot_at"))
    return Archived(scd1(target, batch, key, tracked, as_of), old)


def scd6(history: DataFrame, batch: DataFrame, key: tuple[str, ...], tracked: tuple[str, ...], as_of) -> DataFrame:
    """Type 2 whose rows also hold the key's latest value (current_c) and the one before theirs (prev_c).

    The new row's prev_c is the closed row's c; current_c changes on all rows of a changed key.
    """
    s = _renamed(batch.select(*key, *tracked), "_s_", key)
    plain = history.drop(*[f"{p}_{c}" for p in ("current", "prev") for c in tracked])
    rows = scd2(plain, batch, key, tracked, as_of)
    old = history.select(*key, "version", *[F.col(f"prev_{c}").alias(f"_p_{c}") for c in tracked], F.lit(True).alias("_old"))
    before = Window.partitionBy(*key).orderBy("version")
    rows = rows.select("*", *[F.lag(c).over(before).alias(f"_lag_{c}") for c in tracked])
    rows = rows.join(old, [*key, "version"], "left").join(s, list(key), "left")
    latest = Window.partitionBy(*key)
    out = [F.col(c) for c in batch.columns]
    out += [F.max_by(c, "version").over(latest).alias(f"current_{c}") for c in tracked]
    out += [F.when(F.col("_old"), F.col(f"_p_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}") for c in tracked]
    return rows.select(*out, "valid_from", "valid_to", "is_current", "version")


def rebuild_intervals(history: DataFrame, events: DataFrame, key: tuple[str, ...], tracked: tuple[str, ...], event_time: str) -> DataFrame:
    """Type 2 history with events put where their event time belongs: late ones split the interval that held them, and
    several of one key become consecutive rows. Rows that repeat the values before them go. Only touched keys are rebuilt.
    """
    columns = [*key, *[c for c in events.columns if c not in key and c != event_time]]
    touched = events.select(*key).distinct()
    points = history.join(touched, list(key), "left_semi").select(*columns, F.col("valid_from").alias("_from"), F.lit(0).alias("_new"))
    points = points.unionByName(events.select(*columns, F.col(event_time).cast("timestamp").alias("_from"), F.lit(1).alias("_new")))
    points = points.groupBy(*key, "_from").agg(F.max(F.struct("_new", *[c for c in columns if c not in key])).alias("_v")).select(*key, "_from", "_v.*")
    order = Window.partitionBy(*key).orderBy("_from")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lag(c).over(order)) for c in tracked])
    first = F.row_number().over(order) == 1
    kept = points.withColumn("_keep", first | ~same).filter("_keep")
    following = F.lead("_from").over(order)
    rebuilt = kept.select(*columns, F.col("_from").alias("valid_from"), F.coalesce(following, _end()).alias("valid_to"), following.isNull().alias("is_current"), F.row_number().over(order).cast("long").alias("version"))
    return history.join(touched, list(key), "left_anti").select(*rebuilt.columns).unionByName(rebuilt)


def valid_at(history: DataFrame, at) -> DataFrame:
    """The rows of history valid at an instant."""
    return history.filter((F.col("valid_from") <= _at(at)) & (F.col("valid_to") > _at(at)))


def as_of_join(facts: DataFrame, history: DataFrame, key: dict[str, str], fact_time: str, *, how: str = "left", slice_days: int = 30) -> DataFrame:
    """facts with the columns of the history row that was valid at fact_time. key: fact column -> history column.

    Facts and versions of a key are one sequence in time, filled forward, so each row is looked at once: no pairs are made.
    A key's sequence is cut into slices of time, each begun by the version that the slices before hand on, so a hot key is
    spread over its slices. A key's versions may not overlap; where they do, the one that began last counts. Facts without a
    time, or with a null in their key, find nothing. Columns that facts have too are named _h_<column>.
    """
    keys, width = [f"_k{i}" for i in range(len(key))], slice_days * 86_400
    shown = [c for c in history.columns if c not in key.values()]
    at = F.col(fact_time).cast("timestamp")
    cut = lambda t: F.floor(F.unix_seconds(t) / width)
    version = F.struct(*[F.col(c) for c in shown], F.col("valid_to").alias("_until"))
    v = history.filter("valid_from < valid_to").select(*[F.col(h).alias(k) for k, h in zip(keys, key.values())], F.col("valid_from").cast("timestamp").alias("_at"), version.alias("_v"))
    f = facts.select(*[F.col(c).alias(k) for k, c in zip(keys, key)], at.alias("_at"), F.struct("*").alias("_f"))
    rows = v.withColumn("_kind", F.lit(0)).unionByName(f.withColumn("_kind", F.lit(1)), allowMissingColumns=True).withColumn("_slice", cut(F.col("_at")))
    ended = F.max_by("_v", F.when(F.col("_kind") == 0, F.struct("_at", "_v._until")))
    slices = rows.groupBy(*keys, "_slice").agg(ended.alias("_last"), F.max("_kind").alias("_facts"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_v", F.last("_last", ignorenulls=True).over(before)).filter("_facts = 1 AND _v IS NOT NULL")
    rows = rows.unionByName(carried.select(*keys, "_slice", "_v", F.lit(-1).alias("_kind")), allowMissingColumns=True)
    sequence = Window.partitionBy(*keys, "_slice").orderBy(F.when(F.col("_kind") >= 0, F.col("_at")).asc_nulls_first(), "_kind", "_v._until").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(sequence)).filter("_kind = 1")
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    filled = filled.withColumn("_v", F.when(whole & (F.col("_at") < F.col("_v._until")), F.col("_v")))
    if how == "inner":
        filled = filled.filter("_v IS NOT NULL")
    return filled.select("_f.*", *[F.col(f"_v.{c}").alias(f"_h_{c}" if c in facts.columns else c) for c in shown])
