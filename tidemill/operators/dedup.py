"""Row hashes, duplicates and latest rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: No value reads like it: in values a backslash stands before each backslash and each |.
NULL_TOKEN = "\\N"
_PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "date", "timestamp")


def row_hash(df: DataFrame, columns: tuple[str, ...] = (), null_token: str | None = NULL_TOKEN) -> Column:
    """SHA-256 of the columns (all that do not begin with an underscore, if none are named) joined by |.

    | and backslashes inside values are escaped, so ("a|b", "c") and ("a", "b|c") differ. A null counts as null_token, so
    (a, null, b) and (a, b) differ too; null_token=None leaves nulls out.
    """
    named, kinds = columns or tuple(c for c in df.columns if not c.startswith("_")), dict(df.dtypes)
    texts = [F.col(c).cast("string") for c in named]
    texts = [t if kinds.get(c, "").startswith(_PLAIN) else F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for c, t in zip(named, texts)]
    if null_token is not None:
        texts = [F.coalesce(t, F.lit(null_token)) for t in texts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def with_row_hash(df: DataFrame, columns: tuple[str, ...] = (), **options) -> DataFrame:
    return df.withColumn("row_hash", row_hash(df, columns, **options))


def order_of(df: DataFrame, order_by: str) -> list[Column]:
    """Sort columns of "col DESC, other"; columns that df lacks are left out."""
    found = []
    for part in order_by.split(","):
        m = re.fullmatch(r"\s*(\w+)(?:\s+(asc|desc))?\s*", part, re.IGNORECASE)
        if m is None:
            raise ValueError(f"not an order: {order_by!r}")
        if m[1] in df.columns:
            found.append(F.desc_nulls_last(m[1]) if (m[2] or "").lower() == "desc" else F.asc_nulls_last(m[1]))
    return found


def latest(df: DataFrame, key: tuple[str, ...], order_by: str) -> DataFrame:
    """One row per key, the first in order_by; equal ones are told apart by all columns. Without an order column: df as it is.

    Works as a maximum over structs where the order is one descending column of plain type, so rows are combined before the
    shuffle and a hot key is no hot task.
    """
    order = order_of(df, order_by)
    if not order:
        return df
    lead = re.fullmatch(r"\s*(\w+)\s+desc\s*", order_by, re.IGNORECASE)
    plain = all(not kind.startswith(("map", "variant")) for _, kind in df.dtypes)
    if lead and plain:
        rest = [c for c in df.columns if c not in key and c != lead[1]]
        best = df.groupBy(*key).agg(F.max(F.struct(lead[1], *rest)).alias("_best"))
        return best.select(*[F.col(c) if c in key else F.col(f"_best.{c}").alias(c) for c in df.columns])
    ties = [F.desc_nulls_last(c) for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    rank = Window.partitionBy(*key).orderBy(*order, *ties)
    return df.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def new_by_hash(df: DataFrame, target: DataFrame) -> DataFrame:
    """Rows whose row_hash target lacks."""
    return df.join(target.select("row_hash"), "row_hash", "left_anti").select(*df.columns)


def drop_copies(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["row_hash"])


def duplicate_report(df: DataFrame) -> DataFrame:
    """row_hash, copies of the hashes that occur twice or more."""
    return df.groupBy("row_hash").agg(F.count("*").alias("copies")).filter("copies > 1")


def unique_for_publishing(df: DataFrame, key: tuple[str, ...], order_by: str = "valid_from DESC") -> DataFrame:
    return latest(df, key, order_by)
