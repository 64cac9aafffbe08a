"""Data products: SQL files, and products compiled from a declaration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import latest
from ..sources.tables import publish


def run_sql(spark: SparkSession, text: str, variables: dict[str, str] | None = None, args: dict | None = None) -> DataFrame:
    """A product's SQL without its -- lines, ${NAME} replaced by variables, :name by args."""
    lines = [line for line in text.splitlines() if not line.lstrip().startswith("--")]
    said = re.sub(r"\$\{(\w+)\}", lambda m: (variables or {})[m[1]], "\n".join(lines))
    return spark.sql(said, args=args or {})


def refresh(spark: SparkSession, name: str, folder: str, out: str, variables: dict[str, str] | None = None) -> DataFrame:
    """Writes the product `name` from folder/name.sql, or its source table as it is where there is none."""
    path = Path(folder) / f"{name}.sql"
    df = run_sql(spark, path.read_text(), variables) if path.exists() else spark.table(name)
    publish(df, f"{out}/{name}")
    return spark.read.parquet(f"{out}/{name}")


@dataclass(frozen=True)
class Source:
    """A source of a product. on: its column -> a column of what is joined before it."""

    name: str
    df: DataFrame
    on: dict[str, str] = field(default_factory=dict)
    how: str = "left"
    key: tuple[str, ...] = ()
    order_by: str | None = None
    pii_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class ProductSpec:
    sources: tuple[Source, ...]
    dimensions: tuple[str, ...]
    metrics: dict[str, str]
    filters: tuple[str, ...] = ()


def build(spec: ProductSpec) -> DataFrame:
    """sources joined in turn, filtered, grouped by the dimensions, with the metrics (SQL aggregates) by name.

    Sources with is_current give current rows only; those with a key and an order give the latest row per key. Columns that
    a source declares personal may not be dimensions.
    """
    out = None
    for s in spec.sources:
        df = s.df.filter("is_current") if "is_current" in s.df.columns else s.df
        if s.key and s.order_by:
            df = latest(df, s.key, s.order_by)
        if banned := set(s.pii_fields) & set(spec.dimensions):
            raise ValueError(f"personal columns as dimensions: {sorted(banned)}")
        if out is None:
            out = df
        else:
            condition = [out[theirs] == df[own] for own, theirs in s.on.items()]
            both = [own for own, theirs in s.on.items() if own == theirs]
            out = out.join(df, condition, s.how)
            for c in both:
                out = out.drop(df[c])
    for f in spec.filters:
        out = out.filter(F.expr(f))
    return out.groupBy(*spec.dimensions).agg(*[F.expr(m).alias(n) for n, m in spec.metrics.items()])


def customer_360(customers: DataFrame, orders: DataFrame, payments: DataFrame, *, key: str = "customer_id", order_key: str = "order_id", order_total: str = "total_amount", order_date: str = "order_date", amount: str = "amount") -> DataFrame:
    """Customers with counts, sums and dates of their orders, and sums of the payments of those."""
    per_order = orders.groupBy(key).agg(F.count("*").alias("total_orders"), F.sum(order_total).alias("lifetime_value"), F.avg(order_total).alias("avg_order_value"), F.min(order_date).alias("first_order"), F.max(order_date).alias("last_order"))
    paid = payments.join(orders.select(order_key, key), order_key).groupBy(key).agg(F.count("*").alias("total_payments"), F.sum(amount).alias("total_paid"))
    out = customers.join(per_order, key, "left").join(paid, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_orders", "lifetime_value", "avg_order_value", "total_payments", "total_paid")})


def bands_of_two(column, state, limits: list[tuple[float, str, str]], otherwise: str):
    """The name of the first (least value, state, name) that a pair of columns meets; a null meets none."""
    out = None
    for least, wanted, name in limits:
        meets = (column >= least) & (state == wanted)
        out = F.when(meets, name) if out is None else out.when(meets, name)
    return out.otherwise(otherwise)


def bands(column, limits: list[tuple[float, str]], otherwise: str):
    """The name of the first limit that column reaches."""
    out = None
    for least, name in limits:
        out = F.when(column >= least, name) if out is None else out.when(column >= least, name)
    return out.otherwise(otherwise)
