"""Late rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Arrivals(NamedTuple):
    on_time: DataFrame
    late: DataFrame


def split_late(df: DataFrame, event_time: str, as_of, window_days: int = 7, *, first_load: bool = False) -> Arrivals:
    """Rows whose event time is before as_of less window_days are late, with a reason; exactly at the cut is on time.

    A null or unreadable time is on time; on the first load everything is.
    """
    at = F.col(event_time) if dict(df.dtypes)[event_time].startswith(("timestamp", "date")) else F.try_to_timestamp(F.col(event_time).cast("string"))
    cut = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(window_days))
    late = F.coalesce(at.cast("timestamp") < cut, F.lit(False)) if not first_load else F.lit(False)
    reason = F.format_string("event time is over %d days old", F.lit(window_days))
    return Arrivals(df.filter(~late), df.filter(late).withColumn("_quarantine_reason", reason).withColumn("_quarantined_at", F.lit(as_of).cast("timestamp")))
