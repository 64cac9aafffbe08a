"""What the operators on embedding columns share: which vectors count, their whole numbers, and arrays of batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True for a vector that is there and holds neither nulls nor NaN nor infinities."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def whole_numbers(vector: str, scale: int, most: float) -> Column:
    """floor(scale * c) of each component c as a double, in longs; what lies beyond -most or most counts as that."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * float(scale), F.lit(most)), F.lit(-most))))


def id_type(df: DataFrame, id_col: str) -> str:
    return dict(df.dtypes)[id_col]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length and no nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
