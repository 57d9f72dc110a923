"""Logarithmic value buckets: a quantile sketch whose state is plain counts.

Bucket i holds the values in (g^(i-1), g^i], g = (1 + a) / (1 - a), and answers 2 g^i / (g + 1), which
is within the share `a` of every value in it. Counts per bucket merge by addition in any order, so
a replay, a restart or another cut into batches gives the same quantile, bit by bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative error of a quantile.
ACCURACY = 0.01
#: Bucket of zero and of anything below the smallest value told apart.
LOWEST = -(2**31)
SMALLEST = 1e-9


def _growth(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def log_bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """Bucket number; NULL for NULL and NaN. Values rise with their buckets."""
    index = F.ceil(F.ln(value) / F.lit(math.log(_growth(accuracy)))).cast("int")
    return F.when(value <= SMALLEST, F.lit(LOWEST)).when(~F.isnan(value), index)


def bucket_value(bucket: Column, accuracy: float = ACCURACY) -> Column:
    """The value that stands for all of a bucket."""
    growth = _growth(accuracy)
    return F.when(bucket == LOWEST, F.lit(0.0)).otherwise(F.pow(F.lit(growth), bucket) * F.lit(2 / (growth + 1)))
