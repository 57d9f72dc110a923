"""Rules for missing values and unsafe divisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a model sees in place of a missing feature.
MISSING_FEATURE = -1.0


def quantity_or_one(quantity: Column) -> Column:
    """Order quantity in scoring: only NULL becomes 1."""
    return F.coalesce(quantity, F.lit(1)).cast("long")


def request_quantity(quantity: Column) -> Column:
    """Quantity in a scoring request: NULL and 0 both become 1."""
    return F.when(quantity.isNull() | (quantity == 0), F.lit(1)).otherwise(quantity).cast("long")


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole; NULL when `whole` is 0."""
    return F.try_divide(part, whole) * 100


def model_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns as doubles with missing values (NULL and NaN) replaced."""
    return df.withColumns(
        {
            name: F.coalesce(
                F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")),
                F.lit(MISSING_FEATURE),
            )
            for name in features
        }
    )
