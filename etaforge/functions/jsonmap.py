"""Feature maps as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_features(columns: list[str]) -> Column:
    """One JSON object per row; NULL features are kept as explicit nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def decode_features(text: Column, schema: T.StructType | str) -> Column:
    return F.from_json(text, schema)
