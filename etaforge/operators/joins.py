"""Join shapes that hold up under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HOT_ROWS = 1_000_000


def fanout_left_join(
    left: DataFrame, right: DataFrame, on: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """LEFT JOIN where `right` may hold very many rows for one key.

    AQE cannot split the right side of an outer join, so hot keys are salted here: a key with n
    rows on the right gets ceil(n / hot_rows) salts, and only its left rows are repeated, once
    per salt. The hot-key table has at most (rows of `right`) / hot_rows rows, which bounds what
    is broadcast. A hot key matches by definition, so an empty salt of a hot key is no result.
    """
    hot = (
        right.groupBy(on)
        .agg(F.ceil(F.count(F.lit(1)) / hot_rows).cast("int").alias("_salts"))
        .where((F.col("_salts") > 1) & F.col(on).isNotNull())
    )
    salts = F.coalesce("_salts", F.lit(1))
    # Row content plus task number: copies of one row in different tasks get different salts,
    # and a retried task gives each row the same salt again.
    spread = F.xxhash64(*right.columns, F.spark_partition_id())
    salted_right = (
        right.withColumn("_spread", spread)
        .join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.pmod("_spread", salts).cast("int"))
        .withColumn("_matched", F.lit(True))
        .drop("_spread", "_salts")
    )
    salted_left = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return (
        salted_left.join(salted_right, [on, "_salt"], "left")
        .where(F.col("_salts").isNull() | F.col("_matched").isNotNull())
        .drop("_salt", "_salts", "_matched")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` values per key.

    A map-side combined max over (order, row): copies of a key shrink to one before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    picked = df.groupBy(*keys).agg(best).select(*keys, "_best.*")
    return picked.select(*df.columns)


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames, without a cross join."""
    names = [c for frame in one_row_frames for c in frame.columns]
    stacked = one_row_frames[0]
    for frame in one_row_frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*(F.max(name).alias(name) for name in names))
