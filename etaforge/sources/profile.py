"""Table discovery: columns, keys, value ranges, samples, relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns a conformed order table must have.
REQUIRED_COLUMNS = [
    "order_id",
    "customer_id",
    "store_id",
    "created_at",
    "delivered_at",
    "latitude",
    "longitude",
    "delivery_latitude",
    "delivery_longitude",
    "total",
    "quantity",
]


def profile_table(df: DataFrame, table: str) -> DataFrame:
    """One row per column: type, rows, nulls, min, max, and key facts of id columns.

    Everything but the key facts comes from one shuffle-free aggregate. Distinct values are
    counted only for `id` / `*_id` columns, the key candidates.
    """
    def of(i: int, fact: str) -> str:
        return f"{fact}_{i}"

    facts = [F.count(F.lit(1)).alias("row_count")]
    for i, column in enumerate(df.columns):
        facts += [
            F.count_if(F.col(column).isNull()).alias(of(i, "nulls")),
            F.min(column).cast("string").alias(of(i, "low")),
            F.max(column).cast("string").alias(of(i, "high")),
        ]
    cells = F.array(
        *(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("data_type"),
                F.col(of(i, "nulls")).alias("null_count"),
                F.col(of(i, "low")).alias("min_value"),
                F.col(of(i, "high")).alias("max_value"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        )
    )
    columns = df.agg(*facts).select(F.lit(table).alias("table_name"), "row_count", F.inline(cells))
    keys = [c for c in df.columns if c == "id" or c.endswith("_id")]
    if not keys:
        return columns.withColumn("distinct_count", F.lit(None).cast("long")).withColumn(
            "is_key", F.lit(False)
        )
    pairs = F.array(
        *(F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("v")) for k in keys)
    )
    distinct = (
        df.select(F.inline(pairs))
        .where("v is not null")
        .distinct()
        .groupBy("key_name")
        .agg(F.count(F.lit(1)).alias("distinct_count"))
    )
    unique = (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count"))
    return (
        columns.join(F.broadcast(distinct), F.col("column_name") == F.col("key_name"), "left")
        .drop("key_name")
        .withColumn("is_key", F.coalesce(unique, F.lit(False)))
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [profile_table(df, name) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sample_rows(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """A repeatable sample: the first n rows by `order`."""
    return df.orderBy(*order).limit(n)


def required_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """`(column_name, status, null_count)`: present, missing or extra columns; one aggregate."""
    have = {c.lower(): c for c in df.columns}
    status = {c: "present" if c in have else "missing" for c in required}
    status |= {c: "extra" for c in df.columns if c.lower() not in status}
    nulls = df.agg(
        *(
            F.count_if(F.col(have[c.lower()]).isNull()).alias(c)
            for c in status
            if c.lower() in have
        )
    )
    cells = F.array(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(s).alias("status"),
                (F.lit(None) if s == "missing" else F.col(c)).cast("long").alias("null_count"),
            )
            for c, s in status.items()
        )
    )
    return nulls.select(F.inline(cells))
