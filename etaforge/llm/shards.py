"""Balanced contiguous shards by global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .common import partitions


def byte_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Contiguous shards in ascending key order whose byte sizes are near equal (law `bytes`).

    A row's size is its UTF-8 bytes plus 1 (null text: 1). Partitions are totalled first, the totals
    (one row per partition) are summed up, and each row goes to the shard its middle byte falls in.
    So a shard misses the equal target by at most one row's size at each end. Equal texts are not
    kept together: one group may hold a third of all bytes. Null keys sort first; repeated rows are
    told apart by size and checksum, then by position, and each keeps its own slot. An empty table
    gives no rows. Columns beyond key and text are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # Range partitions come from a sample, so they are written once and never computed again.
    parts = write_through(
        slim.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
        .withColumn("part", F.spark_partition_id()),
        "shard-parts",
    )
    totals = parts.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base_b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
        F.sum("b").over(Window.partitionBy()).alias("total"),
    )
    own = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    run = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        parts.withColumn("_end", F.sum("size").over(run))
        .withColumn("_rn", F.row_number().over(own) - 1)
        .join(F.broadcast(bases), "part")  # one row per partition
        .withColumn("_mid", (F.col("base_b") + F.col("_end")) * 2 - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (_mid * {shards}) div (2 * total)) as int)"))
        .withColumn("_row", F.col("base_n") + F.col("_rn"))
    )
    placed = write_through(placed.select("doc_id", "size", "text_crc32", "shard", "_row"), "shard-rows")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
