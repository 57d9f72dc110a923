"""Stream plumbing: run what is available, store each batch once, read the latest state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from etaforge.operators.joins import latest_per_key
from etaforge.session import scratch_dir, write_through
from etaforge.sources.keyed import path_exists, replace_partitions


def drain(writer, checkpoint: str) -> StreamingQuery:
    """Process everything available, then stop. The checkpoint makes a restart add nothing."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    partitions: int | None = None,
) -> StreamingQuery:
    """`partitions`: at most so many state partitions of a new query. Each commits files of its own in
    every micro-batch, so a state of few rows wants few; a checkpoint keeps the number it began with."""
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    if partitions is not None:
        conf.set(name, min(partitions, int(before)))
    try:
        return drain(stream.writeStream.outputMode(mode).foreachBatch(handle), checkpoint)
    finally:
        conf.set(name, before)


def store_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch under its own id: a replayed batch replaces itself."""
    replace_partitions(rows.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["batch_id"])


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All stored batches; an empty frame before the first one."""
    ddl = f"{schema}, batch_id bigint"
    if not path_exists(spark, path):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(path)


def read_latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Current value per key of a stored update-mode stream."""
    return latest_per_key(read_batches(spark, path, schema), keys, ["batch_id"]).drop("batch_id")


def arrivals(df: DataFrame, label: str, event_time: str, portions: int = 5) -> Iterator[DataFrame]:
    """`df` as a file stream whose rows arrive in portions of rising event time.

    Yields the stream each time another portion has been written; a job run on it with one
    checkpoint takes one micro-batch per portion, between which the watermark moves. Equal times
    arrive together and NULL times first, so no row comes behind a watermark of any delay.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    rows = write_through(df, f"{label}-rows")
    at = F.unix_micros(event_time)
    shares = [i / portions for i in range(1, portions)]
    cuts = rows.agg(F.percentile_approx(at, shares).alias("cuts")).first()["cuts"] or []
    portion = sum((F.coalesce(at > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    for number in range(portions):
        rows.where(portion == number).write.mode("append").parquet(path)
        yield spark.readStream.schema(df.schema).parquet(path)


def staged(
    df: DataFrame, label: str, event_time: str, portions: int = 5, files: int = 4, cuts: list | None = None
) -> DataFrame:
    """`df` as one file stream that a single query takes in micro-batches of rising event time.

    Each portion is written by a job of its own, as `files` files, and a trigger takes as many, in
    the order in which they were written. `cuts` gives the first times of all portions but the
    first; by default they are quantiles. NULL times come first.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    at = F.unix_micros(event_time)
    if cuts is None:
        rows = write_through(df, f"{label}-rows")
        shares = [i / portions for i in range(1, portions)]
        found = rows.agg(F.percentile_approx(at, shares).alias("cuts")).first()["cuts"] or []
        bounds = [F.lit(cut + 1) for cut in found]
    else:
        rows, bounds = df, [F.unix_micros(F.lit(cut).cast("timestamp")) for cut in cuts]
    portion = sum((F.coalesce(at >= bound, F.lit(False)).cast("int") for bound in bounds), F.lit(0))
    return staged_parts(rows, portion, len(bounds) + 1, path, files)


def staged_parts(rows: DataFrame, portion, portions: int, path: str, files: int = 4) -> DataFrame:
    """As `staged`, with the number of the portion given as a column."""
    for number in range(portions):
        part = rows.where(portion == number).repartition(files)
        part.write.mode("append").parquet(path)
    stream = rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
    return stream.parquet(path)


def dropped_late(query: StreamingQuery) -> int:
    """Rows behind the watermark, over the recent progress reports of a query."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )
