"""Late rows kept and counted: a ledger of the greatest event time of each batch.

Spark drops rows behind the watermark inside a stateful operator and only counts them. Here each
micro-batch is split before any state sees it: rows at or behind the watermark go to a side table,
the others to the job. The watermark follows the rule by which Spark judges late rows (the one the
batch before had: greatest event time of all earlier batches, less the delay, in milliseconds), so
the side table holds what Spark would drop. It comes from a stored ledger, so a replayed batch is split
exactly as it was the first time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from etaforge.streaming.sinks import read_batches, run_batches, store_batch

LEDGER = "rows bigint, late_rows bigint, greatest_ms bigint, watermark_ms bigint"

# Seconds of the units a delay is given in.
UNITS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800}


def delay_ms(delay: str) -> int:
    """Milliseconds of a delay such as "1 hour" or "90 minutes"."""
    found = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", delay.lower())
    if not found or found[2] not in UNITS:
        raise ValueError(f"give the delay as a number and one of {sorted(UNITS)}, not {delay!r}")
    return int(found[1]) * UNITS[found[2]] * 1000


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch: rows, late rows, the batch's greatest event time and the watermark it met."""
    return read_batches(spark, f"{path}/ledger", LEDGER)


def watermark_before(spark: SparkSession, path: str, batch_id: int, delay: str) -> int | None:
    """Watermark that batch `batch_id` meets: that of the batch before, so from all batches but the
    last one before it. None for the first two."""
    row = read_ledger(spark, path).where(F.col("batch_id") < batch_id - 1).agg(F.max("greatest_ms")).first()
    return None if row[0] is None else row[0] - delay_ms(delay)


def run_with_late(
    stream: DataFrame,
    event_time: str,
    handle: Callable[[DataFrame, int], None],
    path: str,
    checkpoint: str,
    delay: str = "1 hour",
) -> StreamingQuery:
    """Run `handle` on the rows of each micro-batch that are in time.

    Below `path`: `late`, the other rows with the watermark they met, and `ledger`. All three
    writes carry the batch id and replace themselves on replay; the ledger is written last, and a
    batch only reads what earlier batches wrote. Rows without an event time are in time.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = watermark_before(spark, path, batch_id, delay)
        at = F.unix_millis(event_time)
        late = F.lit(False) if mark is None else F.coalesce(at <= mark, F.lit(False))
        store_batch(batch.where(late).withColumn("watermark_ms", F.lit(mark).cast("long")), batch_id, f"{path}/late")
        handle(batch.where(~late), batch_id)
        row = batch.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late_rows"), F.max(at).alias("greatest_ms")
        ).withColumn("watermark_ms", F.lit(mark).cast("long"))
        store_batch(row, batch_id, f"{path}/ledger")

    return run_batches(stream, split, checkpoint)


def read_late(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_batches(spark, f"{path}/late", f"{schema}, watermark_ms bigint")
