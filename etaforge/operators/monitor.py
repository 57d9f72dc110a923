"""Request and prediction logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etaforge.operators.joins import side_by_side
from etaforge.operators.ranks import exact_quantiles


def request_stats(log: DataFrame) -> DataFrame:
    """Counts, mean latency, p50/p95 latency and mean prediction of successful requests.

    A percentile is the value at 0-based position floor(n * q) of the sorted latencies.
    """
    ok = log.where(F.col("prediction").isNotNull())
    counts = log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count("prediction").alias("successful_requests"),
        F.count("error").alias("error_requests"),
        F.avg(F.when(F.col("prediction").isNotNull(), F.col("latency_ms"))).alias("avg_latency_ms"),
        F.avg("prediction").alias("avg_prediction_minutes"),
    )
    ranks = exact_quantiles(ok, ["latency_ms"], [0.5, 0.95], "index").agg(
        F.max(F.when(F.col("probability") == 0.5, F.col("quantile"))).alias("p50_latency_ms"),
        F.max(F.when(F.col("probability") == 0.95, F.col("quantile"))).alias("p95_latency_ms"),
    )
    return side_by_side(counts, ranks)


def last_rows(log: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n most recent rows; 0 gives none. Each task keeps its own top n, then one merge."""
    return log.orderBy(*(F.col(c).desc() for c in order)).limit(n)
