"""Drift detection from a stored reference, which is opened only where single values decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etaforge.operators import drift
from etaforge.operators.ranks import coarse_bin, ks_bins, ks_open_bins, ks_peaks, unpivot_numeric
from etaforge.session import write_through

#: Coarse bins per stored folder: values of one folder lie within 28 % of each other.
CELL = 64
VALUES = "bin long, value double, n long, feature string, cell long"
BINS = "feature string, bin long, n long, total double, low double, high double"


def _cell(bin_no: Column) -> Column:
    return F.floor(bin_no / CELL)


def fit(reference: DataFrame, columns: list[str], path: str) -> None:
    """Store the reference sample at `path`: `values` holds each distinct value with its count, in
    folders by feature and magnitude, and `bins` the counts, sums and ends of the coarse bins.

    A column without values is stored with count 0. `path` must not exist yet.
    """
    spark = reference.sparkSession
    columns = [c for c in columns if c in reference.columns]
    counted = (
        unpivot_numeric(reference, columns)
        .groupBy("feature", coarse_bin(F.col("value")).alias("bin"), "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("cell", _cell(F.col("bin")))
    )
    # By value, so that the writers of a frequent magnitude are as many as its distinct values need.
    ordered = counted.repartitionByRange("feature", "bin", "value").sortWithinPartitions("feature", "bin", "value")
    ordered.write.partitionBy("feature", "cell").parquet(f"{path}/values")
    bins = (
        _stored_values(spark, path)
        .groupBy("feature", "bin")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("value")).alias("total"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
    )
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("feature"))
    known.join(bins, "feature", "left").fillna(0, ["n"]).write.parquet(f"{path}/bins")


def _stored_values(spark, path: str) -> DataFrame:
    return spark.read.schema(VALUES).parquet(f"{path}/values")


def detect(current: DataFrame, path: str) -> DataFrame:
    """KS and PSI of `current` against the reference stored at `path`: the rows that
    `drift.check_all_features` gives for both samples, for the columns both have.

    The current sample is read in full, twice; of the reference the bins, and single values of bins that can
    hold the greatest gap or that an edge between two PSI bins cuts.
    """
    spark = current.sparkSession
    stored = spark.read.schema(BINS).parquet(f"{path}/bins")
    # One row per column of the sample.
    features = sorted(r.feature for r in stored.select("feature").distinct().collect() if r.feature in current.columns)
    fresh = unpivot_numeric(current, features).select(
        "feature", "value", F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("c")
    )
    old = stored.where(F.col("feature").isin(features) & (F.col("n") > 0)).select(
        "feature", "bin", F.col("n").alias("r"), F.lit(0).cast("long").alias("c"),
        F.col("total").alias("sum_ref"), F.lit(None).cast("double").alias("sum_cur"), "low", "high",
    )
    sums = [F.sum(name).alias(name) for name in ("r", "c", "sum_ref", "sum_cur")]
    both = ks_bins(fresh).unionByName(old).groupBy("feature", "bin")
    bins = write_through(both.agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")), "drift-bins")
    gaps = write_through(ks_open_bins(bins), "drift-open")

    ranges = bins.groupBy("feature").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("r").alias("n_ref"),
        F.sum("c").alias("n_cur"),
        F.try_divide(F.sum("sum_ref"), F.sum("r")).alias("reference_mean"),
        F.try_divide(F.sum("sum_cur"), F.sum("c")).alias("current_mean"),
    )
    ends = F.broadcast(ranges.select("feature", F.col("low").alias("least"), F.col("high").alias("most")))
    first, last = (drift.psi_bin(F.col(end), F.col("least"), F.col("most")) for end in ("low", "high"))
    placed = bins.join(ends, "feature").withColumns({"first": first, "last": last})
    cut = placed.where("first <> last").select("feature", "bin", "least", "most")

    values = _values_of(fresh, path, gaps.select("feature", "bin").union(cut.select("feature", "bin")).distinct())
    in_cut = values.join(F.broadcast(cut), ["feature", "bin"])  # at most features x PSI bins rows
    parts = placed.where("first = last").select("feature", F.col("first").alias("bin"), "r", "c").unionByName(
        in_cut.select("feature", drift.psi_bin(F.col("value"), F.col("least"), F.col("most")).alias("bin"), "r", "c")
    )
    counts = parts.groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    ks = drift.ks_results(ks_peaks(values.drop("bin"), gaps))
    return ks.unionByName(drift.psi_results(drift.psi_scores(ranges, counts)))


def _values_of(fresh: DataFrame, path: str, opened: DataFrame) -> DataFrame:
    """Distinct values of the opened bins with their counts on both sides.

    The folders to read go into the scan as literals: at most columns x magnitudes pairs. The opened
    bins are at most columns x coarse bins rows.
    """
    spark = fresh.sparkSession
    opened = write_through(opened, "drift-opened")
    cells: dict[str, list[int]] = {}
    for row in opened.select("feature", _cell(F.col("bin")).alias("cell")).distinct().collect():
        cells.setdefault(row.feature, []).append(row.cell)
    wanted = reduce(
        lambda a, b: a | b,
        [(F.col("feature") == f) & F.col("cell").isin(sorted(c)) for f, c in sorted(cells.items())],
        F.lit(False),
    )
    old = _stored_values(spark, path).where(wanted).select(
        "feature", "bin", "value", F.col("n").alias("r"), F.lit(0).cast("long").alias("c")
    )
    new = fresh.select("feature", coarse_bin(F.col("value")).alias("bin"), "value", "r", "c")
    inside = old.unionByName(new).join(F.broadcast(opened), ["feature", "bin"], "left_semi")
    found = inside.groupBy("feature", "bin", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    return write_through(found, "drift-values")
