"""Exact order statistics without a global sort: quantiles and the two-sample KS statistic.

Both narrow the search with histograms, which combine map-side and shuffle only their bins:

1. Bin every value by a fixed monotone function (about 0.4% wide, any magnitude).
2. Keep only the bins that can hold the answer, and cut each into `FINE_BINS` by its own
   minimum and maximum.
3. Look at single values only inside what is left.

The set of feature columns is given by name, so the tables handed from step to step hold
(features x ranks) or (features x bins) rows, independent of the data size. A value repeated in
any number of rows is one (value, count) pair before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINE_BINS = 16_384


def unpivot_all(df: DataFrame, columns: list[str], keep: list[Column] = ()) -> DataFrame:
    """Long form `(feature, value)` with NaN read as NULL."""
    cells = F.array(
        *(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)
    )
    missing = F.lit(None).cast("double")
    return df.select(*keep, F.inline(cells)).withColumn("value", F.nanvl("value", missing))


def unpivot_numeric(df: DataFrame, columns: list[str], keep: list[Column] = ()) -> DataFrame:
    """`unpivot_all` without missing values."""
    return unpivot_all(df, columns, keep).where(F.col("value").isNotNull())


def coarse_bin(value: Column) -> Column:
    """Monotone bin number: linear near zero, 256 bins per factor e beyond."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * 1e3) * 256)


def fine_bin(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce(F.floor(F.try_divide((value - low) * FINE_BINS, high - low)), F.lit(0))


def _running_end(keys: list[str], order: str, count: str) -> Column:
    return F.sum(count).over(
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )


RANK_KEYS = ["feature", "probability", "position", "rank"]


# --- quantiles -------------------------------------------------------------------------------


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], method: str = "linear"
) -> DataFrame:
    """`(feature, probability, quantile)` for each column.

    `linear` interpolates between neighbours, `nearest` takes the closest rank (ties up), and
    `index` takes the value at 0-based position floor(n * p) of the sorted values.
    """
    values = unpivot_numeric(df, columns)
    histogram = values.groupBy("feature", coarse_bin(F.col("value")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    ranged = histogram.withColumns(
        {
            "end": _running_end(["feature"], "bin", "n"),
            "total": F.sum("n").over(Window.partitionBy("feature")),
        }
    )
    asked = ranged.select("*", F.explode(F.array(*map(F.lit, probabilities))).alias("probability"))
    position = _position(F.col("probability"), F.col("total"), method)
    wanted = (
        asked.withColumn("position", position)
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))))
        .where((F.col("rank") >= F.col("end") - F.col("n")) & (F.col("rank") < F.col("end")))
        .withColumn("local", F.col("rank") - F.col("end") + F.col("n"))
        .select(*RANK_KEYS, "local", "low", "high")
    )

    fine = _narrow(values, wanted).groupBy(
        *RANK_KEYS, "local", fine_bin(F.col("value"), F.col("low"), F.col("high")).alias("bin")
    )
    fine_hits = _hit(
        fine.agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        ),
        "bin",
    )
    singles = (
        _narrow(values, fine_hits.select(*RANK_KEYS, "local", "low", "high"))
        .groupBy(*RANK_KEYS, "local", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    # Both neighbours of an interpolated position, back together.
    fraction = F.first(F.col("position") - F.floor("position"))
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    return (
        _hit(singles, "value")
        .groupBy("feature", "probability")
        .agg((low + (high - low) * fraction).alias("quantile"))
    )


def _position(p: Column, n: Column, method: str) -> Column:
    if method == "linear":
        return p * (n - 1)
    if method == "nearest":
        return F.floor(p * (n - 1) + 0.5).cast("double")
    if method == "index":
        return F.least(F.floor(p * n), n - 1).cast("double")
    raise ValueError(f"unknown quantile method {method!r}")


def _narrow(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values inside the range of some wanted rank. `ranges` has at most features x ranks rows."""
    inside = F.col("value").between(F.col("low"), F.col("high"))
    wanted = F.broadcast(ranges.withColumnRenamed("feature", "_feature"))
    return values.join(wanted, (F.col("feature") == F.col("_feature")) & inside).drop("_feature")


def _hit(groups: DataFrame, order: str) -> DataFrame:
    """The group that holds the wanted rank, with the rank counted from the group's start."""
    end = _running_end(RANK_KEYS, order, "n")
    return (
        groups.withColumn("end", end)
        .where((F.col("local") >= F.col("end") - F.col("n")) & (F.col("local") < F.col("end")))
        .withColumn("local", F.col("local") - F.col("end") + F.col("n"))
    )


# --- Kolmogorov-Smirnov ----------------------------------------------------------------------


def ks_distance(df: DataFrame, columns: list[str], side: str = "side") -> DataFrame:
    """Per feature: `n_ref`, `n_cur`, means and D = max |F_ref - F_cur|.

    `side` is 'ref' or 'cur'. Inside one bin the gap moves by at most the bin's share of either
    side, so a bin whose bound stays below the largest gap seen at any bin edge cannot hold D.
    Only rows of the remaining bins are shuffled.
    """
    is_ref = F.col(side) == "ref"
    sides = [is_ref.cast("long").alias("r"), (~is_ref).cast("long").alias("c")]
    values = unpivot_numeric(df, columns, keep=sides)
    return ks_peaks(values, ks_open_bins(ks_bins(values)))


def ks_bins(values: DataFrame) -> DataFrame:
    """Per feature and coarse bin of `(feature, value, r, c)`: counts, sums and ends of both sides."""

    def total(side: str) -> Column:
        return F.sum(F.when(F.col(side) > 0, F.col(side) * F.col("value")))

    return values.groupBy("feature", coarse_bin(F.col("value")).alias("bin")).agg(
        F.sum("r").alias("r"),
        F.sum("c").alias("c"),
        total("r").alias("sum_ref"),
        total("c").alias("sum_cur"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


KS_FACTS = ["n_ref", "n_cur", "ref_mean", "cur_mean", "edge_max"]


def ks_open_bins(bins: DataFrame) -> DataFrame:
    """Bins that can hold D, with the gap at their start and the facts of their feature."""
    bins = bins.withColumns(
        {
            "r_end": _running_end(["feature"], "bin", "r"),
            "c_end": _running_end(["feature"], "bin", "c"),
        }
    )
    whole = Window.partitionBy("feature")
    bins = bins.withColumns(
        {"n_ref": F.sum("r").over(whole), "n_cur": F.sum("c").over(whole)}
    ).withColumns(
        {
            "start": _gap(F.col("r_end") - F.col("r"), F.col("c_end") - F.col("c")),
            "edge_max": F.max(F.abs(_gap(F.col("r_end"), F.col("c_end")))).over(whole),
            "ref_mean": F.try_divide(F.sum("sum_ref").over(whole), F.col("n_ref")),
            "cur_mean": F.try_divide(F.sum("sum_cur").over(whole), F.col("n_cur")),
        }
    )
    bound = F.greatest(
        F.abs(F.col("start") + F.try_divide("r", "n_ref")),
        F.abs(F.col("start") - F.try_divide("c", "n_cur")),
    )
    first_bin = (F.col("r_end") == F.col("r")) & (F.col("c_end") == F.col("c"))
    # The first bin is kept in any case, so that every feature has a row to carry its facts.
    open_bins = bins.where(first_bin | ((bound > F.col("edge_max")) & (F.col("low") < F.col("high"))))
    return open_bins.select("feature", "bin", "low", "high", "start", *KS_FACTS)


def ks_peaks(values: DataFrame, open_bins: DataFrame) -> DataFrame:
    """D from the values of the open bins: per fine bin, where the gap peaks relative to its own start."""
    facts = KS_FACTS
    counted = (
        values.join(
            F.broadcast(open_bins.withColumnRenamed("feature", "_feature")),  # at most features x coarse bins rows
            (F.col("feature") == F.col("_feature"))
            & (coarse_bin(F.col("value")) == F.col("bin")),
        )
        .groupBy(
            "feature",
            "bin",
            "start",
            *facts,
            fine_bin(F.col("value"), F.col("low"), F.col("high")).alias("fine"),
            "value",
        )
        .agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    )
    step = _gap(F.col("r"), F.col("c"))
    fine_keys = ["feature", "bin", "fine"]
    moved = F.sum("step").over(
        Window.partitionBy(*fine_keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    peaks = (
        counted.withColumn("step", step)
        .withColumn("moved", moved)
        .groupBy(*fine_keys, "start", *facts)
        .agg(
            F.sum("step").alias("step"),
            F.min("moved").alias("lowest"),
            F.max("moved").alias("highest"),
        )
    )
    before = Window.partitionBy("feature", "bin").orderBy("fine").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offset = F.col("start") + F.coalesce(F.sum("step").over(before), F.lit(0.0))
    peak = F.greatest(
        F.abs(F.col("offset") + F.col("lowest")), F.abs(F.col("offset") + F.col("highest"))
    )
    return (
        peaks.withColumn("offset", offset)
        .groupBy("feature", *facts)
        .agg(F.max(peak).alias("peak"))
        .select(
            "feature",
            *facts[:-1],
            F.coalesce(F.greatest("edge_max", "peak"), F.lit(0.0)).alias("d"),
        )
    )


def _gap(r: Column, c: Column) -> Column:
    return F.try_divide(r, F.col("n_ref")) - F.try_divide(c, F.col("n_cur"))


def ks_p_value(d: Column, n_ref: Column, n_cur: Column) -> Column:
    """Asymptotic two-sided p-value. Its alternating series is not usable near 0, where p is 1."""
    lam = d * F.sqrt(n_ref * n_cur / (n_ref + n_cur))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)
    p = F.least(F.greatest(2.0 * total, F.lit(0.0)), F.lit(1.0))
    return F.when(lam < 0.2, 1.0).otherwise(p)
