"""Point-in-time rolling aggregates.

For every target row: aggregate the history rows of the same key whose event time lies in
`[as_of - window, as_of)`, with `as_of` floored to the second.

A RANGE frame over `partitionBy(key)` would put a key's whole history into one task and re-add
the window for each target. Instead time is cut into spans as long as the window, so that every
window is the tail of one span plus the head of the next:

    span b-1                      span b
    |--------[as_of - w ..........|........ as_of)-------|
             tail: running total    head: running total
             from the span's end    from the span's start

History is first reduced to one row per (key, second); since `as_of` is a whole second, comparing
floored seconds is exact. A task then sees at most the seconds of one (key, span), however many
rows a key has, each row is added a fixed number of times, and the plan is one straight line of
shuffles. Parts are merged, never subtracted, so min and max work as well as sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etaforge.functions.clock import SECONDS_PER_DAY

KINDS = ("count", "mean", "sum", "min", "max", "stddev")


@dataclass(frozen=True)
class Partial:
    """A mergeable piece of an aggregate: how one history row enters, how rows become a piece
    (as pieces merge unless said otherwise), and how pieces merge."""

    name: str
    of_row: Column
    merge: Callable[[Column], Column]
    first: Callable[[Column], Column] | None = None

    def of_rows(self, rows: Column) -> Column:
        return (self.first or self.merge)(rows)


@dataclass(frozen=True)
class Mergeable:
    """An aggregate as its pieces and the value that the merged pieces give, NULL where there are
    none. `result` gets a function from a piece's name to its column. Pieces of one name are shared
    by all aggregates of a pass. Both are functions, as columns exist in a session only."""

    pieces: Callable[[], tuple[Partial, ...]]
    result: Callable[[Callable[[str], Column]], Column]
    whole: bool = False  # a whole number, not a double


def _rows() -> Partial:
    return Partial("n", F.lit(1).cast("long"), F.sum)


def _known() -> Partial:
    return Partial("nv", F.col("value").isNotNull().cast("long"), F.sum)


def _total() -> Partial:
    return Partial("s", F.col("value"), F.sum)


def _spread() -> tuple[Partial, ...]:
    from_center = F.col("value") - F.col("center")
    return _known(), Partial("d", from_center, F.sum), Partial("q", from_center * from_center, F.sum)


def _deviation(piece: Callable[[str], Column]) -> Column:
    n, d, q = piece("nv"), piece("d"), piece("q")
    spread = F.greatest(q - F.try_divide(d * d, n), F.lit(0.0))
    return F.sqrt(F.try_divide(spread, n - 1))


def quantile_aggregate(share: float, k: int = 200) -> Mergeable:
    """A quantile from mergeable KLL sketches of `k`: the rank is off by about 1.65 % of the window's
    rows at k = 200, and by nothing while a window has fewer than k rows. It is a value that occurs."""
    name = f"kll{k}"

    def pieces() -> tuple[Partial, ...]:
        sketch = Partial(
            name, F.col("value"), lambda c: F.kll_merge_agg_double(c, k), lambda c: F.kll_sketch_agg_double(c, k)
        )
        return _known(), sketch

    def result(piece: Callable[[str], Column]) -> Column:
        # Of an empty sketch there is no quantile to ask for.
        return F.kll_sketch_get_quantile_double(F.when(piece("nv") > 0, piece(name)), F.lit(share))

    return Mergeable(pieces, result)


AGGREGATES: dict[str, Mergeable] = {
    "count": Mergeable(lambda: (_rows(),), lambda piece: piece("n"), whole=True),
    "mean": Mergeable(lambda: (_known(), _total()), lambda piece: F.try_divide(piece("s"), piece("nv"))),
    "sum": Mergeable(lambda: (_total(),), lambda piece: piece("s")),
    "min": Mergeable(lambda: (Partial("lo", F.col("value"), F.min),), lambda piece: piece("lo")),
    "max": Mergeable(lambda: (Partial("hi", F.col("value"), F.max),), lambda piece: piece("hi")),
    "stddev": Mergeable(_spread, _deviation),
    "median": quantile_aggregate(0.5),
}


def register_aggregate(kind: str, aggregate: Mergeable) -> None:
    """Make `kind` usable in every rolling aggregate and feature; a known kind cannot be replaced."""
    if kind in AGGREGATES or kind == "distinct":
        raise ValueError(f"aggregate {kind!r} exists")
    AGGREGATES[kind] = aggregate


@dataclass(frozen=True)
class RollingAgg:
    """One output column: `kind` of the value over the last `window_days` days. The kind "distinct"
    counts the different non-null values of the history column `of`."""

    name: str
    kind: str
    window_days: int
    of: str | None = None

    def __post_init__(self) -> None:
        if self.kind != "distinct" and self.kind not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.kind!r}; use one of {(*AGGREGATES, 'distinct')}")
        if (self.kind == "distinct") != (self.of is not None):
            raise ValueError("name the column to count in `of`, for the kind 'distinct' only")
        if self.window_days < 1:
            raise ValueError("window_days must be at least 1")

    @property
    def whole(self) -> bool:
        return self.kind == "distinct" or AGGREGATES[self.kind].whole


def _partials(aggs: list[RollingAgg]) -> list[Partial]:
    """Only the pieces the requested aggregates need, each once."""
    pieces = {p.name: p for agg in aggs for p in AGGREGATES[agg.kind].pieces()}
    return list(({"n": _rows()} | pieces).values())


def _result(agg: RollingAgg) -> Column:
    """Final value from the merged pieces; an empty window gives 0."""
    value = AGGREGATES[agg.kind].result(lambda name: F.col(f"{name}_{agg.window_days}"))
    return F.coalesce(value, F.lit(0.0)).cast("long" if agg.whole else "double").alias(agg.name)


def rolling_features(
    targets: DataFrame,
    history: DataFrame,
    key: str,
    as_of: str,
    event_time: str,
    value: str,
    aggs: list[RollingAgg],
    moments: DataFrame | None = None,
) -> DataFrame:
    """`targets` with one column per aggregate. NULL keys match nothing and get zeros.

    `moments` may name any frame with at least the (key, as_of) pairs of `targets`; give one when
    `targets` is the result of joins that need not run a second time to find those pairs.
    """
    asked = targets if moments is None else moments
    mergeable = [agg for agg in aggs if agg.kind != "distinct"]
    answers = []
    if mergeable:
        windows = sorted({agg.window_days for agg in mergeable})
        parts = _partials(mergeable)
        rows = _with_center(history, key, value) if any(p.name == "q" for p in parts) else history
        seconds = _seconds_with_probes(asked, rows, key, as_of, event_time, value, windows, parts)
        answers.append(_window_answers(seconds, windows, parts).select("k", "t", *map(_result, mergeable)))
    for of in sorted({agg.of for agg in aggs if agg.kind == "distinct"}):
        own = [agg for agg in aggs if agg.kind == "distinct" and agg.of == of]
        answers.append(distinct_answers(asked, history, key, of, as_of, event_time, own))
    out = targets.withColumn("_as_of", F.unix_seconds(as_of))
    for answer in answers:
        answer = answer.withColumnsRenamed({"k": "_k", "t": "_t"})
        out = out.join(answer, (F.col(key) == F.col("_k")) & (F.col("_as_of") == F.col("_t")), "left")
        out = out.drop("_k", "_t")
    filled = {agg.name: F.coalesce(F.col(agg.name), F.lit(0 if agg.whole else 0.0)) for agg in aggs}
    return out.withColumns(filled).drop("_as_of").select(*targets.columns, *(agg.name for agg in aggs))


def distinct_answers(
    targets: DataFrame, history: DataFrame, key: str, of: str, as_of: str, event_time: str, aggs: list[RollingAgg]
) -> DataFrame:
    """k, t and an exact distinct count per aggregate for every (key, as_of second) of the targets.

    A value counts at second t if its last visit before t lies at t - w or later. So a visit at
    second s whose next one (same key and value) is at s' counts for every t in
    [s + 1, min(s', s + w)], and the visits of one value never count twice. The count at t is then a
    running sum of steps: +1 where such an interval begins, -1 behind its end. Intervals are cut at
    span borders (a span is as long as the window), so a running sum starts at 0 in each span and a
    task holds at most the seconds of one (key, span). Next visits are looked up in spans as well: the
    first visit of a span is handed to the span before.
    """
    spans = {agg.window_days * SECONDS_PER_DAY: agg.name for agg in aggs}
    longest = max(spans)
    visits = (
        history.where(F.col(key).isNotNull() & F.col(of).isNotNull() & F.col(event_time).isNotNull())
        .select(F.col(key).alias("k"), F.col(of).alias("v"), F.unix_seconds(event_time).alias("sec"))
        .select("*", F.floor(F.col("sec") / longest).alias("part"))
        .groupBy("k", "v", "part", "sec")
        .agg(F.lit(True).alias("own"))
    )
    heads = visits.groupBy("k", "v", F.col("part") - 1).agg(F.min("sec").alias("sec"))
    heads = heads.toDF("k", "v", "part", "sec").withColumn("own", F.lit(False))
    onward = Window.partitionBy("k", "v", "part").orderBy("sec")
    visits = visits.unionByName(heads).withColumn("next", F.lead("sec").over(onward)).where("own")

    def steps(span: int) -> Column:
        """The interval's part in its first span, and in the next one if it reaches there."""
        first = F.col("sec") + 1
        last = F.least(F.coalesce(F.col("next"), first + span), F.col("sec") + span)
        border = (F.floor(first / span) + 1) * span  # first second of the span after

        def step(at: Column, delta: int) -> Column:
            return F.struct(at.alias("sec"), F.lit(delta).cast("long").alias("delta"))

        return F.array(
            step(first, 1),
            F.when(last + 1 < border, step(last + 1, -1)),
            F.when(last >= border, step(border, 1)),
            F.when(last >= border, step(last + 1, -1)),
        )

    asked_at = targets.where(F.col(key).isNotNull() & F.col(as_of).isNotNull()).select(
        F.col(key).alias("k"), F.unix_seconds(as_of).alias("sec"), F.lit(0).cast("long").alias("delta"), F.lit(True).alias("asked")
    )

    def counts(span: int) -> DataFrame:
        """A pass per window: its steps alone are what an aggregating task holds."""
        changes = visits.select("k", F.explode(F.array_compact(steps(span))).alias("c")).select("k", "c.*", F.lit(False).alias("asked"))
        seconds = changes.unionByName(asked_at).groupBy("k", "sec").agg(
            F.sum("delta").alias("delta"), F.bool_or("asked").alias("asked")
        )
        until = Window.partitionBy("k", F.floor(F.col("sec") / span)).orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
        counted = seconds.withColumn("n", F.sum("delta").over(until)).where("asked")
        own = (F.when(F.lit(span == other), F.col("n")).alias(name) for other, name in spans.items())
        return counted.select("k", F.col("sec").alias("t"), *own)

    return reduce(DataFrame.unionByName, map(counts, spans)).groupBy("k", "t").agg(*(F.max(n).alias(n) for n in spans.values()))


def _with_center(history: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `center`, a middle value of the key. Squares are summed as distances from it: those
    of large values with a small spread would lose the spread."""
    centers = (
        history.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_center_key"))
        .agg(F.percentile_approx(F.col(value).cast("double"), 0.5, 100).alias("center"))
    )
    joined = history.join(centers, F.col(key) == F.col("_center_key"), "left")
    return joined.drop("_center_key")


def _seconds_with_probes(
    targets: DataFrame,
    history: DataFrame,
    key: str,
    as_of: str,
    event_time: str,
    value: str,
    windows: list[int],
    parts: list[Partial],
) -> DataFrame:
    """One row per (window, key, second): merged history pieces and which bounds fall there.

    `marks` is a bit set: 1 is "a target's as_of", 2 is "start of a target's window".
    """
    spans = [days * SECONDS_PER_DAY for days in windows]
    facts = (
        history.where(F.col(key).isNotNull() & F.col(event_time).isNotNull())
        .select(
            F.col(key).alias("k"),
            F.unix_seconds(event_time).alias("sec"),
            F.col(value).cast("double").alias("value"),
            *(["center"] if any(p.name == "q" for p in parts) else []),
        )
        .select(
            F.explode(F.array(*map(F.lit, spans))).alias("span"),
            "k",
            "sec",
            *(p.of_row.alias(p.name) for p in parts),
            F.lit(0).alias("marks"),
        )
    )
    bounds = [
        F.struct(
            F.lit(span).alias("span"), (F.col("t") - shift).alias("sec"), F.lit(mark).alias("marks")
        )
        for span in spans
        for shift, mark in ((0, 1), (span, 2))
    ]
    probes = (
        targets.where(F.col(key).isNotNull() & F.col(as_of).isNotNull())
        .select(F.col(key).alias("k"), F.unix_seconds(as_of).alias("t"))
        .select("k", F.inline(F.array(*bounds)))
    )
    return (
        facts.unionByName(probes, allowMissingColumns=True)
        .groupBy("span", "k", F.floor(F.col("sec") / F.col("span")).alias("part"), "sec")
        .agg(*(p.of_rows(F.col(p.name)).alias(p.name) for p in parts), F.bit_or("marks").alias("marks"))
    )


def _window_answers(seconds: DataFrame, windows: list[int], parts: list[Partial]) -> DataFrame:
    """One row per (key, as_of second) with the merged pieces of every window."""
    in_span = Window.partitionBy("span", "k", "part")
    before = in_span.orderBy(F.col("sec")).rowsBetween(Window.unboundedPreceding, -1)
    onward = in_span.orderBy(F.col("sec").desc()).rowsBetween(Window.unboundedPreceding, 0)
    edges = seconds.select(
        "span",
        "k",
        "sec",
        "marks",
        *(p.merge(F.col(p.name)).over(before).alias(f"{p.name}_head") for p in parts),
        *(p.merge(F.col(p.name)).over(onward).alias(f"{p.name}_tail") for p in parts),
    ).where("marks > 0")

    # Each bound becomes a partial answer for the target second it belongs to.
    def answer(mark: int, t: Column, side: str) -> Column:
        pieces = (F.col(f"{p.name}_{side}").alias(p.name) for p in parts)
        row = F.struct(t.alias("t"), "span", *pieces)
        return F.when(F.col("marks").bitwiseAND(F.lit(mark)) > 0, row)

    answers = F.array_compact(
        F.array(
            answer(1, F.col("sec"), "head"), answer(2, F.col("sec") + F.col("span"), "tail")
        )
    )
    return (
        edges.select("k", F.inline(answers))
        .groupBy("k", "t")
        .agg(
            *(
                p.merge(F.when(F.col("span") == days * SECONDS_PER_DAY, F.col(p.name))).alias(
                    f"{p.name}_{days}"
                )
                for days in windows
                for p in parts
            )
        )
    )


def features_as_of(
    entities: DataFrame,
    history: DataFrame,
    key: str,
    as_of: Column,
    event_time: str,
    value: str,
    window_days: int,
) -> DataFrame:
    """Every entity with `avg_delivery_minutes` and `order_count` at one moment.

    One moment needs no windows: a pushed-down time filter and a map-side combined group-by.
    """
    stats = grouped_window_stats(history, key, as_of, event_time, value, window_days)
    return entities.select(key).join(stats, key, "left").select(
        key,
        F.coalesce("avg_delivery_minutes", F.lit(0.0)).alias("avg_delivery_minutes"),
        F.coalesce("order_count", F.lit(0)).cast("long").alias("order_count"),
    )


def grouped_window_stats(
    history: DataFrame, key: str, as_of: Column, event_time: str, value: str, window_days: int
) -> DataFrame:
    """Average and row count per key over `[as_of - window, as_of)`; keys without rows are absent."""
    end = F.date_trunc("second", as_of)
    start = end - F.make_dt_interval(days=F.lit(window_days))
    return (
        history.where(
            F.col(key).isNotNull() & (F.col(event_time) >= start) & (F.col(event_time) < end)
        )
        .groupBy(key)
        .agg(F.avg(value).alias("avg_delivery_minutes"), F.count(F.lit(1)).alias("order_count"))
    )
