"""Jobs with keyed state of their own: order closures with event-time timers, last-N rows per model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from etaforge.streaming.jobs import DEFAULT_DELAY, MONITOR, STEPS, last_per_model
from etaforge.streaming.sinks import read_batches, run_batches, store_batch

# --- order closures --------------------------------------------------------------------------

CLOSURES = (
    "order_id bigint, customer_id bigint, total bigint, driver_id bigint, "
    + ", ".join(f"{step}_at timestamp" for step in STEPS)
    + ", outcome string, closed_at timestamp"
)
#: Open orders of a group, one place each: per step the first time in microseconds (`NEVER` without one),
#: the payloads, and the latest event's time.
TIMES = [f"{step}_us" for step in STEPS]
OPEN_ORDERS = ", ".join(f"{c} array<bigint>" for c in ("order_id", *TIMES, "customer_id", "total", "driver_id", "last_us"))
#: Groups of orders by the hash of their id, about four a state partition; more serve a larger cluster.
GROUPS = 128
NEVER = np.iinfo(np.int64).max
NO_TIME = np.datetime64("NaT").astype(np.int64)
PAYLOAD = {"customer_id": "placed", "total": "placed", "driver_id": "assigned"}


def step_rows(events: DataFrame) -> DataFrame:
    """Events as rows that any task may shrink: order, step, microseconds and payload."""
    return events.select(
        "order_id", "event_type", "event_at", F.unix_micros("event_at").alias("us"), *PAYLOAD
    ).where(F.col("order_id").isNotNull() & F.col("event_at").isNotNull() & F.col("event_type").isin(*STEPS))


def shrink(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last event of each (order, step) of a batch of rows: repeats never reach the order's task."""
    for rows in parts:
        rows = rows.sort_values(["order_id", "event_type", "us"], kind="stable")
        same = ["order_id", "event_type"]
        yield rows[~rows.duplicated(same, keep="first") | ~rows.duplicated(same, keep="last")]


def merge_events(state: dict, parts: list[pd.DataFrame]) -> tuple[dict, np.ndarray]:
    """The open orders with a batch's events folded in, by rising id, and which of them had events."""
    events = pd.concat(parts) if len(parts) > 1 else parts[0]
    order, us = events["order_id"].to_numpy(np.int64), events["us"].to_numpy(np.int64)
    kind = events["event_type"].to_numpy()
    ids = np.union1d(state["order_id"], order)
    size, held, at = len(ids), np.searchsorted(ids, state["order_id"]), np.searchsorted(ids, order)
    out = {"order_id": ids} | {c: np.full(size, NEVER) for c in TIMES}
    out |= {c: pd.array([None] * size, dtype="Int64") for c in PAYLOAD} | {"last_us": np.full(size, -NEVER)}
    for column, values in state.items():
        out[column][held] = values
    by_time = np.argsort(us, kind="stable")
    for step, times in zip(STEPS, TIMES, strict=True):
        own = by_time[kind[by_time] == step]
        own = own[np.unique(at[own], return_index=True)[1]]  # an order's first event of the step
        own = own[us[own] < out[times][at[own]]]
        out[times][at[own]] = us[own]
        for column in (c for c, source in PAYLOAD.items() if source == step):
            values = pd.array(events[column].iloc[own].tolist(), dtype="Int64")
            known = ~values.isna()
            out[column][at[own][known]] = values[known]
    np.maximum.at(out["last_us"], at, us)
    touched = np.zeros(size, bool)
    touched[at] = True
    return out, touched


def close_orders(timeout_us: int, grace_us: int):
    """State function of a group of orders: folds their events and gives a row for each that is due.

    An order is due `grace` after the delivery or cancellation, so events out of order still
    count, or `timeout` after the latest event of an order that has neither. The timer of the
    group stands at its first due order.
    """

    def closed(orders: dict, ends: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        cancelled = orders["cancelled_us"] <= orders["delivered_us"]
        outcome = np.where(ends == NEVER, "abandoned", np.where(cancelled, "cancelled", "delivered"))
        times = {f"{step}_at": orders[us] for step, us in zip(STEPS, TIMES, strict=True)} | {"closed_at": at}
        times = {c: np.where(us == NEVER, NO_TIME, us).view("datetime64[us]") for c, us in times.items()}
        return pd.DataFrame({c: orders[c] for c in ("order_id", *PAYLOAD)} | times | {"outcome": outcome})

    def fold(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in OPEN_ORDERS.split(", ")]
        state = dict(zip(columns, held.get if held.exists else [[]] * len(columns), strict=True))
        state = {c: pd.array(v, dtype="Int64") if c in PAYLOAD else np.array(v, np.int64) for c, v in state.items()}
        touched = np.zeros(len(state["order_id"]), bool)
        if not held.hasTimedOut:
            state, touched = merge_events(state, list(parts))
        ends = np.minimum(state["delivered_us"], state["cancelled_us"])
        ended, watermark_ms = ends != NEVER, held.getCurrentWatermarkMs()
        at = np.where(ended, ends, state["last_us"] + timeout_us)
        due_ms = -(-np.where(ended, at + grace_us, at) // 1000)
        due = np.where(touched, due_ms <= watermark_ms, due_ms < watermark_ms)
        left = {c: v[~due] for c, v in state.items()}
        if len(left["order_id"]):
            held.update(tuple([None if pd.isna(x) else int(x) for x in v] if c in PAYLOAD else v.tolist() for c, v in left.items()))
            held.setTimeoutTimestamp(max(int(due_ms[~due].min()), watermark_ms + 1))
        elif held.exists:
            held.remove()
        if due.any():
            yield closed({c: v[due] for c, v in state.items()}, ends[due], at[due])

    return fold


def order_closures(
    events: DataFrame, timeout_hours: int = 48, grace_hours: int = 1, delay: str = DEFAULT_DELAY, groups: int = GROUPS
) -> DataFrame:
    """A stream of closed orders: lifecycle times, `outcome` (delivered, cancelled, abandoned) and
    `closed_at`. The state holds open orders only, dealt by a hash of the id to `groups` groups that
    are folded as whole columns; a call of Python an order would take most of the time. Of a hot
    order at most two events per step and Arrow batch reach its task."""
    rows = step_rows(events).mapInPandas(shrink, step_rows(events).schema).withWatermark("event_at", delay)
    group = F.pmod(F.xxhash64("order_id"), F.lit(groups)).cast("int")
    hour = 3_600_000_000
    return rows.withColumn("group", group).groupBy("group").applyInPandasWithState(
        close_orders(timeout_hours * hour, grace_hours * hour), CLOSURES, OPEN_ORDERS, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_order_closures(events: DataFrame, path: str, checkpoint: str, groups: int = GROUPS, **limits) -> StreamingQuery:
    return run_batches(
        order_closures(events, groups=groups, **limits), lambda rows, batch_id: store_batch(rows, batch_id, path),
        checkpoint, partitions=max(groups // 4, 1),
    )


def read_closures(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, CLOSURES).drop("batch_id")


# --- last-N rows per model -------------------------------------------------------------------

NEWEST = ("prediction_timestamp", "order_id")
KEPT = "us array<bigint>, order_id array<bigint>, prediction array<double>, actual array<double>"


def keep_newest(n: int, ttl_us: int | None):
    """State function of one (model, salt): its n newest rows. With a time-to-live, rows older than
    that at the watermark go, and a group without newer rows goes as a whole."""

    def clean(values: Iterable) -> list:
        return [None if pd.isna(v) else v for v in values]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        if held.exists:
            rows = list(zip(*held.get, strict=True))
        for part in [] if held.hasTimedOut else parts:
            new = zip(part["us"].tolist(), part["order_id"].tolist(), clean(part["prediction"]), clean(part["actual"]), strict=True)
            rows = sorted([*rows, *new], key=lambda r: r[:2], reverse=True)[:n]
        if ttl_us is not None:
            rows = [r for r in rows if r[0] > held.getCurrentWatermarkMs() * 1000 - ttl_us]
        if rows:
            held.update(tuple(list(c) for c in zip(*rows, strict=True)))
            if ttl_us is not None:  # the oldest row's end, at least the next millisecond
                held.setTimeoutTimestamp(max((rows[-1][0] + ttl_us) // 1000, held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        size = max(len(rows), 1)  # a group that is gone says so with a row without an order
        out = pd.DataFrame({"model_version": [key[0]] * size, "salt": [key[1]] * size})
        us, ids, made, actual = zip(*rows, strict=True) if rows else ([0], [None], [None], [None])
        out["order_id"] = pd.array(ids, "Int64")
        out["prediction_timestamp"] = pd.to_datetime(pd.Series(us, dtype="int64"), unit="us")
        out["prediction"], out["actual"] = pd.array(made, "Float64"), pd.array(actual, "Float64")
        yield out

    return fold


def newest_rows(
    log: DataFrame, n: int = 1000, salts: int = 16, ttl_days: int | None = None, delay: str = DEFAULT_DELAY
) -> DataFrame:
    """Updates of the kept rows of each (model, salt). A model is spread over `salts` groups by
    order, so one with most of the rows has no task of its own; the state is n rows per group."""
    rows = log.withColumns({"us": F.unix_micros("prediction_timestamp"), "salt": F.pmod(F.xxhash64("order_id"), F.lit(salts)).cast("int")})
    rows = rows.where("model_version is not null and order_id is not null and us is not null")
    timeout = GroupStateTimeout.NoTimeout
    if ttl_days is not None:
        rows, timeout = rows.withWatermark("prediction_timestamp", delay), GroupStateTimeout.EventTimeTimeout
    out = MONITOR.replace("model_version string, ", "model_version string, salt int, ")
    fold = keep_newest(n, None if ttl_days is None else ttl_days * 86_400_000_000)
    return rows.groupBy("model_version", "salt").applyInPandasWithState(fold, out, KEPT, "update", timeout)


def stream_newest(log: DataFrame, path: str, checkpoint: str, n: int = 1000, **limits) -> StreamingQuery:
    """Store what each changed group keeps after each batch."""
    columns = [c.split()[0] for c in MONITOR.split(", ")]
    return run_batches(
        newest_rows(log.select(*columns), n, **limits), lambda rows, batch_id: store_batch(rows, batch_id, path),
        checkpoint, "update",
    )


def read_newest(spark: SparkSession, path: str, n: int = 1000) -> DataFrame:
    """The n newest rows per model: the latest state of each (model, salt), merged once more."""
    rows = read_batches(spark, path, f"salt int, {MONITOR}")
    latest = rows.groupBy("model_version", "salt").agg(F.max("batch_id").alias("batch_id"))
    kept = rows.join(latest, ["model_version", "salt", "batch_id"]).where("order_id is not null")
    return last_per_model(kept.drop("salt", "batch_id"), n)
