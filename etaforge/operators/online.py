"""Online feature layout: one row per (entity, feature) with an expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etaforge.operators.pit import features_as_of

TTL_SECONDS = 86_400  # fixed value: one day


def long_features(
    wide: DataFrame,
    entity_type: str,
    key: str,
    features: list[str],
    updated_at: Column,
    ttl_seconds: int | None = TTL_SECONDS,
) -> DataFrame:
    """`(entity_type, entity_id, feature_name, value, updated_at, expires_at)`.

    Without a ttl, or with 0, a value never expires.
    """
    cells = F.array(
        *(
            F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("value"))
            for f in features
        )
    )
    expires = (
        F.timestamp_micros(F.unix_micros("updated_at") + F.lit(ttl_seconds * 1_000_000))
        if ttl_seconds
        else F.lit(None).cast("timestamp")
    )
    return wide.select(
        F.lit(entity_type).alias("entity_type"),
        F.col(key).cast("string").alias("entity_id"),
        F.inline(cells),
        updated_at.alias("updated_at"),
    ).withColumn("expires_at", expires)


def sync_entity(
    entity_type: str,
    entities: DataFrame,
    history: DataFrame,
    key: str,
    as_of: Column,
    window_days: int = 30,
    ttl_seconds: int | None = TTL_SECONDS,
) -> DataFrame:
    """Online rows of all entities of one type at `as_of`."""
    wide = features_as_of(
        entities, history, key, as_of, "delivered_at", "delivery_time_minutes", window_days
    )
    names = {
        "avg_delivery_minutes": f"{entity_type}_avg_delivery_minutes_{window_days}d",
        "order_count": f"{entity_type}_order_count_{window_days}d",
    }
    named = wide.withColumnsRenamed(names)
    return long_features(named, entity_type, key, list(names.values()), as_of, ttl_seconds)


def by_entity(rows: DataFrame, entity_type: str, names: list[str]) -> DataFrame:
    """One row per entity: for each name a struct of the last written value and its expiry.

    A map-side combined group-by. A stream does this once, not per batch.
    """
    written = {n: F.when(F.col("feature_name") == n, F.col("updated_at")) for n in names}
    cell = F.struct("value", "expires_at")
    return (
        rows.where((F.col("entity_type") == entity_type) & F.col("feature_name").isin(names))
        .groupBy("entity_id")
        .agg(*(F.max_by(cell, at).alias(n) for n, at in written.items()))
    )


def lookup_entities(
    requests: DataFrame, entities: DataFrame, key: str, names: list[str], now: Column
) -> DataFrame:
    """`requests` with one column per name; NULL when absent or expired at `now`.

    `entities` has one row per entity, so a hot entity makes only the left side skewed, which
    AQE can split.
    """
    cells = {n: f"_cell_{n}" for n in names}
    keyed = requests.withColumn("_entity", F.col(key).cast("string"))
    joined = keyed.join(
        entities.withColumnsRenamed(cells), F.col("_entity") == F.col("entity_id"), "left"
    )

    def live_value(cell: str) -> Column:
        expires = F.col(f"{cell}.expires_at")
        return F.when(expires.isNull() | (expires > now), F.col(f"{cell}.value"))

    values = {n: live_value(cell) for n, cell in cells.items()}
    return joined.withColumns(values).drop("_entity", "entity_id", *cells.values())


def lookup(
    requests: DataFrame, rows: DataFrame, entity_type: str, key: str, names: list[str], now: Column
) -> DataFrame:
    """`lookup_entities` straight from the long rows."""
    return lookup_entities(requests, by_entity(rows, entity_type, names), key, names, now)


def with_fallback(
    df: DataFrame, cached: str, computed: str, store: list[str], customer: list[str]
) -> DataFrame:
    """Cached values where present, else computed ones.

    The store group is taken from the cache only when its average (first name) is there, the
    customer group only when its count (first name) is. Columns are `{prefix}{name}`.
    """
    chosen = {}
    for group in (store, customer):
        hit = F.col(f"{cached}{group[0]}").isNotNull()
        for name in group:
            chosen[name] = F.when(hit, F.col(f"{cached}{name}")).otherwise(F.col(f"{computed}{name}"))
    helpers = [f"{p}{n}" for p in (cached, computed) for n in (*store, *customer)]
    return df.withColumns(chosen).drop(*helpers)
