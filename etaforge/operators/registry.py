"""Declarative features compiled to rolling aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etaforge.operators.pit import RollingAgg, rolling_features

# Allowed ages in seconds by freshness class; None never goes stale.
MAX_AGE = {"realtime": 0, "hourly": 3_600, "daily": 86_400, "static": None}

# Entity of a feature and the order column that identifies it.
ENTITY_KEYS = {"restaurant": "store_id", "customer": "customer_id"}


@dataclass(frozen=True)
class FeatureSpec:
    """A named feature. `aggregation` is "none" for values taken from the order itself, else a kind of
    `RollingAgg`: one of `pit.AGGREGATES`, to which `register_aggregate` adds, or "distinct" with the
    counted history column in `of`."""

    name: str
    entity: str
    aggregation: str = "none"
    window_days: int | None = None
    freshness: str = "static"
    dtype: str = "float"
    version: int = 1
    of: str | None = None

    def rolling(self) -> RollingAgg:
        return RollingAgg(self.name, self.aggregation, self.window_days, self.of)


class Registry:
    """Feature specs by name. Registering a name again replaces it."""

    def __init__(self, specs: list[FeatureSpec] = ()):
        self._specs = {spec.name: spec for spec in specs}

    def register(self, spec: FeatureSpec) -> FeatureSpec:
        self._specs[spec.name] = spec
        return spec

    def select(self, *, entity: str | None = None, aggregated: bool | None = None) -> list[FeatureSpec]:
        return [
            s
            for s in self._specs.values()
            if (entity is None or s.entity == entity)
            and (aggregated is None or (s.aggregation != "none") == aggregated)
        ]

    def compute(
        self, targets: DataFrame, history: DataFrame, keys: dict[str, str] = ENTITY_KEYS
    ) -> DataFrame:
        """All aggregated features for `targets`; the features of one entity share one pass.

        `keys` names the column that identifies each entity; an entity without one raises.
        """
        unknown = {s.entity for s in self.select(aggregated=True)} - keys.keys()
        if unknown:
            raise ValueError(f"no key column for entities {sorted(unknown)}")
        out = targets
        for entity, key in keys.items():
            aggs = [s.rolling() for s in self.select(entity=entity, aggregated=True)]
            if aggs:
                out = rolling_features(
                    out, history, key, "created_at", "delivered_at", "delivery_time_minutes", aggs
                )
        return out

    def metadata(self, spark: SparkSession) -> DataFrame:
        """One row per feature with a hash of its definition."""
        rows = [
            (s.name, s.entity, s.aggregation, s.window_days, s.freshness, s.dtype, s.version, s.of)
            for s in self._specs.values()
        ]
        table = spark.createDataFrame(
            rows,
            "feature_name string, entity string, aggregation string, window_days int, "
            "freshness string, dtype string, version int, of string",
        )
        # to_json leaves NULL fields out, so `of` is part of the hash of distinct counts only.
        definition = F.to_json(F.struct("entity", "aggregation", "window_days", "dtype", "of"))
        return table.withColumn("definition_hash", F.sha2(definition, 256)).drop("of")


# The features every deployment has.
DEFAULT_FEATURES = [
    FeatureSpec("restaurant_avg_delivery_minutes_30d", "restaurant", "mean", 30, "daily"),
    FeatureSpec("restaurant_order_count_30d", "restaurant", "count", 30, "daily", "int"),
    FeatureSpec("restaurant_avg_delivery_minutes_7d", "restaurant", "mean", 7, "daily"),
    FeatureSpec("customer_order_count_30d", "customer", "count", 30, "daily", "int"),
    FeatureSpec("customer_avg_delivery_minutes_30d", "customer", "mean", 30, "daily"),
    FeatureSpec("distance_km", "order"),
    FeatureSpec("hour_of_day", "order", dtype="int"),
    FeatureSpec("day_of_week", "order", dtype="int"),
    FeatureSpec("is_weekend", "order", dtype="bool"),
]

# Model inputs, in vector order.
TRAINING_FEATURES = [
    "restaurant_avg_delivery_minutes_30d",
    "restaurant_order_count_30d",
    "customer_order_count_30d",
    "distance_km",
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "total",
    "quantity",
]

default_registry = Registry(DEFAULT_FEATURES)
AGGREGATED_FEATURES = [s.name for s in default_registry.select(aggregated=True)]
ORDER_FEATURES = [s.name for s in default_registry.select(entity="order")]




def feature_freshness(
    registry: Registry, spark: SparkSession, snapshots: dict[str, DataFrame], now: str
) -> DataFrame:
    """Per feature: last computed time, row count, age and whether its class allows that age.

    `snapshots` maps an entity to its materialized table (`computed_at` column). An order feature
    is computed with the order and never stale; a feature without a snapshot is missing.
    """
    stats = None
    for entity, table in snapshots.items():
        one = table.agg(
            F.max("computed_at").alias("last_computed_at"), F.count(F.lit(1)).alias("snapshot_rows")
        ).withColumn("entity", F.lit(entity))
        latest = table.groupBy("computed_at").agg(F.count(F.lit(1)).alias("row_count"))
        one = one.join(latest, F.col("last_computed_at") == F.col("computed_at"), "left").select(
            "entity", "last_computed_at", "row_count"
        )
        stats = one if stats is None else stats.unionByName(one)
    limits = F.create_map(
        *(F.lit(v) for name, age in MAX_AGE.items() if age is not None for v in (name, age))
    )
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("last_computed_at")
    return (
        registry.metadata(spark)
        .join(stats, "entity", "left")
        .withColumn("age_seconds", age)
        .withColumn(
            "status",
            F.when(F.col("freshness") == "static", "fresh")
            .when(F.col("last_computed_at").isNull(), "missing")
            .when(F.col("age_seconds") <= F.try_element_at(limits, F.col("freshness")), "fresh")
            .otherwise("stale"),
        )
    )
