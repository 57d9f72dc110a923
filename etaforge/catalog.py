"""The registered queries: each operator run over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etaforge.functions import clock, guards
from etaforge.functions.geo import haversine_km
from etaforge.functions.jsonmap import decode_features, encode_features
from etaforge.operators import accuracy, drift, fitted, monitor, online, validate
from etaforge.operators.conform import (
    candidate_relationships,
    conform_orders,
    relationship_coverage,
)
from etaforge.operators.joins import latest_per_key
from etaforge.operators.pit import RollingAgg, features_as_of
from etaforge.operators.registry import (
    DEFAULT_FEATURES,
    TRAINING_FEATURES,
    FeatureSpec,
    Registry,
    default_registry,
    feature_freshness,
)
from etaforge.plans import features as feats
from etaforge.plans import materialize, model, scoring, tiles
from etaforge.session import pin_utc, scratch_dir, write_through
from etaforge.sources import commerce, history, keyed, profile
from etaforge.streaming import jobs, late, sinks
from etaforge.streaming import keyed as keyed_state

AS_OF = "2000-06-01 00:00:00"
DRIFT_SPLIT = "1998-04-01 00:00:00"
EVENT_SPLIT = "2024-01-21 00:00:00"
STORED_AT = {"rule-1": "2024-01-02 00:00:00", "rule-2": "2024-01-03 00:00:00"}
# The test data spread few orders over six years; days would make thousands of tiny files.
PERIOD = "year"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(fn: Query) -> Query:
    """Register under the function's name, less a `_query` that keeps it apart from the operator
    of that name; results have zone-free timestamps."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        return _without_zone(fn(pin_utc(spark), root))

    QUERIES[fn.__name__.removesuffix("_query")] = run
    return fn


def _without_zone(df: DataFrame) -> DataFrame:
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _named_tables(spark, root) -> dict[str, DataFrame]:
    t = commerce.tables(spark, root)
    return {"orders": t.orders, "stores": t.stores, "order_items": t.order_items}


# --- scans and scalar functions --------------------------------------------------------------


@registered
def scan_orders(spark, root):
    return commerce.orders(spark, root)


@registered
def table_profile(spark, root):
    return profile.profile_tables(_named_tables(spark, root))


@registered
def table_sample(spark, root):
    return profile.sample_rows(commerce.orders(spark, root), ["order_id"])


@registered
def required_columns(spark, root):
    return profile.required_columns(commerce.orders(spark, root))


@registered
def csv_roundtrip(spark, root):
    tables = _named_tables(spark, root)
    paths = keyed.export_csv(tables, scratch_dir(spark, "csv"))
    sums = {"orders": "total", "stores": "store_id", "order_items": "quantity"}
    out = None
    for name, path in paths.items():
        back = keyed.read_csv(spark, path, tables[name].schema)
        one = back.agg(
            F.count(F.lit(1)).alias("row_count"), F.sum(sums[name]).alias("checksum")
        ).select(F.lit(name).alias("table_name"), "row_count", "checksum")
        out = one if out is None else out.unionByName(one)
    return out


@registered
def order_distance(spark, root):
    t = commerce.tables(spark, root)
    located = feats.with_store_location(t.orders, t.stores)
    distance = haversine_km(
        F.col("latitude"), F.col("longitude"), F.col("delivery_latitude"), F.col("delivery_longitude")
    )
    return located.select("order_id", F.round(distance, 6).alias("distance_km"))


@registered
def order_time_features(spark, root):
    at = F.col("created_at")
    return commerce.orders(spark, root, with_store=False).select(
        "order_id",
        clock.hour_of_day(at).alias("hour_of_day"),
        clock.day_of_week(at).alias("day_of_week"),
        clock.is_weekend(at).alias("is_weekend"),
    )


@registered
def delivery_minutes(spark, root):
    rows = feats.delivered(commerce.orders(spark, root, with_store=False))
    return _round(rows.select("order_id", "delivery_time_minutes"), "delivery_time_minutes")


@registered
def training_base(spark, root):
    """The newest order is left out: the end of the range is the latest creation time."""
    orders = commerce.orders(spark, root)
    newest = feats.latest_creation(commerce.orders(spark, root, with_store=False))
    base = feats.training_base(orders, "1995-01-01 00:00:00", newest)
    return _round(
        base.select("order_id", "customer_id", "store_id", "created_at", "delivery_time_minutes"),
        "delivery_time_minutes",
    )


@registered
def confirmed_orders(spark, root):
    return scoring.confirmed_orders(commerce.tables(spark, root))


@registered
def confirmed_orders_limit(spark, root):
    return scoring.confirmed_orders(commerce.tables(spark, root), limit=50)


@registered
def null_policies(spark, root):
    t = commerce.tables(spark, root)
    orders = commerce.orders(spark, root, with_store=False)
    rows = orders.join(feats.order_quantities(t.order_items), "order_id", "left").withColumns(
        {
            "minutes": F.round(
                clock.elapsed_minutes(F.col("created_at"), F.col("confirmed_at")), 6
            ),
            "asked": F.when(F.col("quantity") % 10 == 0, 0).otherwise(F.col("quantity")),
        }
    )
    rows = rows.withColumn("model_input", F.col("minutes"))
    return guards.model_inputs(rows, ["model_input"]).select(
        "order_id",
        guards.quantity_or_one(F.col("quantity")).alias("quantity_or_one"),
        guards.request_quantity(F.col("asked")).alias("request_quantity"),
        guards.zero_if_null(F.col("minutes")).alias("zero_if_null"),
        "model_input",
    )


@registered
def features_json_roundtrip(spark, root):
    tf = feats.training_features(commerce.tables(spark, root))
    text = encode_features(feats.feature_columns())
    schema = (
        "restaurant_avg_delivery_minutes_30d double, restaurant_order_count_30d bigint, "
        "distance_km double, is_weekend boolean, quantity bigint"
    )
    f = decode_features(text, schema)
    return _round(
        tf.select("order_id", f.alias("f")).select(
            "order_id",
            F.col("f.restaurant_avg_delivery_minutes_30d").alias("avg_minutes"),
            F.col("f.restaurant_order_count_30d").alias("store_count"),
            "f.distance_km",
            "f.is_weekend",
            "f.quantity",
        ),
        "avg_minutes",
        "distance_km",
    )


@registered
def parse_created_at(spark, root):
    orders = commerce.orders(spark, root, with_store=False)
    bad = F.array(*map(F.lit, ("not-a-date", "2024", "T10:00", "10:00", "2024-13-01T00:00:00")))
    text = F.when(
        F.col("order_id") % 11 == 0, F.get(bad, (F.col("order_id") % 5).cast("int"))
    ).otherwise(clock.format_iso(F.col("created_at")))
    parsed = clock.parse_iso(F.col("text"))
    return orders.withColumn("text", text).select(
        "order_id",
        parsed.alias("created_at"),
        F.when(parsed.isNull(), "bad creation time").alias("reason"),
        clock.format_iso(parsed).alias("iso_text"),
    )


def _batch_requests(orders: DataFrame, times: Column) -> DataFrame:
    """Chunks of batch requests with two orders each: an order, and a repeat of it under another
    id and without a quantity. A request is made of the chunks of 20 consecutive orders."""

    def order(number: Column, quantity: Column) -> Column:
        return F.struct(
            number.alias("order_id"),
            "customer_id",
            "store_id",
            "latitude",
            "longitude",
            "delivery_latitude",
            "delivery_longitude",
            "total",
            quantity.alias("quantity"),
            times.alias("created_at"),
        )

    number, nothing = F.col("order_id"), F.lit(None).cast("long")
    pair = F.array(order(number, number % 4), order(-number - 1, nothing))
    return orders.select(F.floor(number / 20).alias("request_id"), pair.alias("orders"))


def _located_orders(spark, root) -> DataFrame:
    t = commerce.tables(spark, root)
    return feats.with_store_location(t.orders, t.stores)


@registered
def explode_requests(spark, root):
    """Every order's own time is valid here; bad times are the subject of `batch_outcome`."""
    requests = _batch_requests(_located_orders(spark, root), clock.format_iso(F.col("created_at")))
    return scoring.explode_requests(requests).select(
        "request_id", "order_id", "customer_id", "total", "quantity", "created_at"
    )


def _checked_requests(spark, root) -> DataFrame:
    rules = scoring.scoring_rules()
    rules = {k: rules[k] for k in ("no creation time", "no coordinates")}
    times = F.when(F.col("order_id") % 11 == 0, "not-a-date").otherwise(
        clock.format_iso(F.col("created_at"))
    )
    requests = _batch_requests(_located_orders(spark, root), times)
    return validate.with_reasons(scoring.explode_requests(requests), rules)


@registered
def batch_outcome(spark, root):
    return validate.batch_outcome(_checked_requests(spark, root), "request_id")


@registered
def batch_errors(spark, root):
    return validate.rejected_rows(_checked_requests(spark, root)).select(
        "request_id", "order_id", F.element_at("reasons", 1).alias("error")
    )


# --- joins -----------------------------------------------------------------------------------

MAPPING = {
    "order_id": "orders.order_id",
    "customer_id": "orders.customer_id",
    "store_id": "stores.store_id",
    "created_at": {"maps_to": "orders.created_at"},
    "delivered_at": "orders.delivered_at",
    "latitude": "stores.latitude",
    "longitude": "stores.longitude",
    "delivery_latitude": "orders.delivery_latitude",
    "delivery_longitude": "orders.deliverY_longitude",
    "total": "orders.total",
    "quantity": "order_items.quantity",
}


@registered
def conform_orders_query(spark, root):
    return conform_orders(_named_tables(spark, root), MAPPING, view="orders_conformed")


@registered
def training_join_item_grain(spark, root):
    t = commerce.tables(spark, root)
    located = feats.with_store_location(feats.delivered(t.orders), t.stores)
    rows = feats.with_items(located.select("order_id", "store_id", "latitude"), t.order_items)
    return _round(rows.select("order_id", "store_id", "quantity", "latitude"), "latitude")


@registered
def order_quantity(spark, root):
    orders = commerce.orders(spark, root, with_store=False)
    rows = feats.with_quantity(orders, commerce.order_items(spark, root))
    return rows.select("order_id", "quantity")


@registered
def relationship_coverage_query(spark, root):
    tables = _named_tables(spark, root)
    found = candidate_relationships({name: df.columns for name, df in tables.items()})
    return relationship_coverage(tables, found)


# --- point-in-time features ------------------------------------------------------------------


def _targets_and_history(spark, root) -> tuple[DataFrame, DataFrame]:
    history = feats.delivered(commerce.orders(spark, root))
    return history.select("order_id", "store_id", "customer_id", "created_at"), history


@registered
def pit_store_features(spark, root):
    out = feats.with_store_history(*_targets_and_history(spark, root))
    names = ["restaurant_avg_delivery_minutes_30d", "restaurant_order_count_30d"]
    return _round(out.select("order_id", *names), names[0])


@registered
def pit_customer_features(spark, root):
    targets, history = _targets_and_history(spark, root)
    out = feats.with_customer_history(targets, history)
    names = ["customer_avg_delivery_minutes_30d", "customer_order_count_30d"]
    return _round(out.select("order_id", *names), names[0])


@registered
def rolling_store_7d_30d(spark, root):
    aggs = [
        RollingAgg(f"{name}_{days}d", kind, days)
        for days in (7, 30)
        for name, kind in (("avg", "mean"), ("count", "count"))
    ]
    out = feats.with_store_history(*_targets_and_history(spark, root), aggs)
    return _round(out.select("order_id", *(a.name for a in aggs)), "avg_7d", "avg_30d")


_TF_ROUNDED = [
    "delivery_time_minutes",
    "restaurant_avg_delivery_minutes_30d",
    "customer_avg_delivery_minutes_30d",
    "distance_km",
]


@registered
def training_features(spark, root):
    return _round(feats.training_features(commerce.tables(spark, root)), *_TF_ROUNDED)


@registered
def training_features_item_grain(spark, root):
    rows = feats.training_features(commerce.tables(spark, root), grain="item")
    return _round(rows, *_TF_ROUNDED)


WEEK = ("1996-03-04 00:00:00", "1996-03-11 00:00:00")
# The history table of the test data: folders by month, as days would be thousands of tiny files.
HISTORY_PERIOD = "month"


def _stored_history(spark, root) -> DataFrame:
    path = scratch_dir(spark, "history")
    history.write_history(commerce.orders(spark, root), path, HISTORY_PERIOD, splits=1)
    return history.read_history(spark, path)


@registered
def training_features_week(spark, root):
    """One week's training set from a stored history, of which the months of the week and of the 30
    days before it are read."""
    stored = _stored_history(spark, root)
    rows = feats.training_features(
        commerce.tables(spark, root), *WEEK, history=stored, period=HISTORY_PERIOD
    )
    return _round(rows, *_TF_ROUNDED)


@registered
def order_features_newest(spark, root):
    """All features of the 200 newest confirmed orders from a stored history, pruned to their time."""
    t = commerce.tables(spark, root)
    targets = write_through(scoring.confirmed_orders(t, limit=200).drop("quantity", "latitude", "longitude"), "newest")
    out = feats.order_features(
        targets, t, history=_stored_history(spark, root), span=history.span_of(targets), period=HISTORY_PERIOD
    )
    return _round(
        out.select("order_id", *scoring.MODEL_FEATURES),
        "restaurant_avg_delivery_minutes_30d",
        "distance_km",
    )


@registered
def rolling_store_distinct_customers(spark, root):
    """Exact numbers of different customers per store in the 7 and 30 days before each order."""
    aggs = [RollingAgg(f"customers_{days}d", "distinct", days, "customer_id") for days in (7, 30)]
    out = feats.with_store_history(*_targets_and_history(spark, root), aggs)
    return out.select("order_id", *(a.name for a in aggs))


@registered
def rolling_store_median(spark, root):
    """Windows of the test data hold fewer rows than a sketch keeps, so these medians are exact."""
    aggs = [RollingAgg(f"median_{days}d", "median", days) for days in (7, 30)]
    out = feats.with_store_history(*_targets_and_history(spark, root), aggs)
    return _round(out.select("order_id", *(a.name for a in aggs)), *(a.name for a in aggs))


@registered
def order_features(spark, root):
    """All features of the confirmed orders, computed at their creation times."""
    t = commerce.tables(spark, root)
    out = scoring.inference_features(scoring.confirmed_orders(t), feats.delivered(t.orders))
    return _round(
        out.select("order_id", *scoring.MODEL_FEATURES),
        "restaurant_avg_delivery_minutes_30d",
        "distance_km",
    )


@registered
def registry_features(spark, root):
    registry = Registry(DEFAULT_FEATURES)
    for name, kind, days in (
        ("sum_30d", "sum", 30), ("min_30d", "min", 30), ("max_30d", "max", 30),
        ("stddev_30d", "stddev", 30), ("max_7d", "max", 7),
    ):
        registry.register(FeatureSpec(f"restaurant_{name}", "restaurant", kind, days, "daily"))
    names = [s.name for s in registry.select(aggregated=True)]
    out = registry.compute(*_targets_and_history(spark, root)).select("order_id", *names)
    return _round(out, *(n for n in names if "count" not in n))


@registered
def store_features_as_of(spark, root):
    t = commerce.tables(spark, root)
    out = features_as_of(
        t.stores, feats.delivered(t.orders), "store_id", _ts(AS_OF),
        "delivered_at", "delivery_time_minutes", 30,
    )
    return _round(out, "avg_delivery_minutes")


@registered
def customer_features_as_of(spark, root):
    orders = commerce.orders(spark, root, with_store=False)
    out = features_as_of(
        orders.select("customer_id").distinct(), feats.delivered(orders), "customer_id",
        _ts(AS_OF), "delivered_at", "delivery_time_minutes", 30,
    )
    return _round(out, "avg_delivery_minutes")


# --- materialized and online features --------------------------------------------------------


def _materialized(spark, root, key, as_of=AS_OF) -> DataFrame:
    orders = commerce.orders(spark, root, with_store=key == "store_id")
    return materialize.materialize(orders, key, as_of, scratch_dir(spark, "snapshots"))


@registered
def materialize_store_features(spark, root):
    return _round(_materialized(spark, root, "store_id"), "avg_delivery_minutes")


@registered
def materialize_customer_features(spark, root):
    return _round(_materialized(spark, root, "customer_id"), "avg_delivery_minutes")


@registered
def materialized_entity_count(spark, root):
    return materialize.entity_count(_materialized(spark, root, "store_id"), "store_id", AS_OF)


def _online(spark, root) -> DataFrame:
    t = commerce.tables(spark, root)
    history, at = feats.delivered(t.orders), _ts(AS_OF)
    customers = commerce.orders(spark, root, with_store=False).select("customer_id").distinct()
    return online.sync_entity("restaurant", t.stores, history, "store_id", at).unionByName(
        online.sync_entity("customer", customers, history, "customer_id", at)
    )


@registered
def online_snapshot(spark, root):
    return _round(_online(spark, root), "value")


def _aged(rows: DataFrame) -> DataFrame:
    """Every fifth store's and every third customer's rows written more than a day ago."""
    number = F.col("entity_id").cast("long")
    old = F.when(F.col("entity_type") == "restaurant", number % 5 == 0).otherwise(number % 3 == 0)
    return rows.withColumn(
        "expires_at",
        F.when(old, clock.add_seconds(F.col("updated_at"), F.lit(-1))).otherwise(F.col("expires_at")),
    )


@registered
def online_lookup(spark, root):
    confirmed = scoring.confirmed_orders(commerce.tables(spark, root)).select("order_id", "store_id")
    names = scoring.STORE_FEATURES
    out = online.lookup(
        confirmed, _aged(_online(spark, root)), "restaurant", "store_id", names, _ts(AS_OF)
    )
    return _round(out.select("order_id", *names), names[0])


@registered
def features_with_fallback(spark, root):
    t = commerce.tables(spark, root)
    out = scoring.inference_features(
        scoring.confirmed_orders(t), feats.delivered(t.orders), _aged(_online(spark, root)), _ts(AS_OF)
    )
    columns = [*scoring.STORE_FEATURES, *scoring.CUSTOMER_FEATURES, "distance_km", "hour_of_day",
               "is_weekend"]
    return _round(out.select("order_id", *columns), columns[0], "distance_km")


@registered
def feature_freshness_query(spark, root):
    snapshots = {
        "restaurant": _materialized(spark, root, "store_id"),
        "customer": _materialized(spark, root, "customer_id", "2000-05-30 00:00:00"),
    }
    out = feature_freshness(default_registry, spark, snapshots, "2000-06-01 12:00:00")
    return out.select(
        "feature_name", "version", "definition_hash", "freshness", "last_computed_at", "row_count",
        "age_seconds", "status",
    )


def _tile_snapshots(spark, root, key) -> DataFrame:
    """Two snapshots in a row: tiles of the first one's month, then a refresh of one day, and a second
    snapshot at half past six of the day after."""
    past, path = _stored_history(spark, root), scratch_dir(spark, "tiles")
    tiles.refresh_tiles(past, key, "2000-05-01", "2000-05-31", path, HISTORY_PERIOD)
    found = tiles.read_tiles(spark, path, key)
    first = write_through(tiles.snapshot_from_tiles(found, past, key, AS_OF, 30, HISTORY_PERIOD), "snapshot")
    tiles.refresh_tiles(past, key, "2000-06-01", "2000-06-01", path, HISTORY_PERIOD)
    found = tiles.read_tiles(spark, path, key)
    second = tiles.snapshot_from_tiles(found, past, key, "2000-06-02 06:30:00", 30, HISTORY_PERIOD)
    return _round(first.unionByName(second), "avg_delivery_minutes")


@registered
def store_features_from_tiles(spark, root):
    return _tile_snapshots(spark, root, "store_id")


@registered
def customer_features_from_tiles(spark, root):
    return _tile_snapshots(spark, root, "customer_id")


@registered
def active_entities(spark, root):
    """Stores and customers with deliveries before three days, from merged day sketches. The test
    data are few enough for a sketch to be exact."""
    past, path = _stored_history(spark, root), scratch_dir(spark, "activity")
    tiles.refresh_activity(past, "2000-04-01", "2000-06-30", path, HISTORY_PERIOD)
    ends = ["2000-05-15", "2000-06-01", "2000-06-15"]
    return tiles.active_entities(tiles.read_activity(spark, path), ends, (1, 7, 30))


# --- scoring, predictions, accuracy ----------------------------------------------------------


def _scored(spark, root) -> DataFrame:
    """Delivered orders scored by two versions of the rule, as of their creation times."""
    t = commerce.tables(spark, root)
    features = feats.order_features(feats.delivered(t.orders), t)
    versions = F.array(
        *(
            F.struct(
                F.lit(version).alias("model_version"),
                F.lit(float(i)).alias("shift"),
                _ts(at).alias("stored_from"),
            )
            for i, (version, at) in enumerate(STORED_AT.items())
        )
    )
    return features.select("*", F.inline(versions)).withColumn(
        "predicted_delivery_minutes", scoring.rule_minutes() + F.col("shift")
    )


def _predictions(spark, root) -> DataFrame:
    stored = clock.add_seconds(F.col("stored_from"), F.col("order_id") % 86_400)
    return scoring.as_predictions(_scored(spark, root), stored, period=PERIOD)


def _errors(spark, root) -> DataFrame:
    actual = feats.delivered(commerce.orders(spark, root, with_store=False))
    joined = accuracy.predictions_with_actuals(_predictions(spark, root), actual)
    return accuracy.with_errors(joined).drop("features_json")


def _stored_errors(spark, root) -> DataFrame:
    """The errors as a table, for reports that read them several times."""
    return write_through(
        _errors(spark, root).select(
            "order_id", "actual_delivery_minutes", "error", "absolute_error", "percentage_error"
        ),
        "errors",
    )


@registered
def rule_scores(spark, root):
    columns = ["order_id", "model_version", "predicted_delivery_minutes"]
    return _round(_scored(spark, root).select(*columns), "predicted_delivery_minutes")


@registered
def batch_score(spark, root):
    predictions, _ = scoring.score_batch(
        commerce.tables(spark, root), scoring.rule_scores, created_at=_ts("2024-01-01 00:00:00")
    )
    columns = ["order_id", "customer_id", "store_id", "prediction_timestamp",
               "predicted_delivery_minutes", "model_version"]
    return _round(predictions.select(*columns), "predicted_delivery_minutes")


@registered
def upsert_predictions(spark, root):
    """Three upserts into one table: version 1, version 2, then newer values for some orders."""
    path = scratch_dir(spark, "predictions")
    rows = write_through(_predictions(spark, root), "scored")
    first = rows.where(F.col("model_version") == "rule-1")
    newer = first.where(F.col("order_id") % 3 == 0).withColumns(
        {
            "predicted_delivery_minutes": F.col("predicted_delivery_minutes") + 2,
            "created_at": clock.add_seconds(F.col("created_at"), F.lit(5 * 86_400)),
        }
    )
    for update in (first, rows.where(F.col("model_version") == "rule-2"), newer):
        keyed.upsert(update, path)
    table = spark.read.schema(rows.schema).parquet(path)
    return _round(
        table.select(
            "order_id",
            "model_version",
            "predicted_delivery_minutes",
            F.col("created_at").alias("stored_at"),
            "prediction_timestamp",
        ),
        "predicted_delivery_minutes",
    )


@registered
def latest_prediction_per_order(spark, root):
    rows = _predictions(spark, root).select(
        "order_id", "model_version", "predicted_delivery_minutes", "created_at"
    )
    latest = latest_per_key(rows, ["order_id"], ["created_at"])
    return _round(latest.drop("created_at"), "predicted_delivery_minutes")


@registered
def prediction_stats(spark, root):
    return _round(
        scoring.prediction_stats(_predictions(spark, root)),
        "avg_prediction_minutes", "min_prediction_minutes", "max_prediction_minutes",
    )


@registered
def recent_predictions(spark, root):
    return _round(
        scoring.recent_predictions(_predictions(spark, root)), "predicted_delivery_minutes"
    )


@registered
def predictions_vs_actuals(spark, root):
    columns = ["predicted_delivery_minutes", "actual_delivery_minutes"]
    return _round(_errors(spark, root).select("order_id", "model_version", *columns), *columns)


@registered
def prediction_errors(spark, root):
    columns = ["error", "absolute_error", "percentage_error"]
    return _round(_errors(spark, root).select("order_id", "model_version", *columns), *columns)


@registered
def accuracy_overall(spark, root):
    return _round(
        accuracy.overall(_stored_errors(spark, root)),
        "mae", "rmse", "mean_percentage_error", "median_absolute_error",
    )


@registered
def accuracy_bands(spark, root):
    return _round(accuracy.bands(_errors(spark, root)), "percent")


def _store_report(spark, root) -> DataFrame:
    return _round(accuracy.by_store(_errors(spark, root)), "avg_error", "avg_predicted", "avg_actual")


@registered
def accuracy_by_store(spark, root):
    return _store_report(spark, root)


@registered
def best_stores(spark, root):
    return accuracy.extreme_rows(_store_report(spark, root), "avg_error", 10, False, ["store_id"])


@registered
def worst_stores(spark, root):
    return accuracy.extreme_rows(_store_report(spark, root), "avg_error", 5, True, ["store_id"])


def _extreme_predictions(spark, root, worst: bool) -> DataFrame:
    columns = ["predicted_delivery_minutes", "actual_delivery_minutes", "absolute_error"]
    key = ["order_id", "model_version"]
    rows = _errors(spark, root).select(*key, *columns)
    top = accuracy.extreme_rows(rows, "absolute_error", 5, worst, key)
    return _round(top, *columns)


@registered
def best_predictions(spark, root):
    return _extreme_predictions(spark, root, worst=False)


@registered
def worst_predictions(spark, root):
    return _extreme_predictions(spark, root, worst=True)


@registered
def error_describe(spark, root):
    out = accuracy.describe(_stored_errors(spark, root), ["error", "absolute_error"])
    return _round(out, "mean", "std", "min", "q25", "median", "q75", "max")


@registered
def accuracy_by_week(spark, root):
    return _round(accuracy.over_time(_errors(spark, root)), "mae", "bias")


@registered
def monitor_error_stats(spark, root):
    out = drift.error_stats(
        _errors(spark, root), "predicted_delivery_minutes", "actual_delivery_minutes"
    )
    return _round(out, "mae", "mean_error")


@registered
def order_date_range(spark, root):
    return commerce.orders(spark, root, with_store=False).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.min("created_at").alias("min_created_at"),
        F.max("created_at").alias("max_created_at"),
    )


@registered
def request_stats(spark, root):
    return _round(
        monitor.request_stats(commerce.request_log(spark, root)),
        "avg_latency_ms", "avg_prediction_minutes",
    )


@registered
def recent_log_window(spark, root):
    log = commerce.request_log(spark, root).select("request_id", "ts", "latency_ms")
    return monitor.last_rows(log, ["ts", "request_id"], 1000)


# --- drift -----------------------------------------------------------------------------------

_DRIFT_ROUNDED = ["statistic", "p_value", "reference_mean", "current_mean"]


def _event_samples(spark, root) -> DataFrame:
    side = F.when(F.col("ts") < _ts(EVENT_SPLIT), "ref").otherwise("cur")
    return commerce.events(spark, root).select("value", side.alias("side"))


def _stored_training_features(spark, root) -> DataFrame:
    return write_through(
        feats.training_features(commerce.tables(spark, root)).select("created_at", *TRAINING_FEATURES),
        "training-features",
    )


def _feature_drift(spark, root) -> DataFrame:
    rows = _stored_training_features(spark, root)
    early = F.col("created_at") < _ts(DRIFT_SPLIT)
    return drift.check_all_features(rows.where(early), rows.where(~early), TRAINING_FEATURES)


@registered
def ks_drift(spark, root):
    return _round(drift.ks_test(_event_samples(spark, root), ["value"]), *_DRIFT_ROUNDED)


@registered
def psi_drift(spark, root):
    out = drift.psi_components(_event_samples(spark, root), ["value"])
    return _round(out, "reference_mean", "current_mean", "psi_ratio", "psi_log")


@registered
def drift_all_features(spark, root):
    return _round(_feature_drift(spark, root), *_DRIFT_ROUNDED)


@registered
def drift_from_profile(spark, root):
    rows = _stored_training_features(spark, root)
    early = F.col("created_at") < _ts(DRIFT_SPLIT)
    path = scratch_dir(spark, "drift-profile")
    fitted.fit(rows.where(early), TRAINING_FEATURES, path)
    return _round(fitted.detect(rows.where(~early), path), *_DRIFT_ROUNDED)


@registered
def drift_report(spark, root):
    return drift.drift_report(_feature_drift(spark, root))


@registered
def drift_reference_profile(spark, root):
    out = drift.reference_profile(_stored_training_features(spark, root), TRAINING_FEATURES)
    return _round(out, "mean", "std", "min", "max", "median")


@registered
def prediction_drift(spark, root):
    rows = write_through(
        _predictions(spark, root).select(
            "order_id", "model_version", "created_at",
            F.col("predicted_delivery_minutes").alias("prediction"),
        ),
        "logged",
    )
    reference = rows.where(F.col("model_version") == "rule-1")
    log = rows.where(F.col("model_version") == "rule-2")
    return _round(drift.prediction_drift(reference, log, ["created_at", "order_id"]), *_DRIFT_ROUNDED)


# --- validation ------------------------------------------------------------------------------


@registered
def validate_orders(spark, root):
    t = commerce.tables(spark, root)
    rows = feats.with_quantity(feats.with_store_location(t.orders, t.stores), t.order_items)
    return validate.violations(rows, validate.ORDER_CHECKS)


@registered
def validate_training_features(spark, root):
    """Item grain, which repeats orders: the unique rule counts them."""
    rows = feats.training_features(commerce.tables(spark, root), grain="item")
    return validate.violations(write_through(rows, "item-grain"), validate.TRAINING_CHECKS)


@registered
def split_valid_rejected(spark, root):
    t = commerce.tables(spark, root)
    rules = {
        "no store": F.col("store_id").isNull(),
        "no coordinates": F.col("latitude").isNull(),
        "small total": F.col("total") < 50_000,
        "unconfirmed": F.col("confirmed_at").isNull(),
    }
    checked = validate.with_reasons(feats.with_store_location(t.orders, t.stores), rules)
    return checked.select(
        "order_id",
        (F.size("reasons") == 0).alias("is_valid"),
        F.array_join("reasons", ",").alias("reasons"),
    )


# --- models ----------------------------------------------------------------------------------


@registered
def train_test_split(spark, root):
    rows = feats.training_base(commerce.orders(spark, root, with_store=False))
    return model.with_split(rows.select("order_id"))


@registered
def regression_metrics(spark, root):
    """Test-split metrics of each version of the rule model."""
    rows = model.with_split(_errors(spark, root)).where("is_test")
    out = accuracy.regression_metrics(
        rows, "actual_delivery_minutes", "predicted_delivery_minutes", ("model_version",)
    )
    return _round(out, "mae", "rmse", "r2")


def _training_set(spark, root) -> DataFrame:
    return write_through(feats.training_features(commerce.tables(spark, root)), "training-set")


@registered
def gbt_train_eval(spark, root):
    rows = model.with_split(_training_set(spark, root))
    fitted = model.fit(rows.where(~F.col("is_test")))
    scored = model.predict(fitted, rows.where("is_test"))
    return accuracy.regression_metrics(scored, model.LABEL, "predicted_delivery_minutes")


@registered
def gbt_eval_curve(spark, root):
    """Error on the held-out split after each of the 100 rounds."""
    rows = model.with_split(_training_set(spark, root))
    fitted = model.fit(rows.where(~F.col("is_test")))
    return model.evaluation_curve(fitted, rows.where("is_test"))


@registered
def batch_score_gbt(spark, root):
    """Confirmed orders scored by the boosted trees and stored; the rows come from the table."""
    fitted = model.fit(_training_set(spark, root))
    predictions, _ = scoring.score_batch(
        commerce.tables(spark, root), model.scorer(fitted, "gbt-1"), created_at=_ts("2024-01-01 00:00:00"),
        period=PERIOD, history=_stored_history(spark, root), history_period=HISTORY_PERIOD,
    )
    path = scratch_dir(spark, "predictions")
    keyed.upsert(predictions, path)
    stored = spark.read.schema(predictions.schema).parquet(path)
    return stored.select("order_id", "store_id", "prediction_timestamp", "predicted_delivery_minutes", "model_version")


@registered
def gbt_scores(spark, root):
    rows = _training_set(spark, root)
    fitted = model.fit(rows)
    return model.predict(fitted, rows).select("order_id", "predicted_delivery_minutes")


@registered
def feature_importance(spark, root):
    return model.feature_importance(spark, model.fit(_training_set(spark, root)))


@registered
def training_run(spark, root):
    home = scratch_dir(spark, "models")
    model.run_training(_training_set(spark, root), home, "v1", "2024-01-01 00:00:00")
    return model.registry(spark, home).select("model_name", "version", F.explode("metrics"), "trained_at")


@registered
def model_registry(spark, root):
    """Two registered versions of different seeds; the latest is loaded back and scores the training set."""
    home, rows = scratch_dir(spark, "models"), _training_set(spark, root)
    for version, day, seed in (("v1", "2024-01-01", 42), ("v2", "2024-01-02", 43)):
        model.run_training(rows, home, version, f"{day} 00:00:00", seed=seed)
    newest = model.load_latest(spark, home)
    scored = model.predict(newest, rows).agg(F.count("predicted_delivery_minutes").alias("scored_rows"))
    trees = newest.stages[-1].getNumTrees
    latest = model.latest_run(spark, home)["version"]
    return scored.select(F.lit(latest).alias("latest"), F.lit(trees).alias("trees"), "scored_rows")


# --- streams ---------------------------------------------------------------------------------


def _paths(spark, label: str) -> tuple[str, str]:
    home = scratch_dir(spark, label)
    return f"{home}/out", f"{home}/checkpoint"


@registered
def stream_score(spark, root):
    """All orders as a request stream; orders without a located store go to the rejects."""
    t = commerce.tables(spark, root)
    requests = feats.with_quantity(feats.with_store_location(t.orders, t.stores), t.order_items)
    out, checkpoint = _paths(spark, "stream-score")
    online = write_through(_online(spark, root), "online")
    jobs.stream_scoring(
        sinks.staged(requests, "requests", "created_at"), online, scoring.rule_scores, out, f"{out}-rejects",
        checkpoint, _ts(AS_OF), _ts("2024-01-01 00:00:00"), PERIOD, _stored_history(spark, root), HISTORY_PERIOD,
    )
    columns = ["order_id", "store_id", "predicted_delivery_minutes", "prediction_timestamp"]
    return _round(spark.read.parquet(out).select(*columns), "predicted_delivery_minutes")


@registered
def order_lifecycle(spark, root):
    events = commerce.lifecycle_events(commerce.orders(spark, root, with_store=False))
    out, checkpoint = _paths(spark, "lifecycle")
    jobs.stream_lifecycle(sinks.staged(events, "events", "event_at"), out, checkpoint)
    return jobs.read_lifecycles(spark, out)


@registered
def stream_store_metrics(spark, root):
    rows = feats.delivered(commerce.orders(spark, root)).select(
        "store_id", "delivered_at", "delivery_time_minutes"
    )
    out, checkpoint = _paths(spark, "store-metrics")
    jobs.stream_store_days(sinks.staged(rows, "delivered", "delivered_at"), out, checkpoint)
    return _round(jobs.sliding_windows(jobs.read_store_days(spark, out)), "avg_minutes")


@registered
def stream_request_stats(spark, root):
    out, checkpoint = _paths(spark, "request-stats")
    log = sinks.staged(commerce.request_log(spark, root), "requests", "ts")
    jobs.stream_request_windows(log, out, checkpoint)
    latencies = ("avg_latency_ms", "p50_latency_ms", "p95_latency_ms")
    return _round(jobs.read_request_windows(spark, out), *latencies)


@registered
def stream_actuals_match(spark, root):
    columns = ["order_id", "model_version", "predicted_delivery_minutes", "prediction_timestamp"]
    predictions = _predictions(spark, root).select(*columns)
    actuals = feats.delivered(commerce.orders(spark, root, with_store=False)).select(
        "order_id", "delivered_at", "delivery_time_minutes"
    )
    out, checkpoint = _paths(spark, "match")
    made = sinks.staged(predictions, "predictions", "prediction_timestamp")
    arrived = sinks.staged(actuals, "actuals", "delivered_at")
    jobs.stream_actuals_match(made, arrived, out, checkpoint, hours=1)
    schema = (
        "order_id bigint, model_version string, predicted_delivery_minutes double, "
        "prediction_timestamp timestamp, delivered_at timestamp, delivery_time_minutes double"
    )
    matched = spark.read.schema(schema).parquet(out)
    return _round(matched, "predicted_delivery_minutes", "delivery_time_minutes")


@registered
def stream_dedup(spark, root):
    """Every third prediction is sent twice."""
    columns = ["order_id", "model_version", "predicted_delivery_minutes", "prediction_timestamp"]
    rows = _predictions(spark, root).select(*columns)
    copies = F.when(F.col("order_id") % 3 == 0, 2).otherwise(1)
    sent = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    out, checkpoint = _paths(spark, "dedup")
    jobs.stream_dedup(sinks.staged(sent, "sent", "prediction_timestamp"), out, checkpoint)
    schema = "order_id bigint, model_version string, predicted_delivery_minutes double"
    return _round(spark.read.schema(schema).parquet(out), "predicted_delivery_minutes")


def _monitor_log(spark, root) -> DataFrame:
    return _errors(spark, root).select(
        "model_version", "order_id", "prediction_timestamp",
        F.col("predicted_delivery_minutes").alias("prediction"),
        F.col("actual_delivery_minutes").alias("actual"),
    )


@registered
def stream_monitor(spark, root):
    out, checkpoint = _paths(spark, "monitor")
    log = sinks.staged(_monitor_log(spark, root), "log", "prediction_timestamp")
    last = jobs.stream_monitor(log, out, checkpoint).lastProgress["batchId"]
    state = jobs.read_monitor(spark, out, last)
    return _round(jobs.monitor_summary(state), "avg_prediction", "mae", "mean_error")


@registered
def stream_monitor_state(spark, root):
    """The same monitor with its rows as keyed stream state."""
    out, checkpoint = _paths(spark, "monitor-state")
    log = sinks.staged(_monitor_log(spark, root), "log", "prediction_timestamp")
    keyed_state.stream_newest(log, out, checkpoint)
    state = keyed_state.read_newest(spark, out)
    return _round(jobs.monitor_summary(state), "avg_prediction", "mae", "mean_error")


@registered
def order_closures(spark, root):
    """Orders closed by delivery, cancellation or two days of silence; the newest ones are still open."""
    events = commerce.lifecycle_events(commerce.orders(spark, root, with_store=False))
    out, checkpoint = _paths(spark, "closures")
    keyed_state.stream_order_closures(sinks.staged(events, "events", "event_at"), out, checkpoint)
    return keyed_state.read_closures(spark, out)


LATE_CUTS = ["1996-05-01", "1997-09-01", "1999-01-01", "2000-04-01"]


def _late_stream(spark, root) -> tuple[str, str]:
    """Deliveries of five periods in time order, but those of every 50th order come with the last."""
    rows = feats.delivered(commerce.orders(spark, root)).select(
        "order_id", "store_id", "delivered_at", "delivery_time_minutes"
    )
    at = F.col("delivered_at")
    portion = sum(((at >= _ts(cut)).cast("int") for cut in LATE_CUTS), F.lit(0))
    portion = F.when(F.col("order_id") % 50 == 0, len(LATE_CUTS)).otherwise(portion)
    out, checkpoint = _paths(spark, "late")
    stream = sinks.staged_parts(
        write_through(rows, "delivered"), portion, len(LATE_CUTS) + 1, scratch_dir(spark, "late-in")
    )
    jobs.stream_store_days_with_late(stream, out, checkpoint)
    return out, "order_id bigint, store_id bigint, delivered_at timestamp, delivery_time_minutes double"


@registered
def stream_late_rows(spark, root):
    """The rows that came behind the watermark, with the watermark they met."""
    out, schema = _late_stream(spark, root)
    return late.read_late(spark, out, schema).select(
        "order_id", "store_id", "delivered_at", F.timestamp_millis("watermark_ms").alias("watermark")
    )


@registered
def stream_late_ledger(spark, root):
    out, _ = _late_stream(spark, root)
    return late.read_ledger(spark, out).select(
        "batch_id", "rows", "late_rows", F.timestamp_millis("greatest_ms").alias("greatest"),
        F.timestamp_millis("watermark_ms").alias("watermark"),
    )


@registered
def stream_days_with_late(spark, root):
    """Day totals once the late rows are merged in."""
    out, schema = _late_stream(spark, root)
    return _round(jobs.read_store_days_with_late(spark, out, schema), "minutes")
