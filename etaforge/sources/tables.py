"""Table scans with fixed schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Column types of the delivery tables, as DDL. Timestamps are read as `timestamp` also from files that
# store them without a zone, so filters reach the Parquet scan and streams accept watermarks.
ORDERS = (
    "order_id bigint, customer_id bigint, store_id bigint, total bigint, created_at timestamp, "
    "confirmed_at timestamp, delivered_at timestamp, delivery_latitude double, "
    "delivery_longitude double"
)
STORES = "store_id bigint, latitude double, longitude double"
ORDER_ITEMS = "order_id bigint, quantity bigint"
EVENTS = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)


@dataclass(frozen=True)
class DeliveryTables:
    """The three input tables every plan starts from."""

    orders: DataFrame
    stores: DataFrame
    order_items: DataFrame

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, key_type: str = "bigint") -> DeliveryTables:
        """`orders`, `stores`, `order_items` folders below `root`; ids may be `string`."""
        return cls(
            *(
                scan(spark, f"{root}/{name}", with_key_type(schema, key_type))
                for name, schema in (
                    ("orders", ORDERS),
                    ("stores", STORES),
                    ("order_items", ORDER_ITEMS),
                )
            )
        )


def with_key_type(ddl: str, key_type: str) -> str:
    return ddl.replace("_id bigint", f"_id {key_type}")


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet scan without footer inference."""
    return spark.read.schema(schema).parquet(path)


def stream_scan(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    """File stream over a Parquet folder."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)
