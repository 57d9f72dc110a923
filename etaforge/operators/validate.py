"""Declarative table checks and the valid / rejected split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """`kind` is `unique`, `not_null`, `min` or `max`; NULL passes `min` and `max`."""

    column: str
    kind: str
    bound: float | None = None

    @property
    def rule(self) -> str:
        return f"{self.column}:{self.kind}" + ("" if self.bound is None else f":{self.bound:g}")

    def violated(self) -> Column:
        col = F.col(self.column)
        if self.kind == "not_null":
            return col.isNull()
        if self.kind == "min":
            return col < self.bound
        if self.kind == "max":
            return col > self.bound
        raise ValueError(f"no row rule for {self.kind!r}")


# The rules of the order table and of the training set.
ORDER_CHECKS = [
    Check("order_id", "unique"),
    Check("order_id", "not_null"),
    Check("customer_id", "not_null"),
    Check("store_id", "not_null"),
    Check("created_at", "not_null"),
    Check("delivery_latitude", "not_null"),
    Check("delivery_longitude", "not_null"),
    Check("latitude", "not_null"),
    Check("longitude", "not_null"),
    Check("total", "not_null"),
    Check("quantity", "not_null"),
    Check("total", "min", 0),
    Check("quantity", "min", 1),
]
TRAINING_CHECKS = [
    Check("order_id", "unique"),
    Check("order_id", "not_null"),
    Check("restaurant_order_count_30d", "not_null"),
    Check("customer_order_count_30d", "not_null"),
    Check("distance_km", "not_null"),
    Check("hour_of_day", "not_null"),
    Check("day_of_week", "not_null"),
    Check("is_weekend", "not_null"),
    Check("total", "not_null"),
    Check("quantity", "not_null"),
    Check("delivery_time_minutes", "min", 0),
    Check("restaurant_avg_delivery_minutes_30d", "min", 0),
    Check("restaurant_order_count_30d", "min", 0),
    Check("customer_order_count_30d", "min", 0),
    Check("distance_km", "min", 0),
    Check("hour_of_day", "min", 0),
    Check("hour_of_day", "max", 23),
    Check("day_of_week", "min", 0),
    Check("day_of_week", "max", 6),
    Check("total", "min", 0),
    Check("quantity", "min", 1),
]


def violations(df: DataFrame, checks: list[Check]) -> DataFrame:
    """`(rule, violations)`: one pass for all row rules, one grouped count per unique rule.

    A unique rule counts the keys that occur more than once.
    """
    row_rules = [c for c in checks if c.kind != "unique"]
    sums = df.agg(*(F.count_if(c.violated()).alias(c.rule) for c in row_rules))
    cells = F.array(
        *(
            F.struct(F.lit(c.rule).alias("rule"), F.col(f"`{c.rule}`").alias("violations"))
            for c in row_rules
        )
    )
    out = sums.select(F.inline(cells))
    for check in checks:
        if check.kind == "unique":
            repeated = df.groupBy(check.column).count().where("count > 1")
            out = out.unionByName(
                repeated.agg(F.count(F.lit(1)).alias("violations")).select(
                    F.lit(check.rule).alias("rule"), "violations"
                )
            )
    return out


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `reasons`: the names of all broken rules of a row, in rule order."""
    broken = [F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)


def batch_outcome(checked: DataFrame, batch: str) -> DataFrame:
    """Total, successful and failed orders per request batch. The errors themselves stay rows
    (`rejected_rows`), so a batch of any size is never gathered into one value."""
    failed = F.count_if(F.size("reasons") > 0)
    return checked.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_orders"),
        (F.count(F.lit(1)) - failed).alias("successful"),
        failed.alias("failed"),
    )
