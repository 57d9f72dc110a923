"""Relationship inference and the mapping-driven star join."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etaforge.operators.joins import fanout_left_join


@dataclass(frozen=True)
class Relationship:
    """`child.child_column` refers to `parent.parent_column`."""

    child: str
    child_column: str
    parent: str
    parent_column: str


def candidate_relationships(columns: dict[str, list[str]]) -> list[Relationship]:
    """Name rule: column `x_id` refers to table `x`, `xs`, or one equal to `x` without its final s.

    The parent's key is its own `x_id` if it has one, else `id`. A table never refers to itself.
    """
    found = []
    for child, names in columns.items():
        for column in names:
            stem = column.lower().removesuffix("_id")
            if stem == column.lower() or not stem:
                continue
            for parent, parent_columns in columns.items():
                plain = parent.lower()
                if parent == child or stem not in (plain, plain.removesuffix("s"), plain.rstrip("s")):
                    continue
                lowered = {c.lower(): c for c in parent_columns}
                key = lowered.get(column.lower()) or lowered.get("id")
                if key:
                    found.append(Relationship(child, column, parent, key))
    return found


def relationship_coverage(
    tables: dict[str, DataFrame], relationships: list[Relationship]
) -> DataFrame:
    """Per relationship: how many child rows refer to an existing parent.

    Child rows shrink to one (key, count) pair per key before the join, so hot keys cost nothing.
    """
    out = None
    for r in relationships:
        child = (
            tables[r.child].groupBy(F.col(r.child_column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        )
        parent = (
            tables[r.parent]
            .groupBy(F.col(r.parent_column).alias("k"))
            .agg(F.count(F.lit(1)).alias("copies"))
        )
        one = (
            child.join(parent, "k", "left")
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
                F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias(
                    "child_rows_with_key"
                ),
                F.coalesce(F.sum(F.when(F.col("copies").isNotNull(), F.col("n"))), F.lit(0)).alias(
                    "matched_rows"
                ),
                F.count("k").alias("distinct_keys"),
                F.count_if(F.col("k").isNotNull() & F.col("copies").isNull()).alias("orphan_keys"),
                F.coalesce(F.max("copies"), F.lit(0)).alias("max_parent_copies"),
            )
            .select(
                F.lit(r.child).alias("child_table"),
                F.lit(r.child_column).alias("child_column"),
                F.lit(r.parent).alias("parent_table"),
                F.lit(r.parent_column).alias("parent_column"),
                "*",
            )
        )
        out = one if out is None else out.unionByName(one)
    return out


def conform_orders(
    tables: dict[str, DataFrame],
    mapping: dict[str, str | dict],
    relationships: list[Relationship] | None = None,
    base: str | None = None,
    view: str | None = None,
    delivered_only: bool = True,
) -> DataFrame:
    """Project `expected column -> "table.column"` over LEFT JOINs of the tables it names.

    The base is the table most columns map to. Others are joined breadth-first along the
    relationships, in mapping order; a table that cannot be reached is an error. Column names are
    matched without regard to case.
    """
    sources = _mapped_columns(mapping)
    needed = list(dict.fromkeys(table for table, _ in sources.values()))
    if base is None:
        base = Counter(table for table, _ in sources.values()).most_common(1)[0][0]
    if relationships is None:
        relationships = candidate_relationships({n: df.columns for n, df in tables.items()})

    joined = _prefixed(tables[base], base)
    if delivered_only:
        joined = joined.where(F.col(_qualified(base, "delivered_at")).isNotNull())
    reached, frontier = {base}, [base]
    while frontier:
        here = frontier.pop(0)
        for name in needed:
            link = None if name in reached else _link(relationships, here, name)
            if link is None:
                continue
            here_column, there_column, to_many = link
            right = _prefixed(tables[name], name)
            key = _qualified(here, here_column)
            # The joined table keeps its own key column: NULL where nothing matched.
            right = right.withColumn(key, F.col(_qualified(name, there_column)))
            # A parent key is unique; rows below a parent may be many for one key.
            if to_many:
                joined = fanout_left_join(joined, right, key)
            else:
                joined = joined.join(right, key, "left")
            reached.add(name)
            frontier.append(name)
    missing = [name for name in needed if name not in reached]
    if missing:
        raise ValueError(f"no relationship leads from {base!r} to {missing}")

    out = joined.select(
        *(F.col(_qualified(*source)).alias(target) for target, source in sources.items())
    )
    if view:
        out.createOrReplaceTempView(view)
    return out


def _mapped_columns(mapping: dict[str, str | dict]) -> dict[str, tuple[str, str]]:
    """Targets with a usable source; entries may be text or `{"maps_to": text}`."""
    sources = {}
    for target, entry in mapping.items():
        source = entry.get("maps_to", "") if isinstance(entry, dict) else entry
        if "." in source and not source.startswith("YOUR_TABLE."):
            sources[target] = tuple(source.split(".", 1))
    if not sources:
        raise ValueError("no mapped columns")
    return sources


def _qualified(table: str, column: str) -> str:
    return f"{table}__{column}".lower()


def _prefixed(df: DataFrame, table: str) -> DataFrame:
    return df.select(*(F.col(c).alias(_qualified(table, c)) for c in df.columns))


def _link(
    relationships: list[Relationship], here: str, there: str
) -> tuple[str, str, bool] | None:
    for r in relationships:
        if (r.child, r.parent) == (here, there):
            return r.child_column, r.parent_column, False
        if (r.parent, r.child) == (here, there):
            return r.parent_column, r.child_column, True
    return None
