"""Run registered queries next to their DuckDB statements and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{root}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(keyed, key=repr)


def same(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) and tolerance:
        return math.isclose(a, b, rel_tol=0, abs_tol=tolerance)
    return type(a) is type(b) and a == b


def difference(spark_df, con, sql: str, tolerance: float = 0.0) -> str | None:
    """None when equal, else what differs first."""
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}"
    for g, w in zip(got, want):
        if not all(same(x, y, tolerance) for x, y in zip(g, w)):
            return f"got {g}, want {w}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from etaforge.session import get_spark

    root = sys.argv[1]
    spark = get_spark(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(root), entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, root)
            if name in sql:
                problem = difference(df, con, sql[name])
            else:
                problem = f"(rows only: {len(df.collect())})"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        ok = problem is None or problem.startswith("(rows")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad, "missing queries:", sorted(set(sql) - set(entry.queries())))
