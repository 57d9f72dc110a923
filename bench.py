"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from etaforge.catalog import QUERIES  # noqa: E402
from etaforge.session import get_spark  # noqa: E402

HEADLINE = [
    "training_features",
    "training_features_item_grain",
    "pit_store_features",
    "pit_customer_features",
    "rolling_store_7d_30d",
    "registry_features",
    "features_with_fallback",
    "batch_score",
    "upsert_predictions",
    "conform_orders",
    "accuracy_overall",
    "accuracy_by_store",
    "error_describe",
    "ks_drift",
    "psi_drift",
    "drift_all_features",
    "request_stats",
    "validate_orders",
    "order_lifecycle",
    "stream_store_metrics",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        app="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["order_date_range"](spark, root).collect()  # starts the JVM side, not timed
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(root).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
