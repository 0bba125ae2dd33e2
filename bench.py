"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the cores.
Results are collected, so each time covers the whole query with its stages.
"""

from __future__ import annotations

import json
import os
import time

from checks.compare import session
from checks.queries import QUERIES

# From single operators to whole discoveries; the first one also starts the session up.
HEADLINE = (
    "resolve_params",
    "orphan_rows",
    "column_sample",
    "column_profile",
    "pk_values",
    "inclusion_misses",
    "relations_any",
    "relations_default_params",
    "relations_tolerant",
    "relations_unique",
    "relations_ascii",
    "relations_mysql_types",
    "relations_sampled",
    "relation_replace",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
