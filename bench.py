"""Run the headline queries and print one JSON line with their times."""

from __future__ import annotations

import json
import os
import time

from casebook.plans import catalogue
from casebook.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = os.environ.get("BENCH_QUERIES", "").split()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        "casebook-bench",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' machinery before the clock runs.
    spark.range(1000).mapInArrow(lambda batches: batches, "id bigint").write.format("noop").mode(
        "overwrite"
    ).save()
    queries = catalogue.queries()
    times = {}
    for name in ONLY or queries:
        start = time.perf_counter()
        queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
