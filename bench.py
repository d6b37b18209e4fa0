"""Headline timings; prints one JSON line.

Queries run on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``. Ingestion and the
full-range questions run on synthetic logs as well, in ``$BENCH_LOGS`` rows
(1,000,000 by default) and in a quarter of them, so that growth shows.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent))

from logweir.params import AggregateQuery, LogQuery  # noqa: E402
from logweir.plans.registry import QUERIES  # noqa: E402
from logweir.session import configure  # noqa: E402
from logweir.sources.requests import read_requests  # noqa: E402
from logweir.sources.synthetic import as_requests, generate_logs  # noqa: E402
from logweir.store import LogStore  # noqa: E402

HEADLINE = (
    "bucket_by_service", "bucket_count_1m", "bucket_count_1d", "rollup_bucket_1h", "bucket_exact", "bucket_q",
    "bucket_attr", "minute_counts", "filter_combined", "search_message", "search_documents", "list_recent",
    "list_page2", "page_after", "paged_export", "validate_reasons", "ingest_report", "assign_ids", "rollup_merge",
    "rollup_backfill", "retention_candidates", "latency_summary",
)
NOW = "2026-08-08T00:00:00Z"
WHOLE = {"since": "2026-07-01T00:00:00Z", "until": "2026-08-09T00:00:00Z"}
HOUR = {"since": "2026-08-07T22:59:00Z", "until": "2026-08-07T23:59:00Z"}
RUNS = 3


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def best(action) -> float:
    """Median of the runs after a first one that warms up."""
    action()
    return statistics.median(timed(action) for _ in range(RUNS))


def store_timings(spark: SparkSession, folder: str, logs: int) -> dict[str, float]:
    source = f"{folder}/requests-{logs}"
    as_requests(generate_logs(spark, logs, "seed", NOW), 1_000).write.parquet(source)
    store = LogStore(spark, f"{folder}/store-{logs}")
    seconds = {"ingest": timed(lambda: store.ingest(read_requests(spark, source), "bench", NOW))}
    for name, limits in (("full", WHOLE), ("hour", HOUR)):
        query = AggregateQuery(bucket="1m", group_by="service", **limits)
        seconds[f"aggregate_base_{name}"] = best(lambda: consume(store.bucket_counts(query, "base")))
        seconds[f"aggregate_rollup_{name}"] = best(lambda: consume(store.bucket_counts(query, "rollup")))
        seconds[f"list_{name}"] = best(lambda: store.fetch_page(LogQuery(**limits)))
    return {f"{name}_{logs}": round(value, 4) for name, value in seconds.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    logs = int(os.environ.get("BENCH_LOGS", "1000000"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logweir-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    queries = {name: round(best(lambda: consume(QUERIES[name](spark, sf_dir))), 4) for name in HEADLINE}
    folder = tempfile.mkdtemp(prefix="logweir-bench-")
    try:
        for size in (logs // 4, logs):
            queries.update(store_timings(spark, folder, size))
    finally:
        shutil.rmtree(folder)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "ingest_logs_per_second": round(logs / queries[f"ingest_{logs}"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
