"""Synthetic logs, a deterministic function of an index and ``now``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.timestamps import iso_timestamp

# Fixed values of the workload definition.
SERVICES = ("auth", "checkout", "orders", "notifications", "users")
LEVELS = ("debug", "info", "warn", "error")
MESSAGES = (
    "request completed",
    "payment declined",
    "password reset requested",
    "notification delivered",
    "order queued",
    "search 100% literal",
)
REGIONS = ("eu-west", "us-east", "ap-south")
SEED_SPREAD_SECONDS = 2_592_000


@dataclass(frozen=True)
class Profile:
    regions: int
    request_prefix: str
    messages: int = 0  # 0: every fifth message is a decline, the rest completions
    suffix: str | None = None
    month_spread: bool = False


PROFILES = {
    "load": Profile(regions=3, request_prefix="req-", messages=6, suffix=" pattern-"),
    "seed": Profile(regions=3, request_prefix="seed-req-", suffix=" seed-", month_spread=True),
    "bench": Profile(regions=2, request_prefix="req-", messages=5, suffix=" benchmark-"),
    "mixed": Profile(regions=2, request_prefix="mixed-"),
    "rate": Profile(regions=2, request_prefix="rate-"),
}


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def synthetic_logs(indexes: DataFrame, profile: str, now: str, index_column: str = "index") -> DataFrame:
    """Logs for the given indexes; ``attributes`` is a struct of the five workload fields."""
    form = PROFILES[profile]
    index = F.col(index_column)
    now_ms = F.unix_millis(F.lit(now).cast("timestamp")) - 60_000
    if form.month_spread:
        millis = now_ms - index % SEED_SPREAD_SECONDS * 1_000
    else:
        millis = now_ms + index % 1_000
    if form.messages:
        message = _pick(MESSAGES[: form.messages], index)
    else:
        message = F.when(index % 5 == 0, "payment declined").otherwise("request completed")
    if form.suffix:
        message = F.concat(message, F.lit(form.suffix), index % 100)
    return indexes.select(
        index.alias("index"),
        F.timestamp_millis(millis).alias("timestamp"),
        _pick(LEVELS, index).alias("level"),
        _pick(SERVICES, index).alias("service"),
        message.alias("message"),
        F.struct(
            (index % 50_000 + 10_000).cast("string").alias("user_id"),
            _pick(REGIONS[: form.regions], index).alias("region"),
            F.concat(F.lit(form.request_prefix), index).alias("request_id"),
            (index % 4).cast("int").alias("attempt"),
            (index % 7 != 0).alias("success"),
        ).alias("attributes"),
    )


def generate_logs(spark: SparkSession, n: int, profile: str, now: str) -> DataFrame:
    """``n`` synthetic logs, generated in parallel."""
    return synthetic_logs(spark.range(n).withColumnRenamed("id", "index"), profile, now)


def as_requests(logs: DataFrame, batch_size: int) -> DataFrame:
    """Pack synthetic logs into request bodies of ``batch_size`` consecutive indexes."""
    entry = F.struct(
        iso_timestamp(F.col("timestamp")).alias("timestamp"), "level", "service", "message", "attributes"
    )
    packed = logs.groupBy(F.floor(F.col("index") / batch_size).alias("request_seq")).agg(
        F.array_sort(F.collect_list(F.struct("index", entry.alias("entry")))).alias("logs")
    )
    body = F.to_json(F.struct(F.transform("logs", lambda e: e["entry"]).alias("logs")))
    return packed.select("request_seq", body.alias("body"))
