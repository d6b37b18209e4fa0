"""Counts per time bucket."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.timestamps import bucket_key
from logweir.operators.filters import apply_filters, day_of, instant
from logweir.params import AggregateQuery

MINUTE = timedelta(minutes=1)


def _bucketed(df: DataFrame, query: AggregateQuery, timestamp: str, count: Column) -> DataFrame:
    """Group on the bucket number (a LONG) and turn it into a timestamp afterwards."""
    keys = [bucket_key(F.col(timestamp), query.bucket_seconds).alias("bucket")]
    if query.group_by:
        keys.append(F.col(query.group_by).alias("group"))
    counted = df.groupBy(*keys).agg(count.alias("count"))
    group = F.col("group") if query.group_by else F.lit(None).cast("string")
    return counted.select(
        F.timestamp_micros("bucket").alias("start"), group.alias("group"), F.col("count")
    )


def _ordered(buckets: DataFrame) -> DataFrame:
    return buckets.orderBy(F.asc("start"), F.asc_nulls_first("group"))


def count_logs(logs: DataFrame, query: AggregateQuery) -> DataFrame:
    """Exact counts from the base table, non-empty buckets only."""
    return _ordered(_bucketed(apply_filters(logs, query), query, "timestamp", F.count("*")))


def needs_base(query: AggregateQuery) -> bool:
    """Attribute and text filters cannot be answered from the rollup."""
    return bool(query.attributes) or query.q is not None


def sum_rollup(rollup: DataFrame, query: AggregateQuery) -> DataFrame:
    """Counts from the rollup. ``since`` and ``until`` apply to the start of each minute.

    Deltas need not be merged first: they are summed here anyway. Counts that
    deletions have taken off again leave no bucket.
    """
    if needs_base(query):
        raise ValueError("attribute and text filters need the base table")
    rows = apply_filters(rollup, query, "minute")
    return _ordered(_bucketed(rows, query, "minute", F.sum("count")).where(F.col("count") != 0))


def _floor_minute(value: datetime) -> datetime:
    return value.replace(second=0, microsecond=0)


def _ceil_minute(value: datetime) -> datetime:
    return _floor_minute(value) + (MINUTE if value != _floor_minute(value) else timedelta(0))


def count_exact(logs: DataFrame, rollup: DataFrame, query: AggregateQuery, complete_from: datetime | None = None) -> DataFrame:
    """Whole minutes from the rollup, the two cut-off minutes at the edges from the base table.

    Minutes before ``complete_from``, where the rollup may lack logs that are
    still there, are read from the base table as well.
    """
    since, until = query.since.astimezone(UTC), query.until.astimezone(UTC)
    first = _ceil_minute(max(since, complete_from) if complete_from else since)
    last = _floor_minute(until)
    if needs_base(query) or first >= last:
        return count_logs(logs, query)
    # The full range stays on both edges; it is the part that prunes the scan.
    matching = apply_filters(logs, query)
    head = matching.where(F.col("timestamp") < instant(first))
    tail = matching.where(F.col("timestamp") >= instant(last))
    if "log_date" in logs.columns:
        head = head.where(F.col("log_date") <= day_of(first))
        tail = tail.where(F.col("log_date") >= day_of(last))
    columns = ["service", "level"]
    edges = head.unionByName(tail).select(F.col("timestamp").alias("minute"), *columns, F.lit(1).cast("long").alias("count"))
    whole = apply_filters(rollup, query, "minute").where(
        (F.col("minute") >= instant(first)) & (F.col("minute") < instant(last))
    )
    parts = whole.select("minute", *columns, "count").unionByName(edges)
    return _ordered(_bucketed(parts, query, "minute", F.sum("count")).where(F.col("count") != 0))


def bucket_counts(
    logs: DataFrame,
    rollup: DataFrame | None,
    query: AggregateQuery,
    source: str = "auto",
    complete_from: datetime | None = None,
) -> DataFrame:
    """``(start, group, count)`` in start order.

    ``source``: ``base`` reads the logs, ``rollup`` the rollup, ``auto`` the
    rollup whenever the filters allow it, ``exact`` the rollup for whole minutes
    plus the logs for cut-off edge minutes and for those before ``complete_from``.
    """
    if source == "exact":
        return count_exact(logs, rollup, query, complete_from)
    if source == "rollup" or (source == "auto" and rollup is not None and not needs_base(query)):
        return sum_rollup(rollup, query)
    return count_logs(logs, query)
