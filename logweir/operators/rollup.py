"""The minute rollup ``(minute, service, level, count)``.

Stored as deltas that are summed on read: adding a batch is an append.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.timestamps import bucket_start
from logweir.operators.filters import instant

KEYS = ("minute", "service", "level")


def minute_counts(logs: DataFrame) -> DataFrame:
    """Counts of the given logs per minute, service and level."""
    return logs.groupBy(bucket_start(F.col("timestamp"), 60).alias("minute"), "service", "level").agg(
        F.count("*").alias("count")
    )


def rollup_scan(deltas: DataFrame) -> DataFrame:
    """The rollup that the deltas add up to; a negative sum is an error, as counts then have drifted from the logs."""
    total = F.sum("count")
    checked = F.when(total < 0, F.raise_error(F.lit("negative count in the rollup"))).otherwise(total)
    return deltas.groupBy(*KEYS).agg(checked.alias("count")).where(F.col("count") != 0)


def merge_rollup(rollup: DataFrame, added: DataFrame) -> DataFrame:
    """Upsert that adds: counts of equal keys are summed."""
    return rollup_scan(rollup.select(*KEYS, "count").unionByName(added.select(*KEYS, "count")))


def rebuild_rollup(rollup: DataFrame, logs: DataFrame) -> DataFrame:
    """Upsert that replaces: keys found in ``logs`` get their true count, others stay.

    One aggregation of both sides instead of an anti join, so a hot key is
    combined before it is shuffled.
    """
    true_counts = minute_counts(logs).select(*KEYS, F.col("count").alias("true_count"), F.lit(None).cast("long").alias("old_count"))
    old = rollup.select(*KEYS, F.lit(None).cast("long").alias("true_count"), F.col("count").alias("old_count"))
    return (
        true_counts.unionByName(old)
        .groupBy(*KEYS)
        .agg(F.coalesce(F.sum("true_count"), F.sum("old_count")).alias("count"))
    )


def rollup_purge(rollup: DataFrame, cutoff: datetime) -> DataFrame:
    """Drop all minutes that start before the cutoff."""
    return rollup.where(F.col("minute") >= instant(cutoff))


def rollup_subtract(rollup: DataFrame, deleted: DataFrame) -> DataFrame:
    """Take exactly the deleted logs out of the rollup."""
    negative = minute_counts(deleted).withColumn("count", -F.col("count"))
    return merge_rollup(rollup, negative)
