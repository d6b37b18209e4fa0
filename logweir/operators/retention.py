"""Bounded retention: oldest logs first, in batches, up to a number of batches per cycle."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.timestamps import iso_timestamp
from logweir.operators.filters import instant
from logweir.operators.ranking import kth_oldest, up_to


def cutoff_for(now: datetime, days: float) -> datetime:
    return now - timedelta(days=days)


@dataclass(frozen=True)
class RetentionPlan:
    """What one cycle deletes. ``last`` is the key (milliseconds, id) of the last deleted row, None for all expired rows."""

    cutoff: datetime
    deleted: int
    batches: int
    has_more: bool
    last: tuple[int, int] | None

    def deletes(self) -> Column:
        """Predicate of the deleted rows: two literals that prune files, no join on ids."""
        if self.last is None:
            return F.col("timestamp") < instant(self.cutoff)
        return up_to(self.last)


def _outcome(expired: Column, batch_size: int, max_batches: int) -> list[Column]:
    """Closed form of the batch loop; ``has_more`` only says that the cap was reached."""
    cap = batch_size * max_batches
    deleted = F.least(expired, F.lit(cap).cast("long"))
    return [
        deleted.alias("deleted"),
        F.ceil(deleted / batch_size).cast("long").alias("batches"),
        (deleted == cap).alias("has_more"),
    ]


def retention_report(logs: DataFrame, now: datetime, days: float, batch_size: int, max_batches: int) -> DataFrame:
    """One row ``(cutoff, deleted, batches, has_more)``."""
    cutoff = instant(cutoff_for(now, days))
    expired = logs.where(F.col("timestamp") < cutoff).agg(F.count("*").alias("expired"))
    return expired.select(
        iso_timestamp(cutoff).alias("cutoff"), *_outcome(F.col("expired"), batch_size, max_batches)
    )


def retention_plan(
    logs: DataFrame, now: datetime, days: float, batch_size: int, max_batches: int
) -> RetentionPlan:
    if batch_size < 1 or max_batches < 1:
        raise ValueError("batch size and batch count must be positive")
    cutoff = cutoff_for(now, days)
    expired = logs.where(F.col("timestamp") < instant(cutoff))
    found = retention_report(logs, now, days, batch_size, max_batches).first()
    last = None
    if found["has_more"]:
        last = kth_oldest(expired, found["deleted"])
    return RetentionPlan(cutoff, found["deleted"], found["batches"], found["has_more"], last)


def retention_candidates(logs: DataFrame, plan: RetentionPlan) -> DataFrame:
    """The rows a cycle deletes."""
    return logs.where(plan.deletes())


def retention_keep(logs: DataFrame, plan: RetentionPlan) -> DataFrame:
    """The rows that stay."""
    return logs.where(~plan.deletes())


def delete_by_id(logs: DataFrame, expired: DataFrame) -> DataFrame:
    """General delete by id; prefer :func:`retention_keep`, which needs no join."""
    return logs.join(expired.select("id"), "id", "left_anti")
