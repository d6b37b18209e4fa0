"""Newest-first listings, pages and full export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from logweir.functions.attributes import keep_scalars
from logweir.functions.timestamps import FIRST_MILLIS
from logweir.operators.filters import apply_filters
from logweir.operators.ranking import newest_first_rank
from logweir.params import LogQuery, QueryCursor

LOG_COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")


def scan_logs(logs: DataFrame) -> DataFrame:
    """Read shape: id as text, missing attributes as ``{}``, non-scalar attribute values dropped."""
    return logs.select(
        F.col("id").cast("string").alias("id"),
        "timestamp",
        "level",
        "service",
        "message",
        keep_scalars(F.col("attributes")).alias("attributes"),
    )


def newest(logs: DataFrame, n: int) -> DataFrame:
    """The n newest rows, kept by each task while it reads: no sort of the table."""
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def list_logs(logs: DataFrame, query: LogQuery) -> DataFrame:
    """One row more than a page, which tells whether there is a next page."""
    wanted = [c for c in logs.columns if c in LOG_COLUMNS]
    return newest(apply_filters(logs, query).select(*wanted), query.limit + 1)


def list_page(logs: DataFrame, query: LogQuery) -> DataFrame:
    """A page with ``next_timestamp, next_id``: the key of its last row when more rows follow.

    The windows run over at most ``limit + 1`` (1001) rows.
    """
    order = Window.orderBy(F.desc("timestamp"), F.desc("id"))
    everything = Window.partitionBy()
    rows = list_logs(logs, query).select(
        "*", F.row_number().over(order).alias("position"), F.count("*").over(everything).alias("fetched")
    )
    last = F.when((F.col("position") == query.limit) & (F.col("fetched") > query.limit), True)
    return (
        rows.select(
            "*",
            F.max(F.when(last, F.col("timestamp"))).over(everything).alias("next_timestamp"),
            F.max(F.when(last, F.col("id"))).over(everything).alias("next_id"),
        )
        .where(F.col("position") <= query.limit)
        .drop("fetched")
    )


def fetch_page(logs: DataFrame, query: LogQuery) -> tuple[list[Row], QueryCursor | None]:
    """Rows of a page (at most 1000) and the cursor of the next one.

    Each row has its ``timestamp_millis``; ``timestamp`` is None in year 0, which
    Python's datetimes don't reach.
    """
    millis = F.unix_millis("timestamp")
    shown = list_logs(logs, query).withColumn("timestamp_millis", millis)
    rows = shown.withColumn("timestamp", F.when(millis >= FIRST_MILLIS, F.col("timestamp"))).collect()
    page = rows[: query.limit]
    return page, (cursor_after(page[-1]) if len(rows) > query.limit else None)


def cursor_after(row: Row) -> QueryCursor:
    return QueryCursor(row["timestamp_millis"], row["id"])


def page_after(logs: DataFrame, cursor: QueryCursor, limit: int) -> DataFrame:
    """The page that follows ``cursor``, whatever filters were applied to ``logs``."""
    return newest(apply_filters(logs, LogQuery(cursor=cursor)), limit)


def paged_export(logs: DataFrame, page_size: int, **sizes: int) -> DataFrame:
    """Every row with its page number and position in newest-first order, in one distributed job."""
    ranked = newest_first_rank(logs, **sizes)
    place = F.col("rank") - 1
    return ranked.select(
        *logs.columns,
        F.floor(place / page_size).alias("page"),
        (F.pmod(place, F.lit(page_size)) + 1).alias("position"),
    )
