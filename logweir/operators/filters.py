"""Row filters. Absent parameters add no predicate; values are always literals, never SQL text."""

from __future__ import annotations

from collections.abc import Collection
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.text import contains_ignore_case
from logweir.functions.timestamps import as_millis, iso_of_millis, utc
from logweir.params import AggregateQuery, LogQuery, QueryCursor

Query = LogQuery | AggregateQuery


def instant(value: datetime | int) -> Column:
    """Timestamp literal of a datetime or of milliseconds that does not depend on any time zone setting."""
    return F.timestamp_millis(F.lit(value if isinstance(value, int) else as_millis(utc(value))))


def day_of(value: datetime | int) -> Column:
    """Literal of the UTC day of an instant, as ``log_date`` has it."""
    return F.lit(iso_of_millis(value if isinstance(value, int) else as_millis(utc(value)))[:10]).cast("date")


def time_range(
    since: datetime | int | None, until: datetime | int | None, timestamp: str = "timestamp", date: str | None = None
) -> list[Column]:
    """``since <= timestamp < until``; with a ``date`` partition column also the days it implies."""
    predicates = []
    if since is not None:
        predicates.append(F.col(timestamp) >= instant(since))
        if date:
            predicates.append(F.col(date) >= day_of(since))
    if until is not None:
        predicates.append(F.col(timestamp) < instant(until))
        if date:
            predicates.append(F.col(date) <= day_of(until))
    return predicates


def attribute_column(key: str) -> str:
    """Column that holds one attribute on its own, in tables that keep it so."""
    return f"attr_{key}"


def has_attribute(key: str, value: str, columns: Collection[str] = ()) -> Column:
    """String equality on one attribute; a missing key does not match.

    A column of its own is pushed down and saves reading the map.
    """
    own = attribute_column(key)
    found = F.col(own) if own in columns else F.col("attributes_search")[key]
    return found == F.lit(value)


def before_cursor(cursor: QueryCursor, timestamp: str = "timestamp") -> Column:
    """``(timestamp, id) < cursor`` written so that it is pushed down to Parquet."""
    ts, at = F.col(timestamp), instant(cursor.millis)
    return (ts <= at) & ((ts < at) | (F.col("id") < F.lit(cursor.id)))


def predicates(query: Query, timestamp: str = "timestamp", columns: Collection[str] = ()) -> list[Column]:
    """Predicates of the present parameters; ``columns`` are those of the table."""
    found = []
    date = "log_date" if "log_date" in columns else None
    if query.service is not None:
        found.append(F.col("service") == F.lit(query.service))
    if query.level is not None:
        found.append(F.col("level") == F.lit(query.level))
    found += time_range(query.since, query.until, timestamp, date)
    found += [has_attribute(key, value, columns) for key, value in query.attributes.items()]
    if query.q is not None:
        found.append(contains_ignore_case(F.col("message"), query.q))
    cursor = getattr(query, "cursor", None)
    if cursor is not None:
        found.append(before_cursor(cursor, timestamp))
        if date:
            found.append(F.col(date) <= day_of(cursor.millis))
    return found


def apply_filters(df: DataFrame, query: Query, timestamp: str = "timestamp") -> DataFrame:
    """All predicates of the query, AND-combined. Uses a ``log_date`` column when there is one."""
    found = predicates(query, timestamp, df.columns)
    return df.where(reduce(and_, found)) if found else df
