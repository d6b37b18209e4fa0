"""Structured-log analytics on Spark DataFrames.

Import the operators from their modules, or use :class:`logweir.store.LogStore`
for a table set on a shared file system.
"""

from logweir.params import AggregateQuery, LogQuery, QueryCursor
from logweir.session import configure

__all__ = ["AggregateQuery", "LogQuery", "QueryCursor", "configure"]
