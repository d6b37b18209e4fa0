"""Log tables on a shared file system.

A batch is written as a *segment*: its logs, rollup counts, rejects and report,
each in a folder of its own. The next version of the :mod:`logweir.ledger` then
makes it live. Readers see only segments of one version, so a half-written batch
is invisible and repeating it overwrites it; repeating a finished batch does
nothing. Several writers may work at once: ids are reserved before they are
written, and a version that another writer has taken is tried again.

    logs/segment=S/log_date=D    rollup/segment=S    rejects/segment=S    reports/segment=S
    ledger/<number>.json         retired/<name>      finished/<digest>    staging/segment=S
"""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir import schema
from logweir.functions.attributes import add_search_map
from logweir.functions.timestamps import FIRST_MILLIS, as_millis, bucket_start, from_millis, iso_of_millis
from logweir.ledger import Deletion, Ledger, Segment, Superseded, Version
from logweir.operators.buckets import bucket_counts
from logweir.operators.filters import attribute_column, instant
from logweir.operators.listing import fetch_page
from logweir.operators.ranking import assign_ids, time_ranges, up_to
from logweir.operators.retention import RetentionPlan, retention_plan
from logweir.operators.rollup import minute_counts, rollup_scan
from logweir.operators.validation import (
    LOG_FIELDS,
    accepted_rows,
    batch_report,
    settle_attribute_order,
    validate_entries,
)
from logweir.params import AggregateQuery, LogQuery, QueryCursor
from logweir.session import configure
from logweir.sources.requests import explode_requests, number_lines, parse_requests

SEGMENT = T.StructField("segment", T.StringType())
LOG_DATE = T.StructField("log_date", T.DateType())
RETIRED = T.StructType([*schema.ROLLUP, SEGMENT])
#: Folders of retired counts from which on the next cycle sums them up in one.
MANY_RETIRED = 8
#: Times that work is prepared anew because its segments have changed.
ATTEMPTS = 5
PAGE_WINDOWS = (timedelta(hours=1), timedelta(days=1), timedelta(days=30))


class LogStore:
    """A set of tables under ``root``.

    ``indexed`` names attributes that are often searched: segments written from
    now on keep each in a column of its own with a bloom filter. A writer adds
    the names that the live segments have, so the list stays with the table.
    """

    def __init__(self, spark: SparkSession, root: str, indexed: tuple[str, ...] = ()) -> None:
        if not all(re.fullmatch("[A-Za-z0-9_]{1,128}", key) for key in indexed):
            raise ValueError("indexed attributes need plain names")
        if len({key.lower() for key in indexed}) < len(indexed):
            raise ValueError("indexed attributes must differ in more than case")
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.indexed = indexed
        self.ledger = Ledger(self.spark, self.root)

    # -- files and metadata -------------------------------------------------

    def _folder(self, table: str, segment: str) -> str:
        return f"{self.root}/{table}/segment={segment}"

    def _file_system(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _drop(self, path: str) -> None:
        files, hadoop = self._file_system(path)
        files.delete(hadoop, True)

    def _read(self, table: str, layout: T.StructType, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], layout)
        folders = [self._folder(table, name) for name in segments]
        return self.spark.read.schema(layout).option("basePath", f"{self.root}/{table}").parquet(*folders)

    # -- tables -------------------------------------------------------------

    @staticmethod
    def _groups(version: Version) -> list[tuple[list[Segment], list[Deletion]]]:
        """Live segments by the deletions that apply to them; as many groups as deletions, and one more, at most."""
        found: dict[tuple[Deletion, ...], list[Segment]] = {}
        for segment in sorted(version.live, key=lambda segment: segment.name):
            found.setdefault(tuple(d for d in version.deletions if segment.seq <= d.seq), []).append(segment)
        return [(segments, list(deletions)) for deletions, segments in found.items()] or [([], [])]

    def _logs(self, version: Version, with_segment: bool = False) -> DataFrame:
        # An attribute column can be used when every segment has it.
        shared = set.intersection(*(set(segment.indexed) for segment in version.live)) if version.live else ()
        own = [T.StructField(attribute_column(key), T.StringType()) for key in sorted(shared)]
        layout = T.StructType([*schema.LOG, *own, LOG_DATE, SEGMENT])
        parts = []
        for segments, deletions in self._groups(version):
            logs = self._read("logs", layout, [segment.name for segment in segments])
            for d in deletions:
                logs = logs.where(~up_to((d.last_millis, d.last_id)))
            parts.append(logs)
        logs = reduce(DataFrame.unionByName, parts)
        return logs if with_segment else logs.drop("segment")

    def _retired(self, version: Version) -> DataFrame | None:
        """Counts that deletions take off, by the segment they were in."""
        folders = [f"{self.root}/retired/{name}" for name in version.retired]
        return self.spark.read.schema(RETIRED).parquet(*folders) if folders else None

    def _deltas(self, version: Version) -> DataFrame:
        retired, parts = self._retired(version), []
        for segments, deletions in self._groups(version):
            names = [segment.name for segment in segments]
            deltas = self._read("rollup", RETIRED, names)
            if retired is not None and names:
                deltas = deltas.unionByName(retired.where(F.col("segment").isin(names)))
            for d in deletions:
                if not d.exact:
                    deltas = deltas.where(F.col("minute") >= instant(d.cutoff_millis))
            parts.append(deltas)
        return reduce(DataFrame.unionByName, parts).select("minute", "service", "level", "count")

    def logs(self) -> DataFrame:
        return self._logs(self.ledger.newest())

    def rollup_deltas(self) -> DataFrame:
        """Unmerged counts; :func:`bucket_counts` sums them as they are."""
        return self._deltas(self.ledger.newest())

    def rollup(self) -> DataFrame:
        return rollup_scan(self.rollup_deltas())

    def rejects(self) -> DataFrame:
        return self._read("rejects", T.StructType([*schema.REJECT, SEGMENT]), sorted(self.ledger.newest().names()))

    def reports(self, segment: str | None = None) -> DataFrame:
        segments = [segment] if segment else sorted(self.ledger.newest().names())
        return self._read("reports", T.StructType([*schema.REPORT, SEGMENT]), segments)

    # -- ingestion ----------------------------------------------------------

    def ingest(self, requests: DataFrame, segment: str, now: datetime | str) -> None:
        """Validate and append ``(request_seq, body)`` or placed text lines as one batch.

        ``segment`` names the batch and is the same when it is repeated.
        """
        version = self.ledger.newest()
        if self.ledger.is_finished(version, segment):
            return

        # Parsed and checked once; everything below reads this table.
        staging = self._folder("staging", segment)
        validated = validate_entries(explode_requests(parse_requests(requests)), now)
        validated.write.mode("overwrite").parquet(staging)
        staged = self.spark.read.schema(validated.schema).parquet(staging)
        by_line = "place" in staged.columns
        if by_line:
            staged = number_lines(staged)
        entries = staged.where(F.col("entry_index").isNotNull())

        slow_numbers, order_unsure, total, last_millis = staged.agg(
            F.bool_or("slow_numbers"),
            F.bool_or("order_unsure"),
            F.count_if(F.col("entry_index").isNotNull() & F.col("reason").isNull()),
            F.max(F.unix_millis("timestamp")),
        ).first()
        first_id = self.ledger.reserve(segment, total)

        accepted = accepted_rows(entries)
        accepted = add_search_map(accepted) if slow_numbers else accepted.drop("slow_numbers")
        accepted = assign_ids(accepted, first_id)
        indexed = self._indexed(version)
        self._write_logs(accepted.select("id", *LOG_FIELDS), entries.where(F.col("reason").isNull()), segment, indexed)
        written = self._read("logs", T.StructType([*schema.LOG, LOG_DATE, SEGMENT]), [segment])
        self._write_rollup(minute_counts(written), segment)

        refused = entries.where(F.col("reason").isNotNull())
        if order_unsure:
            rejects = settle_attribute_order(refused, number_lines(requests) if by_line else requests)
        else:
            rejects = refused.select("request_seq", "entry_index", "reason", "raw")
        rejects.write.mode("overwrite").parquet(self._folder("rejects", segment))
        rejects = self._read("rejects", schema.REJECT, [segment])
        outcomes = (
            entries.where(F.col("reason").isNull())
            .select("request_seq", "entry_index", "reason")
            .unionByName(rejects.select("request_seq", "entry_index", "reason"))
        )
        states = staged.where(F.col("entry_index").isNull()).select("request_seq", "n_entries", "error")
        batch_report(states, outcomes).write.mode("overwrite").parquet(self._folder("reports", segment))

        self.ledger.add(Segment(segment, 0, first_id, first_id + total, tuple(indexed), last_millis))
        self._drop(staging)

    def _indexed(self, version: Version) -> list[str]:
        """The attribute columns of a new segment; names that differ in case only are one column."""
        names = {key.lower(): key for segment in version.live for key in segment.indexed}
        return sorted({**names, **{key.lower(): key for key in self.indexed}}.values())

    def _write_logs(self, logs: DataFrame, spans: DataFrame, segment: str, indexed: list[str]) -> None:
        """One day per file, sorted for row-group skipping.

        Tasks get ranges of time, so a hot day, or a hot instant, is split over
        several files that a short time range does not all touch. The ranges
        come from counts of ``spans``, a frame with the same timestamps, instead of a
        sample of ``logs``, which would be computed twice for it.
        """
        own = {attribute_column(key): F.col("attributes_search")[key] for key in indexed}
        dated = logs.withColumns({**own, "log_date": F.to_date("timestamp")})
        ranged = time_ranges(dated, spans, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        writer = ranged.sortWithinPartitions("log_date", "timestamp", "id").write.mode("overwrite").partitionBy("log_date")
        for name in own:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer.parquet(self._folder("logs", segment))

    def _write_rollup(self, counts: DataFrame, segment: str) -> None:
        """Sorted by minute, so that a time range reads a part of the files."""
        counts.orderBy("minute", "service", "level").write.mode("overwrite").parquet(self._folder("rollup", segment))

    # -- queries ------------------------------------------------------------

    def bucket_counts(self, query: AggregateQuery, source: str = "auto") -> DataFrame:
        version = self.ledger.newest()
        # Unless it is exact, a cycle drops all rollup minutes before its cutoff, but logs in bounded numbers.
        purged = max((d.cutoff_millis for d in version.deletions if not d.exact), default=None)
        complete_from = None if purged is None else from_millis(purged)
        return bucket_counts(self._logs(version), self._deltas(version), query, source, complete_from)

    def fetch_page(self, query: LogQuery) -> tuple[list[Row], QueryCursor | None]:
        """A page, read from as short a time range as fills it.

        The newest hour is tried first, then the newest day and month, then the
        whole range; a range that holds more rows than the page holds all of the
        page, so the result is that of the whole range. The newest time is known
        from the ledger.
        """
        version = self.ledger.newest()
        logs = self._logs(version)
        upper = max((segment.last_millis for segment in version.live if segment.last_millis is not None), default=None)
        ends = [upper + 1] if upper is not None else []
        ends += [query.cursor.millis] if query.cursor else []
        ends += [as_millis(query.until)] if query.until else []
        for window in PAGE_WINDOWS if ends else ():
            millis = min(ends) - window // timedelta(milliseconds=1)
            if millis < FIRST_MILLIS or query.since is not None and millis <= as_millis(query.since):
                break
            since = from_millis(millis)
            rows, cursor = fetch_page(logs, replace(query, since=since))
            if cursor is not None:
                return rows, cursor
        return fetch_page(logs, query)

    # -- retention and compaction -------------------------------------------

    def apply_retention(self, now: datetime, days: float, batch_size: int, max_batches: int, exact: bool = False) -> RetentionPlan:
        """Delete the oldest expired logs of one cycle and all rollup minutes before the cutoff.

        With ``exact`` the rollup loses just the counts of the deleted logs
        instead, so that it equals the logs' after every cycle, a capped one too;
        all cycles before must have been exact as well.

        The deletion is a small record of "everything up to this row" that
        readers apply, so no data is rewritten and a crash leaves either the old
        or the new state; an exact one's counts, negated, become valid with it.
        Days that are gone entirely are then removed from disk.
        """
        for _ in range(ATTEMPTS):
            version = self.ledger.newest()
            if exact and not all(d.exact for d in version.deletions):
                raise ValueError("earlier cycles have dropped whole minutes, so the rollup cannot be kept exact")
            plan = retention_plan(self._logs(version), now, days, batch_size, max_batches)
            # Without a last row, everything before the cutoff goes.
            last_at, last_id = plan.last or (as_millis(plan.cutoff) - 1, version.next_id)
            deletion = Deletion(version.number, last_at, last_id, as_millis(plan.cutoff), exact)
            retired = self._retire(version, plan) if exact and plan.deleted else version.retired
            try:
                self.ledger.delete(deletion, version, retired)
            except Superseded:
                continue
            for name in {*version.retired} - {*retired}:
                self._drop(f"{self.root}/retired/{name}")
            self._drop_days_before(iso_of_millis(last_at)[:10], version.names())
            return plan
        raise RuntimeError("segments kept changing while a deletion was planned")

    def _retire(self, version: Version, plan: RetentionPlan) -> tuple[str, ...]:
        """The folders of retired counts with those of ``plan``; many of them become one."""
        gone = self._logs(version, with_segment=True).where(plan.deletes())
        counts = gone.groupBy("segment", bucket_start(F.col("timestamp"), 60).alias("minute"), "service", "level")
        counts = counts.agg((-F.count("*")).alias("count"))
        others = version.retired
        if len(others) >= MANY_RETIRED:
            known = self._retired(version).where(F.col("segment").isin(version.names()))
            counts = counts.unionByName(known).groupBy("segment", "minute", "service", "level").agg(F.sum("count").alias("count"))
            others = ()
        name = uuid4().hex
        counts.write.parquet(f"{self.root}/retired/{name}")
        return (*others, name)

    def _drop_days_before(self, day: str, segments: list[str]) -> None:
        for segment in segments:
            files, hadoop = self._file_system(self._folder("logs", segment))
            for status in files.listStatus(hadoop):
                name = status.getPath().getName()
                if name.startswith("log_date=") and name.removeprefix("log_date=") < day:
                    files.delete(status.getPath(), True)

    def compact(self, segment: str, segments: list[str] | None = None) -> None:
        """Merge segments (all live ones by default) into a new one and remove the old files."""
        for _ in range(ATTEMPTS):
            version = self.ledger.newest()
            if self.ledger.is_finished(version, segment):
                return
            merged = tuple(each for each in version.live if segments is None or each.name in segments)
            if not merged:
                return
            old = tuple(sorted(each.name for each in merged))
            part = replace(version, live=merged)
            indexed = self._indexed(version)
            logs = self._logs(part)
            self._write_logs(logs.select("id", *LOG_FIELDS), logs, segment, indexed)
            self._write_rollup(rollup_scan(self._deltas(part)), segment)
            for table, layout in (("rejects", schema.REJECT), ("reports", schema.REPORT)):
                self._read(table, layout, list(old)).write.mode("overwrite").parquet(self._folder(table, segment))
            ids = min(each.first_id for each in merged), max(each.next_id for each in merged)
            last_millis = max((each.last_millis for each in merged if each.last_millis is not None), default=None)
            try:
                self.ledger.add(Segment(segment, 0, *ids, tuple(indexed), last_millis), old, version)
            except Superseded:
                continue
            for name in old:
                for table in ("logs", "rollup", "rejects", "reports"):
                    self._drop(self._folder(table, name))
            return
        raise RuntimeError("segments kept changing while they were merged")
