"""Continuous ingestion of request files into a :class:`logweir.store.LogStore`.

Each micro-batch is one segment, written completely or not at all. Late logs are
accepted like any other, so there is no watermark and no streaming state.
"""

from __future__ import annotations

from concurrent.futures import Future
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from logweir.sources.requests import LINE_COLUMNS, place_lines
from logweir.store import LogStore


def start_ingest_stream(
    store: LogStore,
    input_dir: str,
    checkpoint: str,
    name: str,
    max_files: int | None = None,
    max_bytes: str | None = None,
    every: str | None = None,
    now: datetime | str | None = None,
) -> StreamingQuery:
    """Ingest text files with one request body per line.

    ``max_files`` or ``max_bytes`` bounds a micro-batch, ``every`` sets the
    trigger interval; without it the stream drains what is there and stops.
    A request is one line, so it is never split over batches. Segment
    names hold ``name`` and the stream's own id, which its checkpoint keeps: a
    restarted stream goes on with its segments, and another stream of the same
    name, or one with a new checkpoint, has others. ``now`` fixes the clock, for
    tests.
    """
    reader = store.spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    lines = reader.load(input_dir).selectExpr(*LINE_COLUMNS)

    started: Future[str] = Future()

    def write(batch: DataFrame, batch_id: int) -> None:
        received = now or datetime.now(UTC)
        store.ingest(place_lines(batch), f"{name}-{started.result()}-{batch_id:012d}", received)

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = writer.trigger(**trigger).start()
    started.set_result(query.id)
    return query
