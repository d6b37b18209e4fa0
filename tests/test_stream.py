import os
import random

from cases import BASE, GOLDEN_NOW, body, entry, golden

from logweir.operators.rollup import minute_counts
from logweir.sources.requests import read_request_lines
from logweir.store import LogStore
from logweir.streaming.ingest import start_ingest_stream


def put(folder, name, lines, at):
    path = folder / name
    path.write_text("".join(line + "\n" for line in lines))
    os.utime(path, (at, at))


def run(store, folder, checkpoint, **options):
    query = start_ingest_stream(store, str(folder), str(checkpoint), "stream", now=GOLDEN_NOW, **options)
    query.awaitTermination()


def counts(frame):
    return sorted((row.minute, row.service, row.level, row["count"]) for row in frame.collect())


def test_stream_in_file_order(spark, tmp_path):
    folder, logs = tmp_path / "in", golden()
    folder.mkdir()
    store = LogStore(spark, str(tmp_path / "store"))
    put(folder, "b.txt", [body(*logs[:2]), body(logs[2], entry(level="x"))], 1_000_000)
    put(folder, "a.txt", [body(logs[3])], 2_000_000)
    put(folder, "c.txt", ["broken", body(*logs[4:6])], 3_000_000)
    run(store, folder, tmp_path / "cp", max_files=1)
    messages = [log["message"] for log in logs]
    assert [row.message for row in store.logs().orderBy("id").collect()] == messages[:6]
    assert store.rejects().count() == 1 and store.reports().count() == 5
    # A late file: an old timestamp is accepted into its old minute.
    put(folder, "d.txt", [body(*logs[6:])], 4_000_000)
    put(folder, "e.txt", [body(entry(timestamp="1999-01-01T00:00:00Z"))], 5_000_000)
    run(store, folder, tmp_path / "cp")
    rows = store.logs().orderBy("id").collect()
    assert [row.message for row in rows] == [*messages, BASE["message"]]
    assert [row.id for row in rows] == list(range(1, len(logs) + 2))
    assert counts(store.rollup()) == counts(minute_counts(store.logs()))


def test_lost_checkpoint_entry_is_replayed_once(spark, tmp_path):
    """A micro-batch that was written but not yet marked as done runs again."""
    folder = tmp_path / "in"
    folder.mkdir()
    store = LogStore(spark, str(tmp_path / "store"))
    put(folder, "a.txt", [body(*golden())], 1_000_000)
    run(store, folder, tmp_path / "cp")
    for path in (tmp_path / "cp/commits").glob("*0*"):
        path.unlink()
    run(store, folder, tmp_path / "cp")
    assert store.logs().count() == len(golden())
    assert sum(row["count"] for row in store.rollup().collect()) == len(golden())


def test_two_streams_of_one_name(spark, tmp_path):
    """Neither takes the other's batches for its own."""
    store, logs = LogStore(spark, str(tmp_path / "store")), golden()
    for name, part in (("a", logs[:3]), ("b", logs[3:])):
        (tmp_path / name).mkdir()
        put(tmp_path / name, "x.txt", [body(*part)], 1_000_000)
        run(store, tmp_path / name, tmp_path / f"cp-{name}")
    assert sorted(row.message for row in store.logs().collect()) == sorted(log["message"] for log in logs)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Small splits, several files: numbers follow file time, then line."""
    rng = random.Random(5)
    expected = []
    for i, name in enumerate(("z.txt", "m.txt", "a.txt")):
        lines = [f"{name} {n} " + "x" * rng.randrange(400) for n in range(200)]
        put(tmp_path, name, lines, 1_000_000 + i)
        expected += lines
    limits = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "10"}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        numbered = read_request_lines(spark, str(tmp_path)).orderBy("request_seq").collect()
        assert [row.body for row in numbered] == expected
        assert [row.request_seq for row in numbered] == list(range(600))
    finally:
        for key in limits:
            spark.conf.unset(key)
