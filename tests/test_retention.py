from datetime import UTC, datetime

import pytest
from cases import GOLDEN_NOW, body, golden, requests
from pyspark.sql import functions as F

from logweir.operators.retention import delete_by_id, retention_candidates, retention_keep, retention_plan, retention_report
from logweir.operators.rollup import minute_counts, rollup_purge, rollup_subtract
from logweir.params import LogQuery
from logweir.store import LogStore

NOW = datetime(2026, 8, 8, tzinfo=UTC)


def logs(spark, times):
    rows = [(i + 1, at) for i, at in enumerate(times)]
    return spark.createDataFrame(rows, "id long, at string").select("id", F.col("at").cast("timestamp").alias("timestamp"))


OLD = ["2026-07-0%dT00:00:00Z" % day for day in (5, 3, 3, 1, 8)]
EDGE = ["2026-07-09T00:00:00Z", "2026-08-01T00:00:00Z"]


@pytest.mark.parametrize(
    ("times", "size", "most", "outcome", "gone"),
    [
        (OLD + EDGE, 2, 10, (5, 3, False), {1, 2, 3, 4, 5}),
        (OLD + EDGE, 5, 1, (5, 1, True), {1, 2, 3, 4, 5}),
        (OLD + EDGE, 1, 2, (2, 2, True), {4, 2}),
        (OLD + EDGE, 3, 1, (3, 1, True), {4, 2, 3}),
        (EDGE, 2, 10, (0, 0, False), set()),
        (["2026-01-01T00:00:00Z"] * 25, 10, 2, (20, 2, True), set(range(1, 21))),
    ],
)
def test_plan(spark, times, size, most, outcome, gone):
    frame = logs(spark, times)
    plan = retention_plan(frame, NOW, 30, size, most)
    assert (plan.deleted, plan.batches, plan.has_more) == outcome
    report = retention_report(frame, NOW, 30, size, most).first()
    assert tuple(report) == ("2026-07-09T00:00:00.000Z", *outcome)
    everyone = set(range(1, len(times) + 1))
    assert {row.id for row in retention_candidates(frame, plan).collect()} == gone
    assert {row.id for row in retention_keep(frame, plan).collect()} == everyone - gone
    assert {row.id for row in delete_by_id(frame, retention_candidates(frame, plan)).collect()} == everyone - gone


def test_rollup_purge_and_subtract(spark):
    frame = logs(spark, ["2026-07-08T23:59:10Z", "2026-07-09T00:00:10Z", "2026-07-09T00:00:50Z", "2026-07-09T00:01:00Z"])
    frame = frame.select("*", F.lit("s").alias("service"), F.lit("info").alias("level"))
    counts, cutoff = minute_counts(frame), datetime(2026, 7, 9, 0, 0, 30, tzinfo=UTC)
    rows = lambda f: sorted((str(r.minute)[11:16], r["count"]) for r in f.collect())
    assert rows(rollup_purge(counts, cutoff)) == [("00:01", 1)]
    # The minute of the cutoff keeps the log that stays.
    assert rows(rollup_subtract(counts, frame.where("id <= 2"))) == [("00:00", 1), ("00:01", 1)]


def entry(at, message="m"):
    return {"timestamp": at, "level": "info", "service": "s", "message": message}


def messages(store):
    return {row.message for row in store.logs().collect()}


def minutes(store):
    return sorted((str(row.minute)[:16], row["count"]) for row in store.rollup().collect())


def test_store_cycle(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    old = [entry("2000-01-01T00:00:00Z", "one"), entry("2000-01-01T00:00:01Z", "two"), entry("2026-08-07T00:00:00Z", "fresh")]
    store.ingest(requests(spark, body(*old)), "a", GOLDEN_NOW)
    plan = store.apply_retention(NOW, 8_000, 1, 10)
    assert (plan.deleted, plan.batches, plan.has_more) == (2, 2, False)
    assert messages(store) == {"fresh"}
    assert minutes(store) == [("2026-08-07 00:00", 1)]
    assert not list(tmp_path.glob("logs/segment=a/log_date=2000-01-01"))


def test_store_bounded_cycles_and_late_logs(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    day = "2026-06-01T00:00:0%dZ"
    store.ingest(requests(spark, body(*(entry(day % i, f"old{i}") for i in range(5)), entry("2026-08-01T00:00:00Z", "new"))), "a", GOLDEN_NOW)
    plan = store.apply_retention(NOW, 30, 2, 1)
    assert (plan.deleted, plan.has_more) == (2, True)
    assert messages(store) == {"old2", "old3", "old4", "new"}
    # The rollup loses all minutes before the cutoff at once.
    assert minutes(store) == [("2026-08-01 00:00", 1)]
    # A late log older than what was deleted is visible until the next cycle.
    store.ingest(requests(spark, body(entry(day % 0, "late"))), "b", GOLDEN_NOW)
    assert messages(store) == {"old2", "old3", "old4", "new", "late"}
    assert minutes(store) == [("2026-06-01 00:00", 1), ("2026-08-01 00:00", 1)]
    plan = store.apply_retention(NOW, 30, 1, 1)
    assert plan.deleted == 1 and messages(store) == {"old2", "old3", "old4", "new"}
    assert minutes(store) == [("2026-08-01 00:00", 1)]
    store.compact("c")
    assert messages(store) == {"old2", "old3", "old4", "new"}
    plan = store.apply_retention(NOW, 30, 100, 1)
    assert plan.deleted == 3 and messages(store) == {"new"}
    assert [row.id for row in store.fetch_page(LogQuery())[0]] == [6]


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        retention_plan(logs(spark, OLD), NOW, 30, 0, 1)


def test_golden_store_keeps_all(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    assert store.logs().count() == 0 and store.rollup().count() == 0
    store.ingest(requests(spark, body(*golden())), "golden", GOLDEN_NOW)
    plan = store.apply_retention(NOW, 10_000, 10, 10)
    assert (plan.deleted, plan.batches, plan.has_more) == (0, 0, False)
    assert store.logs().count() == len(golden())
