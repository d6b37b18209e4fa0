"""The golden logs, ingested into a store, against filters and counts in Python."""

import itertools
import json
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from cases import GOLDEN_NOW, body, golden, requests
from pyspark.sql import functions as F

from logweir.functions.timestamps import iso_timestamp
from logweir.operators.buckets import bucket_counts, sum_rollup
from logweir.operators.listing import list_logs, list_page, page_after, paged_export
from logweir.operators.rollup import merge_rollup, minute_counts, rebuild_rollup
from logweir.params import AggregateQuery, LogQuery
from logweir.store import LogStore

LOGS = [{"id": i, **log} for i, log in enumerate(golden(), 1)]
SECONDS = {"1m": 60, "5m": 300, "1h": 3_600, "1d": 86_400}
RANGES = [
    {"since": "2011-03-05T09:10:00Z", "until": "2011-03-05T09:16:00Z"},
    {"since": "2011-03-05T00:00:00Z", "until": "2011-03-07T00:00:00Z"},
    {"since": "2011-03-05T14:10:00+05:00", "until": "2011-03-05T16:00:00.001+05:00"},
    {"since": "2011-03-05T04:15:00-05:00", "until": "2011-03-05T19:00:00.001-05:00"},
]
FILTERS = [
    {}, {"service": "yard"}, {"service": ""}, {"level": "warn", "service": "yard"}, {"attributes": {"kilos": "2.5"}}, {"attributes": {"kilos": "-7"}},
    {"attributes": {"sealed": "false", "crate": LOGS[0]["attributes"]["crate"]}}, {"attributes": {"dock": "east"}}, {"attributes": {"absent": "x"}},
    {"q": "idle"}, {"q": "50%"}, {"q": "_"}, {"q": "\\"}, {"q": "CRANE", "level": "warn"}, {"q": "nowhere"}, {"q": "' OR 'a'='a"},
    {"attributes": {"crate": "%"}}, {"service": "yard\"; --"},
]


def at(log) -> datetime:
    return datetime.fromisoformat(log["timestamp"])


def text(value) -> str:
    return json.dumps(value) if isinstance(value, bool) else str(value)


def matching(since=None, until=None, service=None, level=None, attributes=None, q=None):
    """The golden logs that fit, newest first."""
    found = [
        log for log in LOGS
        if (since is None or at(log) >= datetime.fromisoformat(since)) and (until is None or at(log) < datetime.fromisoformat(until))
        and service in (None, log["service"]) and level in (None, log["level"]) and (q or "").lower() in log["message"].lower()
        and all(k in log["attributes"] and text(log["attributes"][k]) == v for k, v in (attributes or {}).items())
    ]
    return sorted(found, key=lambda log: (at(log), log["id"]), reverse=True)


def expected_ids(**params):
    return [log["id"] for log in matching(**params)]


def start(log, seconds: int) -> str:
    epoch = int(at(log).timestamp())
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=epoch - epoch % seconds)).strftime("%Y-%m-%dT%H:%M")


def expected_buckets(bucket, group_by=None, **params):
    counts = Counter((start(log, SECONDS[bucket]), log[group_by] if group_by else None) for log in matching(**params))
    return [(*key, n) for key, n in sorted(counts.items(), key=repr)]


def buckets(frame):
    return [(row[0][:16], row[1], row[2]) for row in frame.select(iso_timestamp(F.col("start")), "group", "count").collect()]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = LogStore(spark, str(tmp_path_factory.mktemp("golden")))
    store.ingest(requests(spark, body(*golden())), "golden", GOLDEN_NOW)
    return store


def ids(frame):
    return [row.id for row in frame.collect()]


@pytest.mark.parametrize("filters", FILTERS, ids=str)
def test_list(store, filters):
    for limits in ({}, RANGES[0], RANGES[2]):
        rows, cursor = store.fetch_page(LogQuery(**filters, **limits))
        assert [row.id for row in rows] == expected_ids(**filters, **limits) and cursor is None
    assert ids(list_logs(store.logs(), LogQuery(**filters))) == expected_ids(**filters)


@pytest.mark.parametrize("limits", RANGES, ids=str)
def test_ranges_in_any_zone(store, limits):
    """Parameters, and datetimes of other zones, against stored days."""
    zoned = {name: datetime.fromisoformat(value) for name, value in limits.items()}
    for params in (limits, zoned):
        assert ids(list_logs(store.logs(), LogQuery(**params))) == expected_ids(**limits)
        for source in ("base", "exact"):
            assert buckets(store.bucket_counts(AggregateQuery(bucket="1h", **params), source)) == expected_buckets("1h", **limits)


def pages(store, **params):
    found, cursor = [], None
    while True:
        rows, cursor = store.fetch_page(LogQuery(**params, cursor=cursor))
        found.append([row.id for row in rows])
        if cursor is None:
            return found


@pytest.mark.parametrize(("limit", "filters"), [(1, RANGES[0]), (2, {}), (3, {"service": "yard"}), (len(LOGS), {}), (6, RANGES[3])], ids=str)
def test_pages(store, limit, filters):
    every = expected_ids(**filters)
    assert pages(store, limit=limit, **filters) == [every[k : k + limit] for k in range(0, len(every), limit)]


def test_cursor_of_another_zone(store):
    """A cursor is an instant; its zone must not move the day that is read."""
    every = expected_ids()
    _, cursor = store.fetch_page(LogQuery(limit=1))
    west = datetime.fromisoformat("2011-03-05T19:00:00-05:00")
    for position in (cursor, type(cursor)(west, every[0])):
        assert ids(page_after(store.logs(), position, 20)) == every[1:]
    assert ids(page_after(store.logs(), type(cursor)(west, every[0] + 1), 20)) == every


def test_page_frame(store):
    shown = ("id", "position", iso_timestamp(F.col("next_timestamp")).alias("at"), "next_id")
    every = matching()
    page = sorted(map(tuple, list_page(store.logs(), LogQuery(limit=3)).select(*shown).collect()), key=lambda row: row[1])
    assert page == [(every[k]["id"], k + 1, every[2]["timestamp"], every[2]["id"]) for k in range(3)]
    whole = list_page(store.logs(), LogQuery(limit=len(LOGS))).select("next_timestamp", "next_id").distinct().collect()
    assert [tuple(row) for row in whole] == [(None, None)]


def test_export(store):
    exported = paged_export(store.logs(), 3).orderBy("page", "position").select("id", "page", "position").collect()
    assert [tuple(row) for row in exported] == [(i, k // 3, k % 3 + 1) for k, i in enumerate(expected_ids())]


@pytest.mark.parametrize(("bucket", "group_by"), itertools.product(SECONDS, (None, "level", "service")))
def test_buckets(store, bucket, group_by):
    for filters, limits in [(f, RANGES[1]) for f in FILTERS[::5]] + [(FILTERS[1], r) for r in RANGES]:
        query = AggregateQuery(bucket=bucket, group_by=group_by, **filters, **limits)
        assert buckets(store.bucket_counts(query, "exact")) == expected_buckets(bucket, group_by, **filters, **limits)
    query = AggregateQuery(bucket=bucket, group_by=group_by, **RANGES[0])
    for source in ("auto", "base", "rollup"):
        assert buckets(store.bucket_counts(query, source)) == expected_buckets(bucket, group_by, **RANGES[0])


def test_source_rules(store):
    with pytest.raises(ValueError):
        sum_rollup(store.rollup(), AggregateQuery(bucket="5m", q="lane", **RANGES[0]))
    query = AggregateQuery(bucket="5m", **RANGES[0])
    assert buckets(bucket_counts(store.logs(), None, query)) == expected_buckets("5m", **RANGES[0])


@pytest.mark.parametrize("limits", [("09:49:30", "09:50:30"), ("09:49:30", "09:49:59.5"), ("10:19:29.384", "12:05:00"), ("12:04:52.003", "12:04:52.005")])
def test_edges_inside_a_minute(store, limits):
    since, until = (f"2011-03-05T{clock}Z" for clock in limits)
    query = AggregateQuery(bucket="1m", since=since, until=until)
    expected = expected_buckets("1m", since=since, until=until)
    assert buckets(store.bucket_counts(query, "base")) == expected
    assert buckets(store.bucket_counts(query, "exact")) == expected
    minutes = [row for row in expected_buckets("1m") if since <= f"{row[0]}:00Z" < until]
    assert buckets(store.bucket_counts(query, "rollup")) == minutes


def rollup_rows(frame):
    rows = frame.select(iso_timestamp(F.col("minute")), "service", "level", "count").collect()
    return sorted((row[0][:16], *row[1:]) for row in rows)


def test_rollup(store):
    expected = sorted((start(log, 60), log["service"], log["level"], 1) for log in LOGS)
    assert rollup_rows(store.rollup()) == expected
    counts = minute_counts(store.logs())
    assert rollup_rows(counts) == expected
    doubled = merge_rollup(counts, counts)
    assert rollup_rows(doubled) == [(*row[:3], 2) for row in expected]
    assert rollup_rows(rebuild_rollup(doubled, store.logs())) == expected
    first = {(start(log, 60), log["service"], log["level"]) for log in LOGS[:2]}
    rebuilt = rollup_rows(rebuild_rollup(doubled, store.logs().where("id <= 2")))
    assert rebuilt == [(*row[:3], 1 if row[:3] in first else 2) for row in expected]


def test_stored_attributes(store):
    for row in store.logs().select("id", F.to_json("attributes").alias("json"), "attributes_search").collect():
        sent = LOGS[row.id - 1]["attributes"]
        assert json.loads(row.json) == sent and row.attributes_search == {key: text(value) for key, value in sent.items()}
