import json
from datetime import UTC, datetime

import pytest
from cases import GOLDEN_NOW, body, entry, golden, requests
from pyspark.sql import functions as F

from logweir import store as store_module
from logweir.ledger import Ledger
from logweir.operators import ranking
from logweir.operators.rollup import minute_counts
from logweir.params import AggregateQuery, LogQuery, QueryCursor
from logweir.store import LogStore


def keys(frame):
    return sorted((row.id, row.message) for row in frame.collect())


def search_map(log):
    return {key: json.dumps(value) if isinstance(value, bool) else str(value) for key, value in log["attributes"].items()}


def counts(frame):
    return sorted((row.minute, row.service, row.level, row["count"]) for row in frame.collect())


def ingest_three(spark, store):
    logs = golden()
    store.ingest(requests(spark, body(*logs[:2]), body(logs[2])), "b1", GOLDEN_NOW)
    store.ingest(requests(spark, body(*logs[3:5], entry(level="x"))), "b2", GOLDEN_NOW)
    store.ingest(requests(spark, body(*logs[5:])), "b3", GOLDEN_NOW)


EXPECTED = [(i + 1, log["message"]) for i, log in enumerate(golden())]


def test_batches_and_replay(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    ingest_three(spark, store)
    ingest_three(spark, store)
    assert keys(store.logs()) == EXPECTED
    assert counts(store.rollup()) == counts(minute_counts(store.logs()))
    rejects = [tuple(row)[:3] for row in store.rejects().collect()]
    assert rejects == [(0, 2, "invalid level: 'x'")]
    assert [(r.request_seq, r.accepted) for r in store.reports("b1").orderBy("request_seq").collect()] == [(0, 2), (1, 1)]
    assert not list((tmp_path / "staging").glob("segment=*"))


def test_unfinished_batch_is_invisible_and_repeatable(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path))
    logs = golden()
    store.ingest(requests(spark, body(*logs[:3])), "b1", GOLDEN_NOW)
    with monkeypatch.context() as patch:
        def fail(*_):
            raise RuntimeError("lost")

        patch.setattr(Ledger, "add", fail)
        with pytest.raises(RuntimeError):
            store.ingest(requests(spark, body(*logs)), "b2", GOLDEN_NOW)
    assert keys(store.logs()) == EXPECTED[:3]
    assert counts(store.rollup()) == counts(minute_counts(store.logs()))
    # The repeat has other content for a day that the failed attempt wrote as well.
    store.ingest(requests(spark, body(*logs[3:])), "b2", GOLDEN_NOW)
    assert keys(store.logs()) == EXPECTED
    assert counts(store.rollup()) == counts(minute_counts(store.logs()))


def test_batch_without_accepted_logs(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    store.ingest(requests(spark, "{}", body(), body(entry(service=""))), "b1", GOLDEN_NOW)
    store.ingest(requests(spark, body(*golden())), "b2", GOLDEN_NOW)
    assert keys(store.logs()) == EXPECTED
    found = [(r.status, r.accepted) for r in store.reports("b1").orderBy("request_seq").collect()]
    assert found == [("refused", 0), ("all_rejected", 0), ("all_rejected", 0)]


def test_duplicates_are_stored_twice(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    store.ingest(requests(spark, body(golden()[0], golden()[0])), "b1", GOLDEN_NOW)
    assert [row.id for row in store.logs().orderBy("id").collect()] == [1, 2]
    assert [row["count"] for row in store.rollup().collect()] == [2]


def test_rare_values_take_the_slow_paths(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    first = golden()[0]
    odd = json.dumps({**first, "attributes": {**first["attributes"], "kilos": "?"}}).replace('"?"', "1e2")
    bad = entry(timestamp="2006-01-01T00:00:00Z", attributes={"z": None, "a": []})
    store.ingest(requests(spark, '{"logs":[%s,%s]}' % (odd, json.dumps(bad))), "b1", GOLDEN_NOW)
    assert store.logs().first().attributes_search == {**search_map(first), "kilos": "100"}
    reason = "invalid attributes.z: must be string, number, or boolean"
    assert store.rejects().first().reason == reason
    assert [tuple(x) for x in store.reports().first().rejected] == [(1, reason)]


def test_compaction(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    ingest_three(spark, store)
    rollup = counts(store.rollup())
    store.compact("c1", ["b1", "b2"])
    store.compact("c1", ["b1", "b2"])
    assert keys(store.logs()) == EXPECTED and counts(store.rollup()) == rollup
    assert sorted(p.name for p in (tmp_path / "logs").glob("segment=*")) == ["segment=b3", "segment=c1"]
    ingest_three(spark, store)  # replays of merged batches still change nothing
    assert keys(store.logs()) == EXPECTED
    store.compact("c2")
    store.ingest(requests(spark, body(golden()[0])), "b4", GOLDEN_NOW)
    assert keys(store.logs()) == EXPECTED + [(len(EXPECTED) + 1, EXPECTED[0][1])]
    assert store.reports().count() == 5 and store.rejects().count() == 1


def test_files_are_clustered(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    store.ingest(requests(spark, body(*golden())), "b1", GOLDEN_NOW)
    days = sorted(p.name for p in (tmp_path / "logs/segment=b1").glob("log_date=*"))
    assert days == sorted({"log_date=" + log["timestamp"][:10] for log in golden()}) and len(days) == 2
    assert all(len(list((tmp_path / "logs/segment=b1" / day).glob("*.parquet"))) == 1 for day in days)
    first = spark.read.parquet(str(tmp_path / "logs/segment=b1/log_date=2011-03-05"))
    rows = first.select("timestamp", "id").collect()
    assert rows == sorted(rows)


def test_page_window_widens(spark, tmp_path, monkeypatch):
    """A page is the same whatever time window it was found in."""
    store = LogStore(spark, str(tmp_path))
    ingest_three(spark, store)
    n = len(EXPECTED)
    for limit in (1, 2, 3, n - 1, n):
        rows, cursor = store.fetch_page(LogQuery(limit=limit))
        with monkeypatch.context() as patch:
            patch.setattr(store_module, "PAGE_WINDOWS", ())
            whole, whole_cursor = store.fetch_page(LogQuery(limit=limit))
        assert [row.id for row in rows] == [row.id for row in whole] == list(range(n, 0, -1))[:limit]
        assert cursor == whole_cursor and (cursor is None) == (limit == n)
    assert store.logs().where(F.col("log_date") == F.to_date("timestamp")).count() == n


def test_indexed_attributes(spark, tmp_path):
    logs = golden()
    LogStore(spark, str(tmp_path)).ingest(requests(spark, body(*logs[:3])), "b1", GOLDEN_NOW)
    store = LogStore(spark, str(tmp_path), indexed=("crate", "sealed"))
    store.ingest(requests(spark, body(*logs[3:])), "b2", GOLDEN_NOW)
    wanted = search_map(logs[3])
    wanted = {key: wanted[key] for key in ("crate", "sealed")}
    expected = [i for i, log in reversed(list(enumerate(logs, 1))) if wanted.items() <= search_map(log).items()]
    query = LogQuery(attributes=wanted)
    # One segment has no such columns: the map decides everywhere.
    assert "attr_crate" not in store.logs().columns
    assert [row.id for row in store.fetch_page(query)[0]] == expected
    store.compact("c1")
    assert {"attr_crate", "attr_sealed"} <= set(store.logs().columns)
    assert [row.id for row in store.fetch_page(query)[0]] == expected
    with pytest.raises(ValueError):
        LogStore(spark, str(tmp_path), indexed=("a.b",))


def deep(n: int) -> str:
    """Request of ``n`` entries with two bad attributes each, sent against the order of their names."""
    bad = ",".join('{"timestamp":"2021-01-01T00:00:00Z","level":"info","service":"s","message":"m%d","attributes":{"z":[],"a":{}}}' % i for i in range(n))
    return '{"logs":[%s]}' % bad


def test_several_bad_attributes_in_a_full_request(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    store.ingest(requests(spark, deep(5_000), body(golden()[0])), "b1", GOLDEN_NOW)
    reasons = store.rejects().groupBy("reason").count().collect()
    assert [(row.reason, row["count"]) for row in reasons] == [("invalid attributes.z: must be string, number, or boolean", 5_000)]
    assert store.logs().count() == 1


def test_text_behind_a_body(spark, tmp_path):
    one = body(golden()[0])
    texts = [one, one + one, one + " garbage", one + "]x", one + ',{"logs":[]}', one + ',"x"', one + "\n", "[" + one + "]", "", "null"]
    store = LogStore(spark, str(tmp_path))
    store.ingest(requests(spark, *texts), "b1", GOLDEN_NOW)
    status = [row.status for row in store.reports().orderBy("request_seq").collect()]
    assert status == ["ok"] + ["refused"] * 5 + ["ok"] + ["refused"] * 3 and store.logs().count() == 2


def test_year_zero(spark, tmp_path):
    """Rows of year 0 are listed, paged and expire."""
    store = LogStore(spark, str(tmp_path))
    old = [entry(timestamp=f"0000-01-0{day}T00:00:00Z", message=f"old {day}") for day in (1, 2, 3)]
    store.ingest(requests(spark, body(*old, golden()[0])), "b1", GOLDEN_NOW)
    found, cursor = [], None
    while True:
        rows, cursor = store.fetch_page(LogQuery(limit=1, cursor=cursor))
        found += [row.message for row in rows]
        if cursor is None:
            break
        cursor = QueryCursor.parse(str(cursor))
    assert found == [golden()[0]["message"], "old 3", "old 2", "old 1"]
    plan = store.apply_retention(datetime(2000, 1, 1, tzinfo=UTC), 1, 2, 1)
    assert plan.deleted == 2 and plan.has_more
    assert sorted(row.message for row in store.logs().select("message").collect()) == sorted([golden()[0]["message"], "old 3"])


def test_exact_after_a_capped_cycle(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    store.ingest(requests(spark, body(*golden())), "b1", GOLDEN_NOW)
    now = datetime.fromisoformat(golden()[4]["timestamp"])
    assert store.apply_retention(now, 0, 1, 2).deleted == 2
    query = AggregateQuery(since="2011-03-05T09:00:10Z", until="2011-03-06T00:00:30Z", bucket="1m", group_by="service")
    base = store.bucket_counts(query, "base").collect()
    assert sum(row["count"] for row in base) == len(golden()) - 2 and store.bucket_counts(query, "exact").collect() == base


def test_index_stays_with_the_table(spark, tmp_path):
    LogStore(spark, str(tmp_path), indexed=("crate",)).ingest(requests(spark, body(*golden()[:3])), "b1", GOLDEN_NOW)
    plain = LogStore(spark, str(tmp_path))
    plain.ingest(requests(spark, body(*golden()[3:])), "b2", GOLDEN_NOW)
    assert "attr_crate" in plain.logs().columns
    plain.compact("c1")
    crates = [log["attributes"]["crate"] for log in golden()]
    assert "attr_crate" in plain.logs().columns and plain.logs().where(F.col("attr_crate") == crates[0]).count() == crates.count(crates[0])
    with pytest.raises(ValueError, match="case"):
        LogStore(spark, str(tmp_path), indexed=("User", "user"))


def test_files_of_a_day_are_ranges_of_time(spark, tmp_path, monkeypatch):
    rows = [entry(timestamp=f"2011-03-05T{h:02d}:{m:02d}:00Z") for m in range(0, 60, 2) for h in range(24)]
    monkeypatch.setattr(ranking, "FEW_ROWS", 100)
    LogStore(spark, str(tmp_path)).ingest(requests(spark, body(*rows[:360]), body(*rows[360:])), "b1", GOLDEN_NOW)
    files = spark.read.parquet(str(tmp_path / "logs/segment=b1")).groupBy(F.input_file_name())
    spans = sorted(tuple(row)[1:] for row in files.agg(F.min("timestamp"), F.max("timestamp")).collect())
    assert len(spans) > 2 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
