"""Versions, several writers, finished names, and retention with an exact rollup."""

import random
import threading
from collections import Counter
from dataclasses import replace
from datetime import UTC, datetime

import pytest
from cases import GOLDEN_NOW, body, entry, golden, requests

from logweir import store as store_module
from logweir.ledger import OLD_VERSIONS, Deletion, Files, Ledger, Segment, Superseded, Version
from logweir.operators.rollup import minute_counts
from logweir.params import AggregateQuery
from logweir.store import LogStore


def test_a_version_is_written_and_read(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.newest() == Version()
    deletion = Deletion(1, 5, 6, 7, True)
    version = Version(3, 9, (Segment("a b", 1, 1, 4, ("k",), 17),), (deletion,), ("x",), (("b", 4, 2),), ("a b",))
    assert Version.read(version.written()) == version
    assert ledger.change(lambda old: replace(version, number=99)).number == 1
    assert ledger.newest() == replace(version, number=1)
    assert ledger.change(lambda old: None).number == 1


def test_a_file_is_created_once(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    assert files.create("f/one", "first") and not files.create("f/one", "second")
    assert files.read("f/one") == "first" and files.names("f") == ["one"]
    # As on a file system without links.
    files.is_local = False
    assert files.create("f/two", "é") and not files.create("f/two", "x") and files.read("f/two") == "é"


def test_writers_at_once(spark, tmp_path):
    """Every change of eight writers is kept, and no id is given twice."""
    ledgers = [Ledger(spark, str(tmp_path)) for _ in range(8)]
    got = []

    def write(k, ledger):
        for turn in range(6):
            first = ledger.reserve(f"{k}-{turn}", k + 1)
            got.append((first, first + k + 1))
            ledger.add(Segment(f"{k}-{turn}", 0, first, first + k + 1))

    threads = [threading.Thread(target=write, args=pair) for pair in enumerate(ledgers)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    version = ledgers[0].newest()
    assert sorted(version.names()) == sorted(f"{k}-{turn}" for k in range(8) for turn in range(6))
    assert version.reserved == () and version.next_id == 1 + sum(6 * (k + 1) for k in range(8)) and version.number == 96
    spans = sorted(got)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len({segment.seq for segment in version.live}) == 48


def test_reserved_ids_are_those_of_the_batch(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.reserve("a", 5) == 1 and ledger.reserve("b", 2) == 6
    assert ledger.reserve("a", 3) == 1 and ledger.reserve("a", 5) == 1
    assert ledger.reserve("a", 9) == 8 and ledger.newest().next_id == 17


def test_many_compactions_leave_a_small_ledger(spark, tmp_path):
    """The newest version keeps its size, old ones go, and all names stay finished."""
    ledger = Ledger(spark, str(tmp_path))
    sizes = []
    for k in range(120):
        old = ledger.newest().names()
        ledger.add(Segment(f"batch{k:04d}", 0, k, k + 1))
        ledger.add(Segment(f"merged{k:04d}", 0, 0, k + 1), (*old, f"batch{k:04d}"), ledger.newest())
        sizes.append(len(ledger.newest().written()))
    assert max(sizes[1:]) - min(sizes[1:]) < 20
    assert len(ledger.files.names("ledger")) == OLD_VERSIONS
    version = ledger.newest()
    assert version.names() == ["merged0119"]
    assert all(ledger.is_finished(version, f"{kind}{k:04d}") for kind in ("batch", "merged") for k in range(120))
    assert not ledger.is_finished(version, "batch0120")
    # Finished long ago: adding it again changes nothing.
    assert ledger.add(Segment("batch0003", 0, 1, 2)) == version


def test_what_was_prepared_from_an_older_version(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.add(Segment("a", 0, 1, 2))
    before = ledger.add(Segment("b", 0, 2, 3))
    ledger.add(Segment("c", 0, 3, 4))
    ledger.delete(Deletion(before.number, 10, 1, 10), before, ())
    with pytest.raises(Superseded):
        ledger.add(Segment("ab", 0, 1, 3), ("a", "b"), before)
    ledger.add(Segment("ab", 0, 1, 3), ("a", "b"), ledger.newest())
    with pytest.raises(Superseded):
        ledger.delete(Deletion(before.number, 20, 1, 20), before, ())
    # A later deletion that goes as far replaces the earlier one.
    newest = ledger.newest()
    assert ledger.delete(Deletion(newest.number, 20, 1, 20), newest, ()).deletions == (Deletion(newest.number, 20, 1, 20),)


@pytest.mark.parametrize(
    ("later", "earlier", "covers"),
    [
        (Deletion(2, 10, 5, 10), Deletion(1, 10, 5, 10), True), (Deletion(2, 10, 4, 10), Deletion(1, 10, 5, 10), False),
        (Deletion(2, 11, 0, 9), Deletion(1, 10, 5, 10), False), (Deletion(2, 11, 0, 9, True), Deletion(1, 10, 5, 10, True), True),
        (Deletion(2, 11, 0, 11, True), Deletion(1, 10, 5, 10), False), (Deletion(2, 11, 0, 9), Deletion(1, 10, 5, 10, True), True),
    ],
)
def test_covering_deletions(later, earlier, covers):
    assert later.covers(earlier) is covers


def counts(frame):
    return sorted((row.minute, row.service, row.level, row["count"]) for row in frame.collect())


def agree(store):
    assert counts(store.rollup()) == counts(minute_counts(store.logs()))
    query = AggregateQuery(since="2011-03-05T09:00:10Z", until="2011-03-09T00:00:30Z", bucket="1m", group_by="service")
    base = sorted(map(tuple, store.bucket_counts(query, "base").collect()))
    assert sorted(map(tuple, store.bucket_counts(query, "exact").collect())) == base


def test_exact_cycles(spark, tmp_path, monkeypatch):
    """Capped cycles, late logs, compactions between them: rollup and logs agree after each step."""
    monkeypatch.setattr(store_module, "MANY_RETIRED", 2)
    store, rng = LogStore(spark, str(tmp_path)), random.Random(4)
    sent = Counter()
    for turn in range(5):
        rows = [
            entry(timestamp=f"2011-03-0{rng.randint(5, 8)}T09:0{rng.randint(0, 3)}:{rng.randint(10, 59)}Z", service=rng.choice("xy"), message=f"{turn}-{k}")
            for k in range(30)
        ]
        sent.update(row["message"] for row in rows)
        store.ingest(requests(spark, body(*rows[:20]), body(*rows[20:])), f"b{turn}", GOLDEN_NOW)
        before = {(row.timestamp, row.id) for row in store.logs().collect()}
        plan = store.apply_retention(datetime(2011, 3, 7, 9, 1, 30, tzinfo=UTC), 0, 4, 3, exact=True)
        after = {(row.timestamp, row.id) for row in store.logs().collect()}
        assert len(before - after) == plan.deleted and not after - before
        assert sorted(before)[: plan.deleted] == sorted(before - after)
        agree(store)
        if turn == 2:
            store.compact("c")
            agree(store)
    assert len(store.ledger.newest().retired) <= 2
    assert len(list((tmp_path / "retired").iterdir())) == len(store.ledger.newest().retired)
    store.compact("all")
    agree(store)
    assert {row.message for row in store.logs().collect()} < set(sent)


def test_exact_cycles_need_exact_ones_before(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    store.ingest(requests(spark, body(*golden())), "b1", GOLDEN_NOW)
    now = datetime(2011, 3, 5, 9, 15, 30, tzinfo=UTC)
    store.apply_retention(now, 0, 1, 1)
    with pytest.raises(ValueError, match="exact"):
        store.apply_retention(now, 0, 1, 1, exact=True)


def test_two_stores_on_one_folder(spark, tmp_path, monkeypatch):
    """A batch that another writer overtakes keeps its reserved ids; a merge that it invalidates is made again."""
    one, other = LogStore(spark, str(tmp_path)), LogStore(spark, str(tmp_path))
    logs = golden()
    write = LogStore._write_rollup
    with monkeypatch.context() as patch:
        def overtaken(self, found, segment):
            write(self, found, segment)
            if segment == "b1":
                patch.setattr(LogStore, "_write_rollup", write)
                other.ingest(requests(spark, body(*logs[3:])), "b2", GOLDEN_NOW)

        patch.setattr(LogStore, "_write_rollup", overtaken)
        one.ingest(requests(spark, body(*logs[:3])), "b1", GOLDEN_NOW)
    assert sorted((row.id, row.message) for row in one.logs().collect()) == [(i + 1, log["message"]) for i, log in enumerate(logs)]
    with monkeypatch.context() as patch:
        def overtaken(self, found, segment):
            write(self, found, segment)
            patch.setattr(LogStore, "_write_rollup", write)
            other.apply_retention(datetime.fromisoformat(logs[5]["timestamp"]), 0, 1, 2, exact=True)

        patch.setattr(LogStore, "_write_rollup", overtaken)
        one.compact("c")
    assert one.logs().count() == len(logs) - 2 and one.ledger.newest().names() == ["c"]
    agree(one)
