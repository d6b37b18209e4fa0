"""Exact deduplication against grouping in Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logweir.llm import exact_dedup
from logweir.llm.exact_dedup import drop_copies, find_copies, sha256

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = (
    [(i, "Copy OF Éa") for i in range(40)] + [(100, "copy of Éa"), (101, "copy of éa"), (102, None), (103, ""), (104, "x" * 200_000), (105, "X" * 200_000)]
    + [(106, " "), (107, "İ"), (108, "i̇"), (109, "single"), (110, "single"), (110, "single"), (None, "single"), (None, "no id"), (None, "no id")]
)


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(AZ)].append(i)
    found = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        found += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(found, key=repr)


def shown(found):
    return sorted(map(tuple, found.collect()), key=repr)


def test_groups(table):
    assert shown(find_copies(table(ROWS))) == expected(ROWS)


@pytest.mark.parametrize("weak", [lambda text: F.lit(b"same"), lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))])
def test_texts_decide_not_digests(table, weak):
    assert shown(find_copies(table(ROWS), digest=weak)) == expected(ROWS)


@pytest.mark.parametrize("digest", [sha256, lambda text: F.lit(b"same")])
def test_frequent_digests_are_salted(table, monkeypatch, digest):
    monkeypatch.setattr(exact_dedup, "FEW", 3)
    assert shown(find_copies(table(ROWS), digest=digest)) == expected(ROWS)


def test_empty(table, spark):
    assert find_copies(table(ROWS).limit(0)).count() == 0


def test_rows_that_stay(table):
    docs = table(ROWS)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    rows = [(row.doc_id, (row.text or "").translate(AZ)) for row in kept.collect()]
    assert sorted(rows, key=repr) == sorted({(i, t) for i, t in ((k, (x or "").translate(AZ)) for k, x in ROWS) if i == max((a for a, b in ROWS if (b or "").translate(AZ) == t and a is not None), default=None)}, key=repr)


def test_no_python_in_the_plan(table):
    plan = find_copies(table(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
