"""Mixing against apportionment seat by seat in Python."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from logweir.llm import mixing
from logweir.llm.mixing import REPEATS, SHARE, WEIGHTS, apportion, mix, mixed_documents, source_targets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes):
    """Targets by sharing the excess again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    capped = {}
    while True:
        rest = [s for s in names if s not in capped]
        left = SHARE * sum(sizes.values()) - sum(capped.values())
        found = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if found[s] > REPEATS * sizes[s]]
        if not over:
            return capped | found
        capped |= {s: float(REPEATS * sizes[s]) for s in over}


def rows_of(seed, n=600):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", "tiny"]
    found = []
    for i in range(n):
        source = rng.choice(sources[:5] if i else sources[5:]) if rng.random() < 0.6 else "b"
        found.append((i, rng.choice([None, "", " \n "]) if i % 50 == 0 and i else " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 80))), source))
    return found + [(n, "x " * 30_000, "long"), (n, "x " * 30_000, "long"), (None, "a b c", "a"), (None, "a b c", "a")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(table, seed):
    rows = rows_of(seed)
    docs = table(rows)
    found = mix(docs).collect()
    assert len(found) == len(rows)
    size, taken, target = {}, {}, {}
    named = docs.select("doc_id", "source").collect()
    source = {row.doc_id: row.source for row in named}
    for row in found:
        s = source[row.doc_id]
        size[s] = size.get(s, 0) + row.size
        taken[s] = taken.get(s, 0) + row.taken
        target[s] = row.target
        assert 0 <= row.taken <= REPEATS * row.size
    assert all(row.source_size == size[source[row.doc_id]] for row in found)
    exact = targets(size)
    shards = len(rows) ** 0.5
    for s in size:
        assert target[s] == pytest.approx(exact[s])
        assert abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS * (shards + 1)
    assert sum(taken.values()) == pytest.approx(SHARE * sum(size.values()), rel=0.01)
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_apportion_is_sainte_lague(spark, seed):
    rng = random.Random(seed)
    shares = [rng.choice([0, 1, 5, 50, 1_000]) * rng.random() for _ in range(rng.randint(1, 40))]
    seats = rng.randint(0, 3 * len(shares))
    seats = 0 if not sum(shares) else seats
    parties = spark.createDataFrame([(k, s, seats, 10**6) for k, s in enumerate(shares)], "party long, share double, seats long, cap long")
    found = {row.party: row.quota for row in apportion(parties, [], "share", "seats", "cap", [F.col("party")]).collect()}
    quota = dict.fromkeys(range(len(shares)), 0)
    for _ in range(seats):
        best = max((k for k in quota if shares[k]), key=lambda k: (shares[k] / (2 * quota[k] + 1), -k))
        quota[best] += 1
    assert found == quota


def test_edges(table, spark):
    docs = table([(1, None, "a"), (2, "", "a"), (3, "one two", None)])
    assert mix(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0
    assert {row.doc_id: row.size for row in mix(docs).collect()} == {1: 0, 2: 0, 3: 2}
    nothing = mix(docs.where("doc_id < 3")).collect()
    assert [(row.taken, row.target) for row in nothing] == [(0, 0.0)] * 2
    sizes = spark.createDataFrame([("a", 10), ("b", 10), (None, 80)], "source string, source_size long")
    found = {row.source: row.target for row in source_targets(sizes).collect()}
    assert found == {"a": 20.0, "b": 20.0, None: 110.0}


def test_mixed_documents(table):
    docs = table(rows_of(4, 200))
    counts = sorted((row.doc_id, row.taken) for row in mix(docs).collect() if row.taken and row.doc_id is not None)
    kept = mixed_documents(docs)
    assert kept.columns == docs.columns
    taken, text = {}, {row.doc_id: row.text for row in docs.collect()}
    for row in kept.collect():
        assert text[row.doc_id].startswith(row.text) and row.n_chars == len(row.text) and words(row.text)
        taken[row.doc_id] = taken.get(row.doc_id, 0) + len(words(row.text))
    by_id = {}
    for i, n in counts:
        by_id[i] = by_id.get(i, 0) + n
    assert {i: n for i, n in taken.items() if i is not None} == by_id


@pytest.mark.parametrize("seed", [4, 5])
def test_the_pipeline_mixes_whole_documents(spark, table, seed):
    docs = table(rows_of(seed, 200))
    rows = docs.collect()
    texts = {(row.doc_id, row.text) for row in rows}
    size, taken, largest = {}, {}, {}
    for row in rows:
        size[row.source] = size.get(row.source, 0) + len(words(row.text))
        largest[row.source] = max(largest.get(row.source, 0), len(words(row.text)))
    found = corpus_pipeline.mixing(spark, docs, "")
    assert found.columns == docs.columns
    for row in found.collect():
        assert (row.doc_id, row.text) in texts and row.n_chars == len(row.text)
        taken[row.source] = taken.get(row.source, 0) + len(words(row.text))
    for source, target in targets(size).items():
        assert abs(taken.get(source, 0) - target) <= largest[source] / 2 + mixing.BLOCK_WORDS * len(size)


def test_whole_documents_without_python(table):
    plan = mixed_documents(table(rows_of(5, 50)), whole=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_python_in_the_plan(table):
    for found in (mix(table(rows_of(5, 50))), mixed_documents(table(rows_of(5, 50)))):
        plan = found._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
