"""Hard negatives against all products in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import hard_negatives
from logweir.llm.hard_negatives import Bias, best, mine_hard_negatives, products

SCHEMA = "vec_id long, embedding array<double>, label int, id string, anchors int, block string"


def usable(row):
    return None not in row and all(x is not None and math.isfinite(x) for x in row[1])


def by_hand(rows, n_positive=5, n_negative=5, every=100):
    one = {}
    for i, vector, label in rows:
        if usable((i, vector, label)):
            entry = (label, [math.floor(256 * x) for x in vector])
            one[i] = min(one.get(i, entry), entry)
    found = set()
    for a, (label, vector) in one.items():
        if a % every:
            continue
        scores = {i: sum(x * y for x, y in zip(vector, other, strict=True)) for i, (_, other) in one.items() if i != a and len(other) == len(vector)}
        positives = sorted((-s, i) for i, s in scores.items() if one[i][0] == label)[:n_positive]
        for minus, p in positives:
            band = sorted((-s, i) for i, s in scores.items() if one[i][0] != label and 80 * -minus <= 100 * s <= 100 * -minus)[:n_negative]
            found |= {(a, p, rank, i, -minus, -s) for rank, (s, i) in enumerate(band, 1)}
    return found


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", 3, "y") for row in rows], SCHEMA).repartition(4)


def mined(spark, rows, **more):
    found = mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(row) for row in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def rows_of(seed, n=900, dims=8, labels=3, size=1.0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, size) for _ in range(dims)] for _ in range(labels + 1)]
    found = []
    for i in range(n):
        center = rng.choice(centers)
        found.append((i, [c + rng.gauss(0, size / 3) for c in center], rng.randrange(labels)))
    return found


@pytest.mark.parametrize("size", [1.0, 300.0])
def test_against_all_products(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "PACKED", 2)
    rows = rows_of(int(size), size=size)
    # One very common vector, under several labels; ties go by id.
    rows += [(1_000 + i, rows[0][1], i % 3) for i in range(150)]
    expected = by_hand(rows)
    assert expected and mined(spark, rows) == expected


def test_rows_that_take_no_part(spark):
    rows = rows_of(5, 300)
    bad = [None, [None] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [float("-inf")] * 8]
    rows += [(400 + i, vector, 1) for i, vector in enumerate(bad)] + [(None, [1.0] * 8, 1), (500, [9.0] * 8, None)]
    # Other lengths, empty vectors, repeated ids with equal and with different rows.
    rows += [(600 + i, [1.0, float(i)], i % 2) for i in range(8)] + [(700 + i, [], i % 2) for i in range(6)]
    rows += [rows[0], rows[3], (3, [5.0] * 8, 0), (100, [0.5] * 8, 2)]
    found = mined(spark, rows)
    assert found == by_hand(rows)
    assert {a for a, *_ in found} >= {600, 700}


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine_hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == set()
    assert mined(spark, [(0, [1.0], 0)]) == set()
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.9, 0.0], 1), (3, [0.79, 0.0], 1), (4, [-1.0, 0.0], 0), (5, [1.0, 0.0], 1)]
    assert mined(spark, rows) == by_hand(rows)
    zero = [(0, [0.0], 0), (1, [1.0], 0), (2, [5.0], 1), (3, [0.0], 1)]
    assert mined(spark, zero) == by_hand(zero) == {(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)}


def test_too_large(spark):
    with pytest.raises(ValueError, match="too large"):
        mine_hard_negatives(frame(spark, [(0, [1e30], 0), (1, [1.0], 0)]), F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize("most", [1, 300, 40_000])
def test_products(most):
    """Fields never run into each other, also at the largest sums."""
    rng = np.random.default_rng(most)
    vectors = rng.integers(-most, most + 1, (50, 6))
    vectors[0], vectors[1] = most, -most
    bias = Bias(most)
    width = bias.width(6)
    biased = (vectors + most).T.astype(np.uint32 if width == 4 else np.uint64)
    wide = [int.from_bytes(row.tobytes(), "little") for row in biased]
    for anchor in vectors[:5]:
        found = products([int(x) + most for x in anchor], wide, 50, width).astype(np.int64)
        known = most * vectors.sum(axis=1) + most * anchor.sum() + 6 * most**2
        assert (found - known).tolist() == (vectors @ anchor).tolist()


def test_best():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 30, 400):
        scores, ids = rng.integers(0, 6, n), rng.permutation(n)
        expected = sorted(range(n), key=lambda k: (-scores[k], ids[k]))[:5]
        assert best(scores, ids, 5).tolist() == expected
