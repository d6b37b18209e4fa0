"""Near-duplicates against all pairs in Python."""

import math
import random
import re

import corpus_pipeline
import numpy as np
import pytest

from logweir.llm import near_dedup, shingles
from logweir.llm.components import components
from logweir.llm.common import Scratch
from logweir.llm.near_dedup import CHUNKS, DISTANCE, SYMBOLS, WIDTH, drop_near_duplicates, index_keys, near_duplicates

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def expected(rows):
    """Component of each id by comparing all pairs."""
    ids = sorted({i for i, _ in rows})
    label = {i: i for i in ids}
    sets = [(i, shingle_set(text)) for i, text in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {x: low if y == high else y for x, y in label.items()}
    return label


def texts(seed, groups=6, copies=60):
    """Groups of edited copies around a text each, from hardly to strongly edited, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    shared = [word() for _ in range(30)]
    found = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(30, 120))] + shared
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            found.append(" ".join(own))
    found += [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 50)]
    return found


ODD = [None, "", " \n\t ", "one", "ONE", "a b c d", "a  b\nc d", "a b c d e", "É b c d e", "é b c d e", "x " * 30_000, "x " * 40_000]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(table, seed):
    rows = list(enumerate(texts(seed) + ODD))
    random.Random(seed).shuffle(rows)
    found = near_duplicates(table(rows)).collect()
    assert {row.doc_id: row.component_id for row in found} == expected(rows)
    assert {row.doc_id: row.n_shingles for row in found} == {i: len(shingle_set(text)) for i, text in rows}
    assert all(row.kept == (row.doc_id == row.component_id) for row in found)


def test_blocks_of_a_center(table, monkeypatch):
    """With small blocks and every key large, all links come from deltas."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    rows = list(enumerate(texts(3, groups=3)))
    assert {row.doc_id: row.component_id for row in near_duplicates(table(rows)).collect()} == expected(rows)


@pytest.mark.parametrize("small", [32, 1])
def test_the_pipeline_links_from_080_on(spark, table, monkeypatch, small):
    """Pairs at 0.79, 0.80 and 0.84, by links in small keys and by deltas; ``op1_near_dedup`` keeps all of them."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows, kept = [], set()
    for i, (common, each) in enumerate([(158, 21), (80, 10), (160, 20), (84, 8), (168, 16), (90, 5)] * 3):
        # The sets share the shingles of a common beginning; each goes on with words of its own.
        for side in range(2):
            words = [f"g{i}w{k}" for k in range(common + 4)] + [f"g{i}s{side}w{k}" for k in range(each)]
            rows.append((2 * i + side, " ".join(words)))
        one, other = (shingle_set(text) for _, text in rows[-2:])
        assert (len(one & other), len(one | other)) == (common, common + 2 * each)
        kept |= {2 * i} | ({2 * i + 1} if 100 * common < 80 * (common + 2 * each) else set())
    docs = table(rows)
    assert {row.doc_id for row in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept
    strict = {row.doc_id for row in near_duplicates(docs).where("kept").collect()}
    assert strict == {i for i, _ in rows} - {2 * i + 1 for i in range(5, 18, 6)}


@pytest.mark.parametrize("layout", [near_dedup.CONTRACT, near_dedup.CORPUS])
def test_what_a_layout_misses(layout):
    """At the threshold itself, at most 1 pair in 6,000 is beyond the distance."""
    n, p = layout.symbols, 1 - layout.percent / 100
    missed = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(layout.distance + 1, n + 1))
    assert missed < 1 / 6_000


def test_rows_without_id_and_repeated_ids(table):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(5, text), (7, text), (7, "another text altogether with some words"), (9, "another text altogether with some words"), (None, text), (8, None)]
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(table(rows)).collect()), key=repr)
    assert found == sorted([(5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (None, None, True), (8, 8, True)], key=repr)


def test_empty_and_columns(table):
    docs = table([(1, "a b"), (2, "a b"), (3, "c")])
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(row.doc_id for row in kept.collect()) == [1, 3]


def test_index_meets_all_pairs_within_the_distance():
    rng = np.random.default_rng(0)
    one = rng.integers(0, 1 << 16, (2_000, SYMBOLS), dtype=np.uint16)
    other = one.copy()
    for row in other:
        row[rng.choice(SYMBOLS, DISTANCE, replace=False)] ^= 1
    assert DISTANCE == 2 * CHUNKS - 1 and SYMBOLS == CHUNKS * WIDTH
    assert (index_keys(one) == index_keys(other)).any(axis=1).all()
    assert not (index_keys(one) == index_keys(np.roll(one, 1, axis=0))).any()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    apart = []
    for _ in range(300):
        whole = np.sort(rng.integers(0, 2**64, 230, dtype=np.uint64))
        both = np.concatenate((np.sort(whole[:215]), np.sort(whole[15:])))
        found = near_dedup.signatures(both, np.array([0, 215, 430]))
        apart.append((found[0] != found[1]).sum())
    assert abs(np.mean(apart) / SYMBOLS - 30 / 230) < 0.02 and max(apart) <= DISTANCE


def test_word_hashes_fold_ascii_only():
    data = np.frombuffer("Ab aB é É ab".encode(), np.uint8)
    starts, ends, words = shingles.word_spans(data, np.array([0, len(data)]))
    hashes = shingles.word_hashes(data, starts, ends)
    assert hashes[0] == hashes[1] == hashes[4] and hashes[2] != hashes[3] and words.tolist() == [0, 5]


@pytest.mark.parametrize("links", [[(k + 1, k) for k in range(200)], [(0, k) for k in range(1, 100)], [(k, (k * 7) % 50) for k in range(50)], []])
def test_graph_components(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    found = {row.id: row.component for row in components(frame, Scratch(spark)).collect()}
    label = {i: i for pair in links for i in pair if pair[0] != pair[1]}
    for _ in range(len(label)):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label
