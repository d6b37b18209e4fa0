"""The filter audit against counting documents one by one under every order."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from logweir.llm.filter_audit import LETTERS, audit_filters, interactions

LABELS = "doc_id long, quality int, toxic int"


def failing(text, i, rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, *_ in rows),
    }


def by_hand(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    judged = [(source or "", i, failing(text, i, rows)) for i, text, source in rows]
    found, shapley = {}, Counter()
    for part in {source for source, *_ in judged}:
        for order in permutations(LETTERS):
            left = [(i, fails) for source, i, fails in judged if source == part]
            every, gone = list(left), []
            for step, letter in enumerate(order, 1):
                here = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                found[part, "".join(order), step] = (
                    len(left), len(here), sum(fails[letter] for _, fails in gone),
                    sum(fails[letter] and sum(fails.values()) == 1 for _, fails in every),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here),
                )
                shapley[part, letter] += len(here)
                gone += here
    return {key: (*value, shapley[key[0], key[1][key[2] - 1]]) for key, value in found.items()}


def rows_of(seed, n=120):
    rng = random.Random(seed)
    found = []
    for i in range(n):
        words = [rng.choice(["a", "be", "Cat", "d$", "Éa"]) if rng.random() < 0.4 else f"w{k}" for k in range(rng.choice([3, 150, 210, 260]))]
        text = rng.choice([None, "", "x" * 30_000 + " " + "Y" * 700]) if i % 17 == 0 else rng.choice([" ", "\n", "\x0b"]).join(words[: rng.choice([5, 300])])
        found.append((i, text, rng.choice(["s", "t", None, ""])))
    found += [(i + n, found[rng.randrange(n)][1], rng.choice(["s", "t"])) for i in range(40)]
    return found + [(None, found[5][1], "s"), (None, found[5][1], "s"), found[7], found[7], (5, "another text", "t")]


def collected(df):
    return {(row.part, row.filter_order, row.step): tuple(row)[3:] for row in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_audit(table, spark, seed):
    rows = rows_of(seed)
    rng = random.Random(seed)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 3)] + [(None, 1, 1), (3, 1, 0), (3, 0, 1), (9_999, 1, 1)]
    found = audit_filters(table(rows), spark.createDataFrame(labels, LABELS))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found.count() == 3 * 600
    assert collected(found) == by_hand(rows, labels)


def test_copies_of_one_text(table, spark):
    """A group that holds all rows: one of them passes."""
    rows = [(i, "the same", "s") for i in range(500)]
    found = collected(audit_filters(table(rows), spark.createDataFrame([], LABELS)))
    # E removes 499 where it comes before A (60 orders), else nothing is left for it.
    assert found["s", "EABCD", 1] == (1, 499, 0, 0, 0, 0, 499 * 60)
    assert found["s", "EABCD", 2][:3] == (0, 1, 499)


def test_edges(table, spark):
    none = spark.createDataFrame([], LABELS)
    assert audit_filters(table([(1, "a", "s")]).limit(0), none).count() == 0
    assert collected(audit_filters(table([(1, None, None)]), none)) == by_hand([(1, None, None)], [])
    cells = spark.createDataFrame([("p", 0, 3, 1, 0), ("p", 3, 2, 2, 1)], "part string, mask int, n long, good long, toxic long")
    found = collected(interactions(cells, "XY"))
    assert found == {
        ("p", "XY", 1): (3, 2, 0, 0, 2, 1, 2), ("p", "XY", 2): (3, 0, 2, 0, 0, 0, 2),
        ("p", "YX", 1): (3, 2, 0, 0, 2, 1, 2), ("p", "YX", 2): (3, 0, 2, 0, 0, 0, 2),
    }
    for letters in ("", "AA", "ABCDEFGH", "A'"):
        with pytest.raises(ValueError):
            interactions(cells, letters)
