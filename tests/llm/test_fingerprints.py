"""Merkle fingerprints against a tree built in Python."""

import hashlib
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from logweir.llm import fingerprints
from logweir.llm.fingerprints import changed_paragraphs, fingerprint, fingerprint_documents, likeness


def md5(text, digits):
    return hashlib.md5(text.encode()).hexdigest()[:digits]


ENDS = ".!?\n…。！？．؟।"
PLACES = regex.compile(f"[{fingerprints._PLACES}]".replace("\\p{P}", "\\p{P}"))


def pieces_of(paragraph):
    """Cut at ends of sentences, longer stretches at the first good place from the 25th character on."""
    found, at = [], 0
    while at < len(paragraph):
        end = next((k for k in range(at, min(at + 81, len(paragraph))) if paragraph[k] in ENDS), None)
        if end is not None:
            while end < len(paragraph) and paragraph[end] in ENDS:
                end += 1
        else:
            end = next((k + 1 for k in range(at + 24, min(at + 80, len(paragraph))) if PLACES.match(paragraph[k])), min(at + 80, len(paragraph)))
        found.append(paragraph[at:end])
        at = end
    return found


def branches(text):
    """Sections, each a list of paragraphs, each a tuple of the digests of its pieces."""
    sections = re.findall(r"(?s).+?(?:\n[ \t\r]*\n\s*|\Z)", text)
    assert "".join(sections) == text
    found = []
    for section in sections:
        paragraphs = re.findall(r"[^\n]*\n+|[^\n]+", section)
        found.append([tuple(md5(piece, 16) for piece in pieces_of(paragraph)) for paragraph in paragraphs])
    return found


def tree(text):
    """The fingerprint from the digests of the pieces upwards."""
    n = len({piece for section in branches(text) for paragraph in section for piece in paragraph})
    tops, bodies = [], []
    for section in branches(text):
        digests = [md5(",".join(paragraph), 16) for paragraph in section]
        tops.append(md5(",".join(digests), 16))
        bodies.append(f"{tops[-1]}=" + ";".join(f"{d}={','.join(p)}" for d, p in zip(digests, section, strict=True)))
    return f"{hashlib.sha256('|'.join(tops).encode()).hexdigest()}:{n}/{'|'.join(bodies)}"


def near(one, other):
    """By descent over the branches themselves."""
    if one[:64] == other[:64]:
        return 1.0
    a, b = ([[tuple(p.partition("=")[2].split(",")) for p in s.partition("=")[2].split(";")] for s in x.partition("/")[2].split("|") if s] for x in (one, other))
    both = sum(int(x[65:].partition("/")[0]) for x in (one, other))
    differing = 0
    for own, others in ((a, b), (b, a)):
        paragraphs = {p for s in own if s not in others for p in s}
        known = {p for s in others if s not in own for p in s}
        differing += len({x for p in paragraphs - known for x in p} - {x for p in known - paragraphs for x in p})
    return min(0.999999, 1 - differing / both) if both else 0.0


def texts(n=120):
    rng = random.Random(8)
    pool = ["a b", "Ça va.", "\n", "\n\n", "日本 語!", " ", "?", "🙂 x", "word " * 30, "\t\n \n", "end. "]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(n)] + [None, "", "\n", "x" * 100_000, "same", "same"]


def test_documents(table):
    own = texts()
    ids = random.Random(1).sample(range(-500, 10_000), len(own))
    rows = list(zip(ids, own, strict=True))
    found = {row.doc_id: row for row in fingerprint_documents(table(rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == tree(text) and row.edited_fingerprint == tree(edited)
        assert row.near_edited == pytest.approx(near(tree(text), tree(edited)))
        assert row.near_next == pytest.approx(near(tree(text), tree(following)))
    assert len(found) == len(rows)


@pytest.mark.parametrize("ranges", ["1", "2", "5"])
def test_next_over_any_ranges(table, spark, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rows = [(i * i, f"text {i}. ") for i in range(40)]
        found = {row.doc_id: row.edited_sha256 for row in fingerprint_documents(table(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, (i, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[k - 1][1][:half]
        assert found[i] == hashlib.sha256(edited.encode()).hexdigest()


def test_edges(table):
    docs = table([(3, "one."), (3, "two."), (None, "none."), (1, None)])
    assert fingerprint_documents(docs).count() == 4 and fingerprint_documents(docs.limit(0)).count() == 0
    alone = fingerprint_documents(table([(1, "abcd")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0


def test_changes_are_located(spark):
    one = "First.\nSecond.\n\nThird one. And more.\nFourth.\n"
    pairs = [(one, one), (one, one.replace("more", "less")), (one, one + "\n\nFifth."), (one, ""), (None, "new")]
    prints = spark.createDataFrame(pairs, "one string, other string").select(fingerprint(F.col("one")).alias("a"), fingerprint(F.col("other")).alias("b"))
    found = [(list(row[0]), row[1]) for row in prints.select(changed_paragraphs(F.col("a"), F.col("b")), likeness(F.col("a"), F.col("b"))).collect()]
    assert found[0] == ([], 1.0) and found[1][0] == ["1.0"] and 0.5 < found[1][1] < 1
    assert found[2][0] == ["1.1", "2.0"] and found[3] == ([], 0.0) and found[4] == (["0.0"], 0.0)


@pytest.mark.parametrize("kind", ["日本語文字列", "abcdefghijklmnop", "한국어문장", "слово", "x9y8 "])
def test_an_inserted_character_changes_little(spark, kind):
    """Also in a long stretch without any sign."""
    rng = random.Random(kind)
    text = "".join(rng.choice("あいうえおかきくけこのはにを" + "漢字仮名交文章" if kind[0] == "日" else kind) for _ in range(4_000))
    middle = text[:2_000] + "Q" + text[2_000:]
    frame = spark.createDataFrame([(text, "Q" + text), (text, middle), (text, text[:-1])], "one string, other string")
    found = [row[0] for row in frame.select(likeness(fingerprint(F.col("one")), fingerprint(F.col("other")))).collect()]
    assert all(0.9 < x < 1 for x in found)


def test_rows_of_one_id_are_dealt_out(table, spark):
    """A third of the rows have one id, a third have none; each still meets the row that follows it."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}. " * (1 + i % 4)) for i in range(240)]
    found = fingerprints.with_next(table(rows).select("doc_id", "text"), ["text"])
    placed = [(row.text, row.next_text) for row in found.collect()]
    order = found.select("doc_id", "text", F.xxhash64("text").alias("tie")).orderBy(F.desc_nulls_last("doc_id"), "tie").collect()
    assert sorted(placed) == sorted((row.text, order[(k + 1) % len(order)].text) for k, row in enumerate(order))
    sizes = fingerprints._placed(table(rows).select("doc_id", "text"), 12).groupBy("range").count()
    assert sizes.count() >= 10 and sizes.agg(F.max("count")).first()[0] < 50


def test_no_python_in_the_plan(table):
    plan = fingerprint_documents(table([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
