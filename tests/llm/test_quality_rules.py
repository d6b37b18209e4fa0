"""Quality rules against the same rules written as loops in Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweir.llm.quality_rules import RULES, clean_documents, line_passes, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def by_hand(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(line in lines[:k] for k, line in enumerate(lines)), len(repeated), failed
    )


def text_of(rng):
    kind = rng.random()
    if kind < 0.1:
        return rng.choice([None, "", " \n\t", "a", "one two three four", "a b c d e", "a a a a a a a", "\n\n", "é " * 30])
    words = [rng.choice(["Ab", "c.", "#d", "<e>", "f|", "ñandú", "😀", "g!"]) if rng.random() < kind else f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 120))]
    text = "".join(word + rng.choice([" ", " ", " ", "\n", "\t", "\r\n", "\x0b"]) for word in words)
    return text + (text[: rng.randrange(len(text))] if rng.random() < 0.5 else "")


@pytest.mark.parametrize("seed", [1, 2])
def test_base_figures(table, seed):
    rng = random.Random(seed)
    rows = [(i, text_of(rng)) for i in range(400)] + [(None, "a b c"), (7, "repeated row"), (7, "repeated row")]
    found = quality_rules(table(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((repr(row.doc_id), *(row[name] for name in names)) for row in found) == sorted((repr(i), *by_hand(text)) for i, text in rows)
    assert not any(row.kept and row.base_failed for row in found)


def test_very_long_texts(table):
    plain = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, plain), (2, plain + " " + plain[:100]), (3, "ab " * 300_000), (4, "x" * 2_000_000), (5, "line of text.\n" * 50_000)]
    found = {row.doc_id: row for row in quality_rules(table(rows)).collect()}
    for i, text in rows[:2]:
        assert found[i].n_words == len(text.split()) and found[i].n_repeat_words == by_hand(text)[4]
    assert found[3].n_repeat_words == 300_000 and found[3].base_failed
    assert found[4].n_words == 1 and found[4].word_chars == 2_000_000
    assert found[5].n_dup_lines == 49_999 and found[5].n_lines_kept == 1


# Each line with whether it passes.
LINES = [
    ("A plain sentence that ends.", True), ("It asks (and then closes.)", True), ("Two sentences. And the rest of one", True), ("これは文です。", True),
    ("No sentence ends here", False), ("version 1.2 of it", False), ("WIN!! NOW!! TODAY!!", False), ("Wait!! What?? Fine.", True),
    ("### a $$$ b %%% c.", False), ("Costs $5 for a very ordinary day out.", True),
    ("Home | News | About | Contact.", False), ("One thing | or another, it says.", True), ("  Read more. ", False), ("Home is where one reads more.", True),
    ("© 2024 Some Company. Rest.", False), ("This uses cookies. Accept.", False), ("Subscribe to our newsletter.", False),
    ("The law of copyright " + "is long and has many words in it " * 5 + "that one reads.", True),
]


def test_lines(spark):
    rows = spark.createDataFrame(LINES, "line string, expected boolean")
    wrong = rows.where(line_passes(F.col("line")) != F.col("expected")).collect()
    assert not wrong


def test_verdict_and_clean_text(table):
    prose = "This is a sentence of a text that goes on for a while."
    more = "Then other words follow in a second one, and it ends too."
    rows = [
        (1, f"{prose}\nHome | About | Help | More\n{more}\nAll rights reserved."), (2, f"{prose}\n" + "\n".join(f"item {k} of a long list without end" for k in range(9))),
        (3, prose), (4, f"{prose}\n\n  \n{prose}"), (5, None), (6, "Too few words."),
    ]
    docs = table(rows).withColumn("kept", F.lit("mine")).withColumn("words", F.lit("theirs"))
    found = {row.doc_id: row for row in clean_documents(docs).collect()}
    assert [found[i].kept for i in range(1, 7)] == [True, False, True, False, False, False]
    assert found[1].clean_text == f"{prose}\n{more}" and (found[1].n_lines, found[1].n_lines_kept) == (4, 2)
    assert found[4].clean_text == prose and found[4].base_failed
    assert found[3].words == "theirs" and found[3].content == "y" and found[1].text == rows[0][1] and found[5].clean_text == ""
    assert not {row.doc_id for row in clean_documents(docs, rules=RULES._replace(most_lost=0)).where("kept").collect()} & {1, 2}


def test_edges(table):
    assert quality_rules(table([(1, "a")]).limit(0)).count() == 0
    assert [tuple(row)[:8] for row in quality_rules(table([(None, None)])).collect()] == [(None, 0, 0, 0, 0, 0, True, False)]
