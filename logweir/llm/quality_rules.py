"""Quality rules that look at lines first, then at what is left of the document.

Every line with a word is judged by itself:

* punctuation: it must hold the end of a sentence, not more than one sign in ten
  characters, and not shout with runs of marks;
* navigation: no row of items between separators, and no lone menu entry;
* boilerplate: no short line of legal, cookie or script notices, and no
  line that the document has had before.

Lines that fail are taken out. A document that loses more than half of its
characters by this is rejected, as is one that fails the base rules on words.

All of it is in built-in functions over arrays of one document; nothing is
shuffled. Windows of words are compared by 64-bit hashes, two different ones
of a text being taken for equal with a probability of ``n * n / 2 ** 65``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import free_name, quoted, words_of

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"

# Patterns that Java and RE2 read alike.
SENTENCE_END = r"[.!?…؟।][\"')\]»”’]*(?:[\x20\x09-\x0D]|\z)|[。！？]"
SHOUTING = r"(?:[!?]{2,}[^!?]*){3}"
SEPARATED = r"[|•·»›→](?:[^|•·»›→]{0,40}[|•·»›→]){2}"
MENU_ENTRY = (
    r"(?i)\A[\x20\x09-\x0D]*(?:home|menu|search|log ?in|log ?out|sign (?:in|up|out)|register|my account|next|previous|back(?: to top)?"
    r"|skip to (?:main )?content|read more|share|print|contact(?: us)?|about(?: us)?|site ?map|rss|faq)[\x20\x09-\x0D.:!>]*\z"
)
NOTICE = (
    r"(?i)all rights reserved|©|\(c\) ?[12][0-9]{3}|copyright|licen[sc]ed? under|released under|terms of (?:use|service)"
    r"|privacy policy|cookie|javascript|lorem ipsum|powered by|click here|subscribe|unsubscribe|newsletter"
)


class Rules(NamedTuple):
    """What lines and documents must hold to."""

    sentence_end: str = SENTENCE_END
    shouting: str = SHOUTING
    #: Characters for each sign, at least.
    per_symbol: int = 10
    separated: str = SEPARATED
    menu_entry: str = MENU_ENTRY
    notice: str = NOTICE
    #: Lines of more characters are prose that mentions a notice.
    notice_chars: int = 160
    #: Percent of characters that a document may lose.
    most_lost: int = 50
    min_words: int = 10
    #: Percent of words that may lie in repeated windows.
    most_repeated: int = 20


RULES = Rules()


def line_passes(line: Column, rules: Rules = RULES) -> Column:
    """Whether a line meets the rules on punctuation, navigation and boilerplate."""
    punctuation = line.rlike(rules.sentence_end) & ~line.rlike(rules.shouting)
    punctuation &= rules.per_symbol * F.regexp_count(line, F.lit(SYMBOLS)) <= F.length(line)
    navigation = ~line.rlike(rules.separated) & ~line.rlike(rules.menu_entry)
    return punctuation & navigation & ~((F.length(line) <= rules.notice_chars) & line.rlike(rules.notice))


def _repeated_words(words: str, hashes: str, ordered: str, places: str) -> list[tuple[str, Column]]:
    """Columns to add one after the other; the last, ``n_repeat_words``, counts words in windows that the text has twice.

    Only texts that have such a window sort their hashes with their places.
    """
    n = F.size(words)
    window = F.transform(
        F.slice(words, 1, F.greatest(n - WINDOW + 1, F.lit(0))),
        lambda word, i: F.xxhash64(word, *[F.get(words, i + k) for k in range(1, WINDOW)]),
    )
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found_twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
    twice = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(ordered, k + 1)["h"].eqNullSafe(x["h"])))
    covered = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    return [
        (hashes, window),
        (ordered, F.when(found_twice, placed)),
        (places, F.sort_array(F.transform(twice, lambda x: x["i"]))),
        ("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))),
    ]


def clean_documents(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """``docs`` with ``clean_text`` and what the rules found; all columns stay, of equal names the new ones replace.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (base),
    ``n_lines, n_lines_kept`` (lines with a word), ``chars, chars_kept`` (of those
    lines), ``base_failed``, ``kept``, and ``clean_text``: the lines that pass,
    joined by line feeds. Null text counts as empty, has no words and fails the
    base rules. Order, ids and repeated rows do not matter; no rows give none.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_kept", "chars", "chars_kept", "base_failed", "kept", "clean_text")
    taken = [*docs.columns, *added]
    content, words, lines, good, hashes, ordered, places = names = [free_name(name, taken) for name in ("content", "words", "lines", "good", "hashes", "ordered", "places")]
    own = [name for name in docs.columns if name not in added or name == text]
    rows = docs.select(*map(quoted, own), F.coalesce(F.col(quoted(text)), F.lit("")).alias(content))
    rows = rows.withColumn(words, words_of(F.col(content))).withColumn(lines, F.filter(F.split(content, "\n"), lambda line: line.rlike(HAS_WORD)))
    rows = rows.withColumn(good, F.filter(F.array_distinct(lines), lambda line: line_passes(line, rules)))
    for name, column in _repeated_words(words, hashes, ordered, places):
        rows = rows.withColumn(name, column)
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(content, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_lines_kept": F.size(good).cast("long"),
        "chars": F.length(F.array_join(lines, "")).cast("long"),
        "chars_kept": F.length(F.array_join(good, "")).cast("long"),
        "clean_text": F.array_join(good, "\n"),
    }).drop(*names)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    lost = F.col("chars") - F.col("chars_kept")
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * lost <= rules.most_lost * F.col("chars")))
    return rows.select(*[quoted(name) for name in own if name not in added], *added)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = RULES) -> DataFrame:
    """``doc_id`` and the figures and verdicts of :func:`clean_documents` for every row; other columns are ignored."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return clean_documents(narrow, rules=rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_kept", "chars", "chars_kept"
    )
