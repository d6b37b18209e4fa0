"""Toxicity by a weighted lexicon, matched in one pass by an Aho-Corasick automaton.

Text is folded first: look-alike letters of other scripts, accents, full-width
forms and digits or signs that stand for letters inside a word all become one
plain letter; invisible characters go. The lexicon holds folded words and word
beginnings with their log odds, learned from labelled documents, and phrases
that take a match back because they are usual in harmless text. The sum of
the weights is normalised by the length of the text, and two learned numbers
turn it into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from logweir.llm import arrow_text
from logweir.llm.common import Scratch, free_name, map_arrow, quoted

#: Labelled documents to learn from, a documented bound of the model; those with the smallest hash of their id.
SAMPLE = 20_000
#: Tasks that read the sample.
TASKS = 24
#: Letters of a word beginning.
STEMS = (4, 5, 6, 7)
#: A term must be in so many toxic documents, and in this share of them.
MIN_TOXIC, MIN_SHARE = 4, 0.01
#: A term must be so many times as frequent in toxic documents as in others.
MIN_ODDS = 12.0
#: Words of a text up to which its length does not matter.
FREE_WORDS = 50.0
#: Terms in the lexicon.
MOST_TERMS = 5_000

# Letters of other scripts that look like Latin ones, and signs in place of letters.
LOOK_ALIKE = dict(zip("авеокмнрстухіјѕԁԛԝһӏαβεικνορτυχγωɑɡıℓ", "abeokmhpctyxijsdqwhlabeiknoptuxywagil", strict=True))
IN_WORD = dict(zip("013456789@$!|+€", "oieasgtbgasiite", strict=True))
#: i, l and 1 cannot be told apart once signs stand for letters.
SAME = str.maketrans({"l": "i", "j": "i"})
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_SIGN = re.compile(r"(?<=[^\W\d_])[0-9@$!|+€]+(?=[^\W\d_])|(?<![\w@$!|+€])[0-9@$!|+€]{1,2}(?=[^\W\d_])|(?<=[^\W\d_])[0-9]+(?!\w)")
_MARKS = re.compile("[̀-ͯ]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """``text`` in plain small letters; signs and digits become letters next to letters only."""
    text = _HIDDEN.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.casefold()
    if not text.isascii():
        text = text.translate(_TABLE)
    return _SIGN.sub(lambda found: "".join(IN_WORD.get(c, c) for c in found[0]), text).translate(SAME)


_TABLE = str.maketrans(LOOK_ALIKE)


def terms_of(folded: str) -> dict[str, set[str]]:
    """The lexicon terms that could stand for a text, ``^word$`` and ``^beginning``, with the words before them."""
    found: dict[str, set[str]] = {}
    before = ""
    for word in _LETTERS.findall(folded):
        if len(word) > 2:
            found.setdefault(f"^{word}$", set()).add(before)
            for n in STEMS:
                if len(word) > n:
                    found.setdefault(f"^{word[:n]}", set()).add(before)
        before = word
    return found


@dataclass
class Lexicon:
    """Weights by term, exception phrases, and the two numbers of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    offset: float = -2.0

    def __post_init__(self):
        import ahocorasick

        # Between terms that begin at one place the whole word counts, else the longest beginning.
        self.automaton = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            plain = term.strip("^$")
            old = self.automaton.get(plain, (len(plain), 0.0, 0.0, 0))
            whole, stem = (weight, old[2]) if term.endswith("$") else (old[1], weight)
            self.automaton.add_word(plain, (len(plain), whole, stem, old[3]))
        for phrase in map(fold, self.exceptions):
            old = self.automaton.get(phrase, (len(phrase), 0.0, 0.0, 0))
            self.automaton.add_word(phrase, (*old[:3], 1))
        self.automaton.make_automaton()

    def matched(self, folded: str) -> list[tuple[int, int, float]]:
        """Begin, end and weight of the matches; at each begin the longest, none inside an exception phrase."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        harmless: list[tuple[int, int]] = []
        for last, (n, whole, stem, exception) in self.automaton.iter(folded):
            begin, end = last - n + 1, last + 1
            if begin and folded[begin - 1].isalpha():
                continue
            ends = end == len(folded) or not folded[end].isalpha()
            if exception and ends:
                harmless.append((begin, end))
            weight = whole if ends and whole else stem
            if weight and (begin not in best or end > best[begin][0]):
                best[begin] = (end, weight)
        # One sweep: how far the phrases that began so far reach.
        harmless.sort()
        kept, reach, k = [], 0, 0
        for begin, (end, weight) in sorted(best.items()):
            while k < len(harmless) and harmless[k][0] <= begin:
                reach = max(reach, harmless[k][1])
                k += 1
            if end > reach:
                kept.append((begin, end, weight))
        return kept

    def density(self, text: str) -> float:
        """Sum of weights, damped by the logarithm of the length beyond ``FREE_WORDS`` words."""
        total = sum(weight for _, _, weight in self.matched(fold(text)))
        return total / (1.0 + math.log(max(1.0, text.count(" ") / FREE_WORDS)) / 4.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``term, n_toxic, n_clean, contexts`` of the labelled texts of each slice."""
    for batch in batches:
        for part in arrow_text.slices(batch):
            counts: dict[str, list] = {}
            for text, label in zip(arrow_text.texts(part.column("text")), part.column("label").to_pylist(), strict=True):
                for term, words in terms_of(fold(text)).items():
                    own = counts.setdefault(term, [0, 0, set()])
                    own[0 if label else 1] += 1
                    if label:
                        own[2].update(crc32(word.encode()) & 0xFFFF for word in words)
            rows = zip(counts, *zip(*counts.values(), strict=True), strict=True) if counts else ()
            names = ("term", "n_toxic", "n_clean", "contexts")
            columns = list(zip(*rows, strict=True)) or [()] * 4
            columns[3] = [sorted(own) for own in columns[3]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], list(names))


def learn(sample: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled texts (``text, label``).

    A term's support is the number of different words found before it in toxic
    texts, at most that of the texts: copies of one text don't add to it. A
    beginning is dropped if a longer term has nearly its support, and the longer
    ones if it stays. A pair of words with a match in it that is found in three
    harmless documents at least and in no toxic one becomes an exception phrase.
    """
    totals = sample.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    n_toxic, n_clean = totals.toxic or 0, totals.clean or 0
    terms = map_arrow(sample.select("text", "label"), _counted, "term string, n_toxic long, n_clean long, contexts array<int>")
    contexts = F.size(F.array_distinct(F.flatten(F.collect_list("contexts"))))
    terms = terms.groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"), contexts.alias("contexts"))
    odds = ((F.col("n_toxic") + 0.5) / (n_toxic + 1)) / ((F.col("n_clean") + 0.5) / (n_clean + 1))
    support = F.least("n_toxic", "contexts")
    good = terms.where((support >= max(MIN_TOXIC, MIN_SHARE * n_toxic)) & (odds >= MIN_ODDS))
    found = good.select("term", support.alias("support"), F.log(odds).alias("weight")).orderBy(F.desc("support"), "term").limit(MOST_TERMS).collect()
    weights = _chosen({row.term: (row.support, row.weight) for row in found})
    harmless = _harmless_phrases(Lexicon(weights, list(exceptions)), sample) if weights else []
    lexicon = Lexicon(weights, [*exceptions, *harmless])
    known = score_toxicity(sample.select("text", "label"), lexicon).select("density", "label").collect()
    lexicon.slope, lexicon.offset = _logistic(np.array([row.density for row in known]), np.array([float(row.label) for row in known]))
    return lexicon


def _chosen(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """The weights of terms, without those that another one makes needless."""
    best_longer: Counter[str] = Counter()
    for term, (support, _) in found.items():
        plain = term.strip("^$")
        for n in STEMS:
            if n < len(plain):
                best_longer[f"^{plain[:n]}"] = max(best_longer[f"^{plain[:n]}"], support)
    stay = {term for term, (support, _) in found.items() if term.endswith("$") or support > 1.1 * best_longer[term]}
    shorter = lambda term: (f"^{term.strip('^$')[:n]}" for n in STEMS if n < len(term.strip("^$")))
    return {term: found[term][1] for term in sorted(stay) if not any(stem in stay for stem in shorter(term))}


def _harmless_phrases(lexicon: Lexicon, sample: DataFrame) -> list[str]:
    told = (lexicon.weights, lexicon.exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*told)
        for batch in batches:
            found = [(p, label) for t, label in zip(arrow_text.texts(batch.column("text")), batch.column("label").to_pylist(), strict=True) for p in _phrases(own, fold(t))]
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([p for p, _ in found], pa.string()), "label": pa.array([n for _, n in found], pa.int32())})

    phrases = map_arrow(sample.select("text", "label"), run, "phrase string, label int").groupBy("phrase")
    usual = phrases.agg(F.count("*").alias("n"), F.max("label").alias("label")).where("n >= 3 and label = 0")
    return [row.phrase for row in usual.orderBy(F.desc("n"), "phrase").limit(MOST_TERMS).collect()]


def _phrases(lexicon: Lexicon, folded: str) -> set[str]:
    """The pairs of words that a match of ``lexicon`` is in."""
    words = [(found.start(), found.end()) for found in _LETTERS.finditer(folded)]
    at = {begin: k for k, (begin, _) in enumerate(words)}
    places = [at[begin] for begin, _, _ in lexicon.matched(folded) if begin in at]
    pairs = ((a, a + 1) for k in places for a in (k - 1, k) if a >= 0 and a + 1 < len(words))
    return {folded[words[a][0] : words[b][1]] for a, b in pairs}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with a weak pull to zero and a positive slope."""
    if not len(y) or y.min() == y.max():
        return 1.0, -2.0
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (y - p) - 0.01 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def held_out() -> F.Column:
    """Documents never learned from: CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """``doc_id, text, label`` of at most ``most`` labelled documents that may be learned from, by the smallest MD5 of their id."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")
    # An id has one text here, the smallest; the sample is dealt out, so that many tasks learn from it.
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).repartition(TASKS, "doc_id")


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from a bounded sample of the labelled documents; without any, one that matches nothing."""
    scratch = Scratch(docs.sparkSession)
    lexicon = learn(scratch.keep(labelled_sample(docs, labels, "toxic", sample), "sample"), exceptions)
    scratch.drop("sample")
    return lexicon


NEW = ("density", "score", "predicted")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", names: tuple[str, str, str] = NEW) -> DataFrame:
    """``docs`` with ``density``, ``score`` (0 to 1, higher is more toxic) and ``predicted`` (1 from 0.5 on).

    Null or empty text scores as text without a match. Other columns are kept;
    ones named like the new columns, whose ``names`` can be given, are replaced.
    """
    told = (lexicon.weights, lexicon.exceptions, lexicon.slope, lexicon.offset)
    rows = docs.select(*[quoted(name) for name in docs.columns if name not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*told)
        for batch in batches:
            for part in arrow_text.slices(batch, text):
                densities = np.array([own.density(t) for t in arrow_text.texts(part.column(text))], np.float64)
                scores = 1.0 / (1.0 + np.exp(-np.clip(own.slope * densities + own.offset, -40.0, 40.0)))
                new = [pa.array(densities), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    new = [StructField(name, kind) for name, kind in zip(names, (DoubleType(), DoubleType(), IntegerType()), strict=True)]
    return map_arrow(rows, run, StructType([*rows.schema.fields, *new]))


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns as they are."""
    names = tuple(free_name(name, docs.columns) for name in NEW)
    return score_toxicity(docs, lexicon, names=names).where(F.col(names[2]) == 0).select(*map(quoted, docs.columns))
