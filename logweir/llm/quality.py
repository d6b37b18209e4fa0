"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its hashed words, pairs of
neighbouring words and runs of 3 and 5 characters; a softmax over two classes sits
on top. Both are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled documents, inside one task. Scoring is linear in the
vectors, so the product of each vector with the softmax weights is taken once
and a document's logit is the average of numbers instead of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from logweir.llm import arrow_text
from logweir.llm.common import Scratch, map_arrow
from logweir.llm.shingles import mixed, word_hashes, word_spans
from logweir.llm.toxicity import labelled_sample

#: Labelled documents to learn from, a documented bound of the model.
SAMPLE = 8_000
BUCKETS, DIMENSIONS = 1 << 17, 16
RUNS = (3, 5)
EPOCHS, RATE = 6, 0.5
#: A pair of equal neighbours is one feature whatever the word.
_SAME_WORD = np.uint64(0x5EED)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character, A-Z as a-z, and the offsets of the texts in them.

    A character is a byte that begins one with up to three that go on; its
    number holds all of them.
    """
    begins = (data & 0xC0) != 0x80
    at = np.flatnonzero(begins)
    folded = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    codes, inside = folded[at].astype(np.uint64), np.ones(len(at), bool)
    for k in range(1, 4):
        there = np.minimum(at + k, max(0, len(data) - 1))
        inside &= (at + k < len(data)) & ~begins[there]
        codes |= np.where(inside, folded[there], 0).astype(np.uint64) << np.uint64(8 * k)
    return codes, np.searchsorted(at, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature buckets of all texts, and the offsets of the texts in them. An empty text has none."""
    starts, ends, words = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    pairs = mixed(hashes[:-1] * _PAIR + hashes[1:])
    pairs[hashes[:-1] == hashes[1:]] = _SAME_WORD
    codes, places = characters(data, offsets)
    by_place = []
    for n in RUNS:
        run = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for k in range(n):
            run = run * _STEP + codes[k : k + len(run)] + np.uint64(1)
        by_place.append(mixed(run + np.uint64(n)))
    found, sizes = [], []
    for text in range(len(offsets) - 1):
        a, b, begin, end = words[text], words[text + 1], places[text], places[text + 1]
        own = [hashes[a:b], pairs[a : max(a, b - 1)], *(run[begin : max(begin, end - n + 1)] for n, run in zip(RUNS, by_place, strict=True))]
        found += own
        sizes.append(sum(map(len, own)))
    buckets = np.concatenate(found) if found else np.empty(0, np.uint64)
    return (buckets % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """The number of each bucket and the constant of the logit of class 1.

    ``examples`` are the distinct buckets of a text and their shares, which add
    up to 1. The rate falls linearly to zero; the order is new in each epoch and
    depends on ``seed`` only.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1.0 / DIMENSIONS, 1.0 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, 2), np.float32)
    constant = np.zeros(2, np.float32)
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(examples)):
            buckets, shares = examples[k]
            rate = RATE * (1.0 - done / steps)
            done += 1
            hidden = shares @ vectors[buckets]
            logits = hidden @ weights + constant
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[labels[k]] -= 1.0
            back = weights @ wrong
            weights -= rate * np.outer(hidden, wrong)
            constant -= rate * 0.1 * wrong
            vectors[buckets] -= (rate * VECTOR_RATE) * np.outer(shares, back)
    return vectors @ (weights[:, 1] - weights[:, 0]), float(constant[1] - constant[0])


#: Vectors of a long text get a share of the gradient each, so they learn at a higher rate.
VECTOR_RATE = 20.0


@dataclass
class Model:
    numbers: np.ndarray
    constant: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each text; a text without features has the constant alone."""
        buckets, places = features(data, offsets)
        sums = np.concatenate(([0.0], np.cumsum(self.numbers[buckets], dtype=np.float64)))
        logits = (sums[places[1:]] - sums[places[:-1]]) / np.maximum(1, np.diff(places)) + self.constant
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -40, 40)))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model of all batches."""
    examples: dict[tuple, tuple] = {}
    for batch in batches:
        for part in arrow_text.slices(batch):
            buckets, places = features(*arrow_text.utf8(part.column("text")))
            for k, (doc_id, label) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("label").to_pylist(), strict=True)):
                own, counts = np.unique(buckets[places[k] : places[k + 1]], return_counts=True)
                if len(own):
                    examples[doc_id, k, len(own)] = (own.astype(np.int32), (counts / counts.sum()).astype(np.float32), label)
    ordered = [examples[key] for key in sorted(examples)]
    labels = np.array([label for *_, label in ordered], np.int64)
    numbers, constant = train([(own, shares) for own, shares, _ in ordered], labels) if len(set(labels.tolist())) == 2 else (np.zeros(BUCKETS), 0.0)
    yield pa.RecordBatch.from_pydict({"numbers": [numbers.astype(np.float32).tobytes()], "constant": [constant]})


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents; without both labels it says 0.5 of every text."""
    scratch = Scratch(docs.sparkSession)
    known = scratch.keep(labelled_sample(docs, labels, "quality", sample), "sample")
    row = map_arrow(known.repartition(1).sortWithinPartitions("doc_id"), _trained, "numbers binary, constant double").first()
    scratch.drop("sample")
    return Model(np.frombuffer(row.numbers, np.float32) if row else np.zeros(BUCKETS, np.float32), row.constant if row else 0.0)


def score_quality(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from ``threshold`` on).

    Null counts as empty. Other columns are kept; ones named like the new
    columns are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.numbers.tobytes(), model.constant))
    rows = docs.select(*[name for name in docs.columns if name not in ("score", "predicted")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, constant = sent.value
        own = Model(np.frombuffer(numbers, np.float32), constant)
        for batch in batches:
            for part in arrow_text.slices(batch, text):
                scores = own.scores(*arrow_text.utf8(part.column(text)))
                new = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "score", "predicted"])

    new = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return map_arrow(rows, run, StructType([*rows.schema.fields, *new]))
