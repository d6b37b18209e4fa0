"""Hard negatives by exact integer inner products, many candidates to a multiplication.

Candidates of one label are packed by Kronecker substitution: component ``j`` of up to
``CANDIDATES`` vectors, biased to be non-negative, fills separate fields of one wide
integer. A field is wide enough for the whole sum, so multiplying that integer by an anchor's
component ``j``, biased too, and adding up over ``j`` gives the products of all
candidates side by side without a carry from field to field:

    sum_j (a_j + M) (c_j + M) = a . c + M * sum(a) + M * sum(c) + d * M * M

The fields are then read back as an array, and the known terms are taken off.

Anchors are dealt into blocks of bounded size and packed rows into buckets; each
block meets each bucket under the key ``(block, bucket)``. Nothing is broadcast by
hand and no key holds more than a block and a bucket. A first pass over the
rows of the anchors' own labels finds the positives, a second over the other
rows the negatives in each positive's band. Both keep only the best few per
task, and a window takes the best of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import Scratch, map_arrow

#: Candidates in a packed row.
CANDIDATES = 1_024
#: Anchors in a block, about.
ANCHORS = 2_048
#: Packed rows in a bucket, about.
PACKED = 16
#: Scores stay below, so that 100 times a score fits a long.
MOST_BITS = 56

_RAW = "id long, label int, components array<long>"
_BLOCK = "label int, ids binary, fields binary, sums binary, bits int, n int, dims int"


class Bias(NamedTuple):
    """The largest size of a component, which is added to all."""

    most: int

    def width(self, dims: int) -> int:
        """Bytes of a field that holds the biased product of two vectors."""
        return 4 if dims * (2 * self.most) ** 2 < 1 << 32 else 8


def valid_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """``id, label, components`` of the rows ``id, vector, label`` that take part, one per id.

    Without are rows with a null id, label or vector, or a component that is
    null or not finite. Of rows that repeat an id, the one with the smallest label, then
    components, takes part. Components are ``floor(scale * x)``.
    """
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    good = rows.where("id is not null and label is not null and vector is not null").where(usable)
    scaled = F.transform("vector", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    found = good.select("id", "label", scaled.alias("components"))
    return found.groupBy("id").agg(F.min(F.struct("label", "components")).alias("row")).select("id", "row.*")


def _pack(label: int, rows: list[tuple[int, np.ndarray]], bias: Bias) -> pa.RecordBatch:
    """Vectors of one label and length as one row of wide integers."""
    ids = np.array([row[0] for row in rows], np.int64)
    vectors = np.stack([row[1] for row in rows])
    width = bias.width(vectors.shape[1])
    biased = np.ascontiguousarray((vectors + bias.most).T, np.uint32 if width == 4 else np.uint64)
    values = [label, ids.tobytes(), biased.tobytes(), vectors.sum(axis=1).tobytes(), 8 * width, len(ids), vectors.shape[1]]
    return pa.RecordBatch.from_pylist([dict(zip(_names(_BLOCK), values, strict=True))], _arrow(_BLOCK))


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])


def packed(vectors: DataFrame, bias: Bias, most: int = CANDIDATES) -> DataFrame:
    """The vectors in packed rows of one label and length each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("components")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(lists.value_lengths()))
            for i, label, vector in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), np.split(flat, ends[:-1]), strict=True):
                if rows and (key != (label, len(vector)) or len(rows) == most):
                    yield _pack(key[0], rows, bias)
                    rows = []
                key = label, len(vector)
                rows.append((i, vector))
        if rows:
            yield _pack(key[0], rows, bias)

    ordered = vectors.select("id", "label", "components").sortWithinPartitions("label", F.size("components"), "id")
    return map_arrow(ordered, run, _BLOCK)


def products(anchor: list[int], wide: list[int], n: int, width: int) -> np.ndarray:
    """The biased products of one anchor with ``n`` packed candidates: a multiplication for each component."""
    total = sum(a * b for a, b in zip(anchor, wide, strict=True))
    return np.frombuffer(total.to_bytes(n * width, "little"), np.uint32 if width == 4 else np.uint64)


class _Anchors:
    """The anchors of a block, by length of their vectors."""

    def __init__(self, rows: list[dict], bias: Bias):
        self.rows = rows
        for row in rows:
            row["sum"] = sum(row["components"])
            row["biased"] = [x + bias.most for x in row["components"]]

    def scores(self, block: dict, bias: Bias, wanted) -> Iterator[tuple[dict, np.ndarray]]:
        """The exact scores of ``block`` for each anchor of its length that ``wanted(anchor)`` chooses."""
        dims, n, width = block["dims"], block["n"], block["bits"] // 8
        size = n * width
        wide = [int.from_bytes(block["fields"][k : k + size], "little") for k in range(0, dims * size, size)]
        known = np.frombuffer(block["sums"], np.int64) * bias.most + dims * bias.most**2
        for row in self.rows:
            if len(row["components"]) == dims and wanted(row):
                found = products(row["biased"], wide, n, width) if dims else np.zeros(n, np.uint64)
                yield row, found.astype(np.int64) - known - bias.most * row["sum"]


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Where the highest scores are, equal ones by smaller id."""
    if len(scores) > 4 * most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:most]]


class _Best:
    """The best few ``(score, id)`` of each key so far."""

    def __init__(self, most: int):
        self.most, self.kept = most, {}

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.kept:
            old = self.kept[key]
            scores, ids = np.concatenate((old[0], scores)), np.concatenate((old[1], ids))
        at = best(scores, ids, self.most)
        self.kept[key] = scores[at], ids[at]


def _met(anchors: DataFrame, blocks: DataFrame, n_blocks: int, n_buckets: int) -> DataFrame:
    """Each block of anchors beside each packed row.

    Anchors are one row per block, repeated for each bucket; packed rows are
    repeated for each block. A sort-merge join, so a task has the rows of a
    block one after the other.
    """
    bucket = F.pmod(F.xxhash64("ids"), F.lit(n_buckets)).cast("int")
    rows = blocks.withColumn("bucket", bucket).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    grouped = anchors.groupBy("block").agg(F.collect_list(F.struct(*[name for name in anchors.columns if name != "block"])).alias("anchors"))
    grouped = grouped.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))))
    return rows.join(grouped.hint("merge"), ["block", "bucket"])


def _each(batches: Iterator[pa.RecordBatch], bias: Bias) -> Iterator[tuple[int, _Anchors, dict]]:
    """The anchors and the packed row of each joined row; a block's anchors are read once while it stays the same."""
    block, anchors = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in ("block", *_names(_BLOCK))}
            if row["block"] != block:
                block, anchors = row["block"], _Anchors(batch.column("anchors")[k].as_py(), bias)
            yield block, anchors, row


def _positives(met: DataFrame, bias: Bias, most: int) -> DataFrame:
    """For each anchor the best rows of its label in each task: ``anchor_id, positive_id, positive_score``."""

    def emit(found: _Best) -> pa.RecordBatch:
        rows = [(key[0], i, s) for key, (scores, ids) in found.kept.items() for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        names = ["anchor_id", "positive_id", "positive_score"]
        return pa.RecordBatch.from_pydict({name: pa.array([row[k] for row in rows], pa.int64()) for k, name in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, of_block = _Best(most), None
        for block, anchors, row in _each(batches, bias):
            if block != of_block:
                yield emit(found)
                found, of_block = _Best(most), block
            ids = np.frombuffer(row["ids"], np.int64)
            for anchor, scores in anchors.scores(row, bias, lambda anchor, row=row: anchor["label"] == row["label"]):
                other = ids != anchor["id"]
                found.add((anchor["id"],), scores[other], ids[other])
        yield emit(found)

    return map_arrow(met, run, "anchor_id long, positive_id long, positive_score long")


def _negatives(met: DataFrame, bias: Bias, most: int, low: int, high: int) -> DataFrame:
    """For each anchor and positive the best rows of other labels in its band, in each task."""
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

    def emit(found: _Best) -> pa.RecordBatch:
        rows = [(a, p, i, sp, s) for (a, p, sp), (scores, ids) in found.kept.items() for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        return pa.RecordBatch.from_pydict({name: pa.array([row[k] for row in rows], pa.int64()) for k, name in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, of_block = _Best(most), None
        for block, anchors, row in _each(batches, bias):
            if block != of_block:
                yield emit(found)
                found, of_block = _Best(most), block
            ids = np.frombuffer(row["ids"], np.int64)
            for anchor, scores in anchors.scores(row, bias, lambda anchor, row=row: anchor["label"] != row["label"] and anchor["positives"]):
                # A band reaches from low to high percent of its positive's score; most candidates are in none.
                bounds = [x["positive_score"] for x in anchor["positives"]]
                near = np.flatnonzero((100 * scores >= low * min(bounds)) & (100 * scores <= high * max(bounds)))
                if not len(near):
                    continue
                some, some_ids = scores[near], ids[near]
                for x in anchor["positives"]:
                    inside = (low * x["positive_score"] <= 100 * some) & (100 * some <= high * x["positive_score"])
                    if inside.any():
                        found.add((anchor["id"], x["positive_id"], x["positive_score"]), some[inside], some_ids[inside])
        yield emit(found)

    return map_arrow(met, run, ", ".join(f"{name} long" for name in names))


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str | Column = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the columns of ``rows``. A score is the inner
    product of the components ``floor(scale * x)``; higher scores come first, ties by
    smaller id. Positives are an anchor's first ``positives`` other rows of its
    label, negatives of a positive the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``. A positive
    with a score below 0, or an empty band, has none and gives no row.

    Rows with a null id, label or vector, or a null or non-finite component
    take no part; of rows that repeat an id one does (:func:`valid_vectors`). Vectors
    are compared with those of their own length; empty ones score 0. No anchors or no
    rows give no rows. Components so large that a score may reach ``2 ** 56`` are an error.
    """
    scratch = Scratch(rows.sparkSession)
    of_row = F.col(label) if isinstance(label, str) else label
    named = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector"), of_row.cast("int").alias("label"), is_anchor.alias("is_anchor"))
    chosen = named.where("is_anchor and id is not null").select(F.col("id").alias("anchor")).distinct()
    vectors = scratch.keep(valid_vectors(named, scale), "vectors")
    size = F.greatest(F.abs(F.array_max("components").cast("double")), F.abs(F.array_min("components").cast("double")))
    of_anchor = F.col("anchor").isNotNull()
    marked = vectors.join(chosen, F.col("id") == F.col("anchor"), "left")
    marked = scratch.keep(marked.withColumn("is_anchor", of_anchor).drop("anchor"), "marked")
    scratch.drop("vectors")
    bounds = marked.agg(F.max(size).alias("most"), F.max(F.size("components")).alias("dims"), F.count_if("is_anchor").alias("anchors")).first()
    bias, dims = Bias(int(bounds.most or 0)), int(bounds.dims or 0)
    if dims * (2 * bias.most) ** 2 >= 1 << MOST_BITS:
        raise ValueError(f"components of up to {bias.most} in {dims} dimensions are too large for exact scores of {MOST_BITS} bits")

    blocks = scratch.keep(packed(marked, bias), "packed")
    n_blocks = max(1, math.ceil(bounds.anchors / ANCHORS))
    n_buckets = max(1, math.ceil(blocks.count() / PACKED))
    anchors = marked.where("is_anchor").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).drop("is_anchor")

    found = _positives(_met(anchors, blocks, n_blocks, n_buckets), bias, positives)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = scratch.keep(found.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "positives")
    lists = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    with_positives = anchors.join(lists, "id")

    found = _negatives(_met(with_positives, blocks, n_blocks, n_buckets), bias, negatives, low, high)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
