"""Near-duplicates by MinHash and a multi-index join on the Hamming distance of signatures.

A document is the set of its distinct ``WORDS``-word shingles. Its signature has
``chunks * width`` symbols of 16 bits, each the remainder of a MinHash value, so the share
of equal symbols estimates the Jaccard similarity. The signature is cut into
``chunks`` chunks. Two signatures with at most ``distance = 2 * chunks - 1`` unequal
symbols have, by the pigeonhole principle, a chunk with at most one unequal
symbol; each chunk is entered in the index once for every symbol left out. So
all pairs up to that distance meet under a key. With the ``CONTRACT`` layout a pair
at a similarity of 0.85 is farther apart with a probability of about 1 in
6,000, at 0.9 of 1 in 4 million; with ``CORPUS`` one at 0.80 of 1 in 10,000.

Steps, none of which lists all pairs of a group:

1. documents with equal sets are one class from here on, so copies cost nothing;
2. under a key with up to ``SMALL`` classes all pairs within ``distance`` are confirmed
   on their full sets;
3. under a larger key each class is compared with the smallest one, its center:
   linear in the index. What the class lacks of the center's set and what it
   has beyond it, its delta, gives the exact intersection of any two classes
   of a center: ``center - lacks_x - lacks_y + common part of the deltas``;
4. the links found so far form components. Centers whose classes are all in one
   component are done; under the others the deltas are compared, in blocks of
   bounded size, and only links that join two components are given out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm import arrow_text
from logweir.llm.common import Scratch, free_name, map_arrow, mark_possible, quoted, release_memory, share_package, union_all
from logweir.llm.components import components
from logweir.llm.shingles import mixed, shingle_sets

class Layout(NamedTuple):
    """The threshold of a link, ``100 * intersection >= percent * union``, and the signature that finds links."""

    percent: int
    chunks: int
    width: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1


CONTRACT = Layout(85, 11, 6)
#: For a corpus: texts from a similarity of 0.80 on.
CORPUS = Layout(80, 14, 5)
CHUNKS, WIDTH = CONTRACT.chunks, CONTRACT.width
SYMBOLS, DISTANCE = CONTRACT.symbols, CONTRACT.distance
#: Classes under a key up to which all its pairs are candidates.
SMALL = 32
#: Classes in a block of a center.
BLOCK = 2_048

#: Bytes of text whose sets are made at a time; a longer text comes alone.
BYTES = 1 << 19
#: Elements of sets that a signature's symbols are made from at a time.
STRETCH = 1 << 17


@cache
def _numbers(layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a layout's symbols are made with, and its keys."""
    random = np.random.default_rng(layout.percent)
    xor = random.integers(0, 2**64, layout.symbols, dtype=np.uint64)
    times = random.integers(0, 2**64, layout.symbols, dtype=np.uint64) | np.uint64(1)
    return xor, times, random.integers(0, 2**64, (layout.chunks, layout.width), dtype=np.uint64) | np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray, layout: Layout = CONTRACT) -> np.ndarray:
    """One row of 16-bit symbols for each non-empty set."""
    xor, times, _ = _numbers(layout)
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    least = np.full((layout.symbols, len(begins)), np.uint64(2**64 - 1))
    # Sets of several texts are cut nowhere but at the borders of a stretch, which a long set spans.
    for at in range(0, len(values) if len(begins) else 0, STRETCH):
        part = values[at : at + STRETCH]
        first, last = np.searchsorted(begins, at, side="right") - 1, np.searchsorted(begins, at + len(part))
        own = np.maximum(begins[first:last] - at, 0)
        for k in range(layout.symbols):
            np.minimum(least[k, first:last], np.minimum.reduceat((part ^ xor[k]) * times[k], own), out=least[k, first:last])
    return (mixed(least) >> np.uint64(48)).astype(np.uint16).T.copy()


def index_keys(found: np.ndarray, layout: Layout = CONTRACT) -> np.ndarray:
    """The ``chunks * width`` keys of each signature: every chunk without one of its symbols."""
    shape = layout.chunks, layout.width
    parts = found.reshape(-1, *shape).astype(np.uint64) * _numbers(layout)[2]
    rest = parts.sum(axis=2, dtype=np.uint64)[:, :, None] - parts
    place = np.arange(layout.symbols, dtype=np.uint64).reshape(shape)
    return mixed(mixed(rest) + place).reshape(-1, layout.symbols).view(np.int64)


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in arrow_text.slices(batch, most=BYTES):
        yield part, *shingle_sets(*arrow_text.utf8(part.column("text")))


def _describe(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, values, offsets in _sets_of(batch):
            sizes = np.diff(offsets)
            rows = iter(signatures(values, offsets, layout))
            digests = [blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            found = [next(rows).tobytes() if size else None for size in sizes]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(found, pa.binary())],
                ["doc_id", "n_shingles", "digest", "signature"],
            )


def describe(docs: DataFrame, layout: Layout = CONTRACT) -> DataFrame:
    """``doc_id, n_shingles, digest, signature`` of each row of ``doc_id, text``; the last two are null without words."""
    return map_arrow(docs, lambda batches: _describe(batches, layout), "doc_id long, n_shingles long, digest binary, signature binary")


def _matrix(column: pa.Array, layout: Layout) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, layout.symbols)


def _keys(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = index_keys(_matrix(batch.column("signature"), layout), layout)
            ids = np.repeat(batch.column("id").to_numpy(), layout.symbols)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])


def _near(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            apart = (_matrix(batch.column("signature_a"), layout) != _matrix(batch.column("signature_b"), layout)).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= layout.distance))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, values, offsets in _sets_of(batch):
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists.cast(pa.list_(pa.int64()))], ["id", "shingles"])


def _sets_by_id(ids: DataFrame, docs: DataFrame) -> DataFrame:
    found = mark_possible(docs, F.col("doc_id"), ids, "possible").where("possible")
    return map_arrow(found.join(ids, found["doc_id"] == ids["id"], "left_semi").select("doc_id", "text"), _sets, "id long, shingles array<long>")


def _joined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with their sets ``of_a, of_b``."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"of_{side}")), side)
    return pairs


def _is_link(common: Column, sizes: Column, layout: Layout) -> Column:
    return 100 * common >= layout.percent * (sizes - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, layout: Layout) -> DataFrame:
    """The pairs ``a, b`` that are links by their full sets."""
    common, sizes = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    return _joined(pairs, sets).where(_is_link(common, sizes, layout)).select("a", "b")


def _with_deltas(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """For each center ``a`` and class ``b``: sizes, how much of the center's set the class lacks, and its delta."""
    lacks, beyond = F.array_except("of_a", "of_b"), F.array_except("of_b", "of_a")
    found = _joined(stars, sets).select(
        "a", "b", F.size("of_a").alias("of_center"), F.size("of_b").alias("size"), F.size(lacks).alias("lacks"), F.concat(lacks, beyond).alias("delta")
    )
    return found


def _within_distance(pairs: DataFrame, nodes: DataFrame, layout: Layout) -> DataFrame:
    """Pairs that can be links by the sizes of their sets and the distance of their signatures."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(*[F.col(old).alias(new) for old, new in (("id", side), ("n_shingles", f"n_{side}"), ("signature", f"signature_{side}"))]), side)
    possible = 100 * F.least("n_a", "n_b") >= layout.percent * F.greatest("n_a", "n_b")
    return map_arrow(pairs.where(possible).select("a", "b", "signature_a", "signature_b"), lambda batches: _near(batches, layout), "a long, b long")


def _small_pairs(keys: DataFrame, small: DataFrame) -> DataFrame:
    """All pairs of classes under one small key."""
    lists = keys.join(small.select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    first = lists.select("ids").distinct().select(F.posexplode("ids").alias("place", "a"), "ids")
    pairs = first.select("a", F.explode(F.slice("ids", F.col("place") + 2, F.size("ids"))).alias("b"))
    return pairs.where("a < b").distinct()


def _joining_links(rows: pd.DataFrame, layout: Layout) -> pd.DataFrame:
    """Links between components among the classes of one center in two blocks (or one).

    Classes in the center's component are compared with others only. A link is
    given out if it joins what the links before it have not.
    """
    rows = rows.sort_values("b").reset_index(drop=True)
    ids, sizes, lacks, own = (rows[name].to_numpy(np.int64) for name in ("b", "size", "lacks", "component"))
    center, block = rows["of_center"].iloc[0], rows["block"].to_numpy()
    crossing = rows["low"].iloc[0] != rows["high"].iloc[0]
    lengths = rows["delta"].map(len).to_numpy()
    elements = np.unique(np.concatenate(rows["delta"].to_list()), return_inverse=True)[1]
    begins = np.concatenate(([0], np.cumsum(lengths)))
    holders = np.repeat(np.arange(len(ids)), lengths)[np.argsort(elements, kind="stable")]
    places = np.concatenate(([0], np.cumsum(np.bincount(elements))))
    label = np.unique(own, return_inverse=True)[1]
    outside = np.flatnonzero(own != rows["of_center_component"].iloc[0])
    found = []
    for x in outside.tolist():
        mine = elements[begins[x] : begins[x + 1]]
        shared = np.concatenate([holders[places[e] : places[e + 1]] for e in mine.tolist()] or [holders[:0]])
        common = center - lacks[x] - lacks + np.bincount(shared, minlength=len(ids))
        wanted = (label != label[x]) & (100 * common >= layout.percent * (sizes + sizes[x] - common))
        if crossing:
            wanted &= block != block[x]
        for y in np.flatnonzero(wanted).tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                found.append((ids[x], ids[y]))
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _links_across(deltas: DataFrame, found: DataFrame, layout: Layout) -> DataFrame:
    """Links between components among the classes that share a center."""
    share_package(deltas.sparkSession)
    members = deltas.join(found.select(F.col("id").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    centers = members.groupBy("a").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    centers = centers.join(found.select(F.col("id").alias("a"), F.col("component").alias("of_center_component")), "a", "left")
    centers = centers.withColumn("of_center_component", F.coalesce("of_center_component", "a"))
    open_ = centers.where("n > 1 and (least <> most or least <> of_center_component)").select("a", "n", "of_center_component")
    members = members.join(open_, "a")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("b"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def joining(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return _joining_links(rows, layout)
        finally:
            release_memory()

    return members.groupBy("a", "low", "high").applyInPandas(joining, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", layout: Layout = CONTRACT) -> DataFrame:
    """For every row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of anything but ASCII white space, A-Z in lower case; texts
    are linked if their sets of distinct shingles have a similarity of
    ``layout.percent`` or more. ``component_id`` is the smallest id reachable over links, ``kept`` marks
    the rows with that id. A text without words (null, empty, blank) is linked
    with nothing. A row without id is linked with nothing either: its
    ``component_id`` is null and it is kept. Rows that repeat an id are one document
    with the links of all their texts. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = scratch.keep(describe(docs, layout), "rows")
    linked = rows.where("digest is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "n_shingles", "signature")).alias("first")
    nodes = linked.groupBy("digest").agg(first).select("digest", F.col("first.doc_id").alias("id"), "first.n_shingles", "first.signature")
    nodes = scratch.keep(nodes, "nodes")

    keys = map_arrow(nodes.select("id", "signature"), lambda batches: _keys(batches, layout), "key long, id long")
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("center")).where("n > 1")
    buckets = scratch.keep(buckets, "buckets")
    small, large = buckets.where(F.col("n") <= SMALL), buckets.where(F.col("n") > SMALL)
    pairs = scratch.keep(_within_distance(_small_pairs(keys, small), nodes, layout), "pairs")
    stars = keys.join(large, "key").where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    stars = scratch.keep(stars, "stars")
    scratch.drop("buckets")

    ids = union_all([pairs, stars]).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = scratch.keep(ids, "ids")
    sets = scratch.keep(_sets_by_id(ids, docs), "sets")
    deltas = scratch.keep(_with_deltas(stars, sets), "deltas")
    near = deltas.where(_is_link(F.col("of_center") - F.col("lacks"), F.col("of_center") + F.col("size"), layout)).select("a", "b")
    links = scratch.keep(union_all([_confirmed(pairs, sets, layout), near]), "links")
    scratch.drop("sets", "pairs", "stars", "ids")
    found = scratch.keep(components(links, scratch), "found")
    more = scratch.keep(_links_across(deltas, found, layout), "more-links")
    if not more.isEmpty():
        found = scratch.keep(components(union_all([links, more]), scratch, "all-components"), "all-found")
    scratch.drop("deltas", "links", "more-links")

    classes = nodes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    classes = scratch.keep(classes, "classes")
    known = rows.withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest")))
    placed = known.join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        least = placed
    else:
        # Rows of one id are one document: the smallest of its components, and of theirs.
        least = _same_id(placed, scratch)
    return least.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """``placed`` with components joined that share an id with texts in each."""
    placed = scratch.keep(placed, "placed")
    links = placed.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).where("a <> b")
    found = scratch.keep(components(links, scratch, "ids"), "ids-found")
    joined = placed.drop("component_id").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", layout: Layout = CONTRACT) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns as they are.

    Rows without id stay. Only rows that a bounded map of the ids to drop
    marks are joined with these; the others go on as they were read.
    """
    scratch = Scratch(docs.sparkSession)
    dropped, possible = (free_name(name, docs.columns) for name in ("dropped", "possible"))
    ids = near_duplicates(docs, doc_id, text, layout).where("not kept").select(F.col("doc_id").alias(dropped)).distinct()
    ids = scratch.keep(ids, "dropped")
    own = F.col(quoted(doc_id)).cast("long")
    marked = mark_possible(docs, own, ids, possible)
    some = marked.where(F.col(possible)).join(ids, own == F.col(dropped), "left_anti")
    columns = [quoted(name) for name in docs.columns]
    return marked.where(~F.col(possible)).select(*columns).unionAll(some.select(*columns))
