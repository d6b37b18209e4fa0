"""Token counts by SentencePiece: batches of texts in, lengths out.

Arrow batches are cut into slices of about equal bytes. In this vocabulary's
BPE no piece has a space mark behind another character, so a single space
between two other characters is a safe boundary: the parts can be encoded apart,
with the mark that encoding puts before each text in place of the space. Texts
are cut there, each distinct part of a slice is encoded once, and only the
lengths are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from logweir.llm import arrow_text
from logweir.llm.common import map_arrow

#: The space mark of SentencePiece; a text that contains it is encoded whole.
MARK = "▁"
#: Characters from which on a text with other than single spaces is cut at the next safe boundary.
LONG = 1 << 16
_SAFE = re.compile(r"(?<=[^ ]) (?=[^ ])")
_PROCESSORS: dict = {}


def safe_parts(text: str, size: int = LONG) -> list[str]:
    """``text`` without the spaces at safe boundaries; parts of ``size`` characters or up to the next boundary.

    If all spaces are single ones, every word is a part.
    """
    if MARK in text or not text:
        return [text]
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    parts, begin = [], 0
    while len(text) - begin > size and (cut := _SAFE.search(text, begin + size)):
        parts.append(text[begin : cut.start()])
        begin = cut.end()
    return [*parts, text[begin:]]


def processor(model: bytes):
    import sentencepiece

    key = hash(model)
    if _PROCESSORS.get("key") != key:
        _PROCESSORS.update(key=key, processor=sentencepiece.SentencePieceProcessor(model_proto=model))
    return _PROCESSORS["processor"]


def lengths(texts: list[str], encoder) -> np.ndarray:
    """The number of tokens of each text."""
    cut = [safe_parts(text) for text in texts]
    parts = list(set(chain.from_iterable(cut)))
    counts: dict[str, int] = {}
    for k in range(0, len(parts), 10_000):
        some = parts[k : k + 10_000]
        counts.update(zip(some, map(len, encoder.encode(some, num_threads=1)), strict=True))
    return np.fromiter((sum(map(counts.__getitem__, own)) for own in cut), np.int64, len(cut))


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Null counts as empty: 0 bytes and tokens. No tokens are added, and control
    tokens written out in a text are ordinary text. ``model_file`` is on the
    driver and sent to the tasks. Other columns are kept; ones named like the
    new columns are replaced.
    """
    with open(model_file, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    kept = [name for name in docs.columns if name not in (text, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*kept, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = processor(sent.value)
        for batch in batches:
            for part in arrow_text.slices(batch):
                texts = part.column("text")
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                counts = pa.array(lengths(arrow_text.texts(texts), encoder))
                new = [sizes, counts, pc.greater(counts, limit)]
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, *new], [*kept, "n_bytes", "n_tokens", "over_limit"])

    new = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    return map_arrow(rows, run, StructType([*rows.select(*kept).schema.fields, *new]))
