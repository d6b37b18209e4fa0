"""Byte-level BPE encoding and decoding with a compiled lexicon of the corpus's frequent words.

The words of all documents are counted; the most frequent ones are encoded once
and compiled into a minimal acyclic transducer (see ``transducer``) that every
task maps into memory. Words that it does not hold are merged by rank, exactly
as the vocabulary file says. The lexicon affects speed only.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, lru_cache
from hashlib import sha256
from itertools import chain, count, islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from logweir.llm import arrow_text
from logweir.llm.common import Scratch, map_arrow, quoted
from logweir.llm.transducer import LONGEST, Transducer, compile_transducer, gathered, mapped, starts

#: Words in the lexicon, which bounds what the driver gathers and sends.
LEXICON = 1 << 18
#: Units that a task remembers or counts before it begins anew, some 200 bytes each.
REMEMBERED = 1 << 18
#: Bytes of a word up to which pairs are searched one by one.
SHORT = 64
#: Words merged side by side.
ABREAST = 1 << 14
#: Greater than any rank.
NONE = (1 << 62, -1)
#: White space of the split pattern.
SPACE = "\t-\r \x85\xa0  -     　"


@cache
def _kind(first: str) -> str:
    """The code points of a Unicode main category as the inside of a character class."""
    found, begin = [], None
    for code in range(0x110001):
        inside = code < 0x110000 and unicodedata.category(chr(code))[0] == first
        if inside and begin is None:
            begin = code
        elif not inside and begin is not None:
            found.append(f"\\U{begin:08x}-\\U{code - 1:08x}")
            begin = None
    return "".join(found)


@cache
def _splitter() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The split of byte-level BPE, what shows that a text's words do not all stand behind single spaces, and single line ends."""
    letter, number = _kind("L"), _kind("N")
    # The order of the alternatives decides the split.
    split = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    return re.compile(split), re.compile(rf" (?:[{SPACE}]|\Z)"), re.compile(rf"\n(?<=[^{SPACE}]\n)(?=[^{SPACE}])")


@cache
def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE, as bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizer file says: merges by rank, bytes of each id, special tokens."""

    def __init__(self, content: str):
        read = json.loads(content)
        ids: dict[str, int] = read["model"]["vocab"]
        byte_of = _byte_of()
        raw = {token: bytes(byte_of[c] for c in token) for token in ids}
        self.of_byte = [ids[c] for c in sorted(byte_of, key=byte_of.get)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        # The merges again as arrays: sorted pairs, their ranks, and the merged id of each rank.
        pairs = np.fromiter((left << 32 | right for left, right in self.merges), np.int64, len(self.merges))
        found = np.fromiter(chain.from_iterable(self.merges.values()), np.int64).reshape(-1, 2)
        order = np.argsort(pairs)
        self._pairs, self._ranks = np.append(pairs[order], 1 << 62), np.append(found[order, 0], NONE[0])
        self._merged = np.zeros(len(read["model"]["merges"]), np.int64)
        self._merged[found[:, 0]] = found[:, 1]
        bytes_ids = self._byte_ids = np.array([*self.of_byte, -1], np.int64)
        self._byte_ranks = self._pair_ranks(bytes_ids[:, None], bytes_ids).ravel()
        self.special = {token["content"]: token["id"] for token in read["added_tokens"]}
        self.bytes_of = {ids[token]: content for token, content in raw.items()}
        self.bytes_of |= {number: text.encode() for text, number in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank is merged first, the leftmost of equal ones."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank = self.merges.get
        ranks = [rank(pair, NONE) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is NONE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((best[1], ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank((ids[i - 1], best[1]), NONE)
        return ids

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; a pair that never merges, or with -1 in it, has one greater than any."""
        pairs = left << 32 | right
        place = np.searchsorted(self._pairs, pairs)
        return np.where(self._pairs[place] == pairs, self._ranks[place], NONE[0])

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words as of :meth:`merge`, one after the other, and the number of each word's ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        flats, counts, begin = [], [], 0
        while begin < len(order):
            # Words of about the same length, so a block has few empty places.
            longest = max(8, 2 * int(lengths[order[begin]]))
            end = min(begin + ABREAST, int(np.searchsorted(lengths, min(longest, SHORT), side="right", sorter=order)))
            if end > begin:
                some, own = self._merge_block([words[k] for k in order[begin:end].tolist()])
            else:
                end = begin + 1
                some = np.array(self.merge(words[order[begin]]), np.int32)
                own = np.array([len(some)])
            flats.append(some)
            counts.append(own)
            begin = end
        if not flats:
            return np.empty(0, np.int32), lengths
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return gathered(np.concatenate(flats), starts(np.concatenate(counts)), place)

    def _merge_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One merge of every word at a time: each column holds the ids of a word, linked from place to place.

        A place knows the rank of the pair that begins there, with the place in
        the low bits, so the least one of a column is the leftmost of the lowest
        rank. The last row is empty: it stands before and behind a word.
        """
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max())
        bits = width.bit_length()
        codes = np.full((width + 1) * n, 256, np.int64)
        row = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes[row * n + np.repeat(np.arange(n), lengths)] = np.frombuffer(b"".join(words), np.uint8)
        ids = self._byte_ids[codes]
        none = NONE[0] >> bits << bits
        rank = np.full((width + 1) * n, none)
        place = np.repeat(np.arange(width), n)
        first = self._byte_ranks[codes[:-n] * 257 + codes[n:]]
        rank[:-n] = np.where(first < NONE[0], first << bits | place, none)
        following = np.arange(n, (width + 2) * n)
        before = np.concatenate((np.arange(width * n, (width + 1) * n), np.arange(width * n)))
        columns = rank.reshape(width + 1, n)

        while True:
            least = columns.min(axis=0)
            at = np.flatnonzero(least < none)
            if not len(at):
                break
            least = least[at]
            i = (least & (1 << bits) - 1) * n + at
            j = following[i]
            k, h = following[j], before[i]
            ids[i] = merged = self._merged[least >> bits]
            ids[j], rank[j] = -1, none
            following[i], before[k] = k, i
            for place, found in ((i, self._pair_ranks(merged, ids[k])), (h, self._pair_ranks(ids[h], merged))):
                rank[place] = np.where(found < NONE[0], found << bits | place // n, none)
        ids = ids.reshape(width + 1, n).T
        return ids[ids >= 0].astype(np.int32), (ids >= 0).sum(axis=1)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list, so a very long word costs little more than its length."""
        merges = self.merges
        heap: list[tuple] = []
        following = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))

        def push(i: int, left: int, right: int) -> None:
            if (left, right) in merges:
                rank, merged = merges[left, right]
                heapq.heappush(heap, (rank, i, merged, left, right))

        for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
            push(i, *pair)
        while heap:
            _, i, merged, left, right = heapq.heappop(heap)
            j = following[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            after = following[i] = following[j]
            if after >= 0:
                before[after] = i
                push(i, merged, ids[after])
            if before[i] >= 0:
                push(before[i], ids[before[i]], merged)
        return [i for i in ids if i >= 0]


def _words(unit: str) -> list[str]:
    """The words of a unit: letters, behind a space or a line end or neither, and the marks behind them need no pattern."""
    core = unit.rstrip(punctuation)
    if core.isalpha() or core[:1] == " " and core[1:].isalpha():
        found = [core]
    elif core[:1] == "\n" and core[1:].isalpha():
        found = ["\n", core[1:]]
    else:
        return _splitter()[0].findall(unit)
    return found if len(core) == len(unit) else [*found, unit[len(core) :]]


def _units(text: str) -> list[str]:
    """``text`` in units that the split never crosses: cut at each space, if those are all single ones, and at single line ends.

    A unit behind a space is written without it, one that begins with a line end
    as it is, any other with a space at its end.
    """
    split, odd, line_end = _splitter()
    if odd.search(text):
        return [word + " " for word in split.findall(text)]
    units = (line_end.sub(" \n", text) if "\n" in text else text).split(" ")
    if not units[0]:
        return units[1:]
    units[0] += " "
    return units


def _written(unit: str) -> str:
    """What stands in the text for a unit of :func:`_units`."""
    return unit[:-1] if unit[-1] == " " else unit if unit[0] == "\n" else " " + unit


class Encoder:
    """Encodes batches of texts by lexicon and vocabulary."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._forget()

    def _forget(self) -> None:
        # Units seen so far with their numbers, and by number their ids.
        self.units: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _cut(self, text: str) -> list[str]:
        """The units of ``text``; special tokens stand alone."""
        pattern = self.vocabulary.special_split
        if pattern is None or not pattern.search(text):
            return _units(text)
        parts = pattern.split(text)
        return list(chain.from_iterable([part + " "] if k % 2 else _units(part) for k, part in enumerate(parts) if part))

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and their offsets."""
        special = self.vocabulary.special
        raw = [word.encode() for word in words]
        ranks = self.lexicon.ranks(raw)
        # Special tokens and unseen words stand behind the known ones, and every word is then picked from where it is.
        fixed = [k for k, word in enumerate(words) if word in special]
        ranks[fixed] = -2
        unseen = np.flatnonzero(ranks == -1)
        merged, counts = self.vocabulary.merge_all([raw[k] for k in unseen.tolist()])
        known, lengths = self.lexicon.entries(ranks[ranks >= 0])
        flat = np.concatenate((known, np.array([special[words[k]] for k in fixed], np.int32), merged))
        place = np.empty(len(words), np.int64)
        place[np.concatenate((np.flatnonzero(ranks >= 0), np.array(fixed, np.int64), unseen))] = np.arange(len(words))
        return _picked(flat, np.concatenate((lengths, np.ones(len(fixed), np.int64), counts)), place)

    def _learn(self, units: list[str]) -> None:
        """Add the ids of new units: these are split into words, distinct words are looked up."""
        special = self.vocabulary.special
        words_of = [[unit] if unit in special else _words(unit) for unit in map(_written, units)]
        words: defaultdict[str, int] = defaultdict(count().__next__)
        of_units = np.fromiter(map(words.__getitem__, chain.from_iterable(words_of)), np.int64)
        flat, offsets = _joined(*self._of_words(list(words)), of_units, np.fromiter(map(len, words_of), np.int64, len(words_of)))
        self.offsets = np.concatenate((self.offsets, offsets[1:] + len(self.flat)))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of the texts in them, put together from the ids of units."""
        if len(self.units) >= REMEMBERED or len(self.flat) >= 4 * REMEMBERED:
            self._forget()
        cut, known = [self._cut(text) for text in texts], len(self.units)
        of_texts = np.fromiter(map(self.units.__getitem__, chain.from_iterable(cut)), np.int64)
        if len(self.units) > known:
            self._learn(list(islice(self.units, known, None)))
        return _joined(self.flat, self.offsets, of_texts, np.fromiter(map(len, cut), np.int64, len(cut)))


class Decoder:
    """Puts texts together from the bytes of their ids."""

    def __init__(self, vocabulary: Vocabulary):
        known = vocabulary.bytes_of
        contents = [known.get(number, b"") for number in range(max(known) + 1)]
        self.data = np.frombuffer(b"".join(contents), np.uint8)
        self.offsets = starts(np.fromiter(map(len, contents), np.int64, len(contents)))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts whose ids lie between ``offsets``; bytes that are no UTF-8 become U+FFFD."""
        data, lengths = gathered(self.data, self.offsets, ids)
        return [own.decode("utf-8", "replace") for own in _runs(data, starts(lengths)[offsets])]


def _runs(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    whole, places = data.tobytes(), offsets.tolist()
    return [whole[a:b] for a, b in zip(places, places[1:], strict=False)]


def _picked(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, lengths = gathered(flat, starts(lengths), which)
    return found, starts(lengths)


def _joined(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which``, and the offsets of groups of ``sizes`` runs each."""
    found, lengths = gathered(flat, offsets, which)
    return found, starts(lengths)[starts(sizes)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units: Counter[str] = Counter()
    for batch in batches:
        for part in arrow_text.slices(batch):
            units.update(chain.from_iterable(map(str.split, arrow_text.texts(part.column("text")))))
            if len(units) >= REMEMBERED:
                yield _word_counts(units)
                units.clear()
    yield _word_counts(units)


def _word_counts(units: Counter[str]) -> pa.RecordBatch:
    words: defaultdict[str, int] = defaultdict(int)
    for unit, n in units.items():
        for word in _words(f" {unit}"):
            words[word] += n
    return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """About the ``most`` words with the highest counts over all of ``docs``, never more.

    A word counts as it would behind a space; only words short enough for the
    lexicon count. The least count comes from a histogram of counts in bins of
    a sixteenth of a power of two, so the driver sees under 1,100 bins and then
    the words themselves.
    """
    scratch = Scratch(docs.sparkSession)
    counts = map_arrow(docs.select("text").where("text is not null"), _counted, "word string, n long")
    counts = counts.where(F.octet_length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts.withColumn("bin", F.floor(16 * F.log2("n")).cast("int")), "counts")
    least, words = None, 0
    for row in counts.groupBy("bin").count().orderBy(F.desc("bin")).collect():
        words += row["count"]
        if words > most:
            break
        least = row.bin
    found = [] if least is None else [row.word for row in counts.where(F.col("bin") >= least).select("word").collect()]
    scratch.drop("counts")
    return found


@lru_cache(maxsize=1)
def _vocabulary(content: str) -> Vocabulary:
    """The last vocabulary that a worker has read."""
    return Vocabulary(content)


@contextmanager
def _tools(content: str, block: bytes) -> Iterator[tuple[Encoder, Decoder]]:
    """Encoder and decoder for one task; a worker that waits for the next keeps the vocabulary only."""
    vocabulary = _vocabulary(content)
    yield Encoder(vocabulary, Transducer(mapped(block))), Decoder(vocabulary)


def _sent(docs: DataFrame, vocabulary_file: str, text: str, lexicon_words: int) -> Broadcast:
    """The vocabulary and the compiled lexicon of ``docs``, for all tasks."""
    with open(vocabulary_file, encoding="utf-8") as file:
        content = file.read()
    vocabulary = Vocabulary(content)
    words = [word.encode() for word in frequent_words(docs.select(F.col(text).alias("text")), lexicon_words)]
    flat, lengths = vocabulary.merge_all(words)
    ids, places = flat.tolist(), starts(lengths).tolist()
    block = compile_transducer({word: ids[a:b] for word, a, b in zip(words, places, places[1:], strict=False)})
    return docs.sparkSession.sparkContext.broadcast((content, block))


def encode(docs: DataFrame, vocabulary_file: str, text: str = "text", lexicon_words: int = LEXICON) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the tokens of the whole text; null counts as empty, which has none.

    ``vocabulary_file`` is a byte-level BPE file on the driver. Special tokens
    written out in a text become their ids, none are added. Any other column is
    kept, one named ``ids`` is replaced.
    """
    sent = _sent(docs, vocabulary_file, text, lexicon_words)
    rows = docs.select(*[name for name in docs.columns if name != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _tools(*sent.value) as (encoder, _):
            for batch in batches:
                for part in arrow_text.slices(batch, text):
                    lists = _lists(*encoder.encode(arrow_text.texts(part.column(text))))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "ids"])

    return map_arrow(rows, run, StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))


def round_trip(docs: DataFrame, vocabulary_file: str, text: str = "text", lexicon_words: int = LEXICON) -> DataFrame:
    """``docs`` with ``ids`` as of :func:`encode`, and as text the one decoded from these; both in one pass of one worker."""
    sent = _sent(docs, vocabulary_file, text, lexicon_words)
    rows = docs.select(*[quoted(name) for name in docs.columns if name != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _tools(*sent.value) as (encoder, decoder):
            for batch in batches:
                for part in arrow_text.slices(batch, text):
                    ids, offsets = encoder.encode(arrow_text.texts(part.column(text)))
                    part = part.set_column(part.schema.names.index(text), text, pa.array(decoder.decode(ids, offsets), pa.string()))
                    yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids, offsets)], [*part.schema.names, "ids"])

    return map_arrow(rows, run, StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, vocabulary_file: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``; special tokens are written out.

    Bytes that are no UTF-8 become U+FFFD. Null or empty ids give empty text.
    Any other column is kept, one named ``decoded`` is replaced.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        decoder = Decoder(Vocabulary(file.read()))
    sent = encoded.sparkSession.sparkContext.broadcast(decoder)
    rows = encoded.select(*[name for name in encoded.columns if name != "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1_000) for k in range(0, batch.num_rows, 1_000)):
                lists = part.column(ids)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = sent.value.decode(lists.flatten().to_numpy(zero_copy_only=False), starts(lengths))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return map_arrow(rows, run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def token_digests(docs: DataFrame, vocabulary_file: str, lexicon_words: int = LEXICON) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of ``doc_id, text``.

    Encodes, and decodes the ids again, in one pass; only digests leave the
    task. Ids are written in decimal and joined by commas.
    """
    sent = _sent(docs, vocabulary_file, "text", lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _tools(*sent.value) as (encoder, decoder):
            names = [b"%d," % number for number in range(len(decoder.offsets) - 1)]
            digits, places = np.frombuffer(b"".join(names), np.uint8), starts(np.fromiter(map(len, names), np.int64, len(names)))
            for batch in batches:
                for part in arrow_text.slices(batch):
                    ids, offsets = encoder.encode(arrow_text.texts(part.column("text")))
                    written, lengths = gathered(digits, places, ids)
                    of_ids = [sha256(own[:-1]).hexdigest() for own in _runs(written, starts(lengths)[offsets])]
                    of_text = [sha256(own.encode()).hexdigest() for own in decoder.decode(ids, offsets)]
                    columns = [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
