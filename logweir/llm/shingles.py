"""Sets of word shingles as sorted 64-bit hashes, made from the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
WORDS = 5
#: Bytes that are hashed at a time.
BLOCK = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.default_rng(20240229)
#: A random number for each byte, the same for A-Z and a-z.
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _RANDOM.integers(1, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**64, dtype=np.uint64)) | 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


#: Powers of an odd number modulo 2**64, and of its inverse, for the places of a block.
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``data``, and the index of the first word of each text (and one more)."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; upper and lower case of A-Z count as equal.

    A word's bytes are weighed by powers of their place in it. Sums run inside
    blocks, whatever the length of the text; a word over several blocks is the sum of its parts.
    """
    hashes = np.zeros(len(starts), np.uint64)
    for begin in range(0, len(data), BLOCK):
        part = data[begin : begin + BLOCK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=sums[1:])
        first, last = np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, begin + len(part))
        froms = np.maximum(starts[first:last], begin) - begin
        own = (sums[np.minimum(ends[first:last] - begin, len(part))] - sums[froms]) * _DOWN[froms]
        if last > first and starts[first] < begin:
            own[:1] *= np.uint64(pow(_BASE, int(begin - starts[first]), 2**64))
        hashes[first:last] += own
    return mixed(hashes + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other, and the offsets of the texts.

    A text of fewer than ``WORDS`` words has its whole sequence as its only
    shingle, one without words has none.
    """
    starts, ends, words = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = max(0, len(hashes) - WORDS + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(WORDS):
        whole += hashes[k : k + n] * _PLACE[k]
    whole = mixed(whole)
    sets = []
    for begin, end in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if end - begin >= WORDS:
            values = np.sort(whole[begin : end - WORDS + 1])
            sets.append(values[np.concatenate(([True], values[1:] != values[:-1]))])
        elif end > begin:
            short = hashes[begin:end] * _PLACE[: end - begin]
            sets.append(mixed(np.array([short.sum(dtype=np.uint64) + np.uint64(end - begin)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))
