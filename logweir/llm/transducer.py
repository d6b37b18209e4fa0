"""A minimal acyclic transducer from words to token ids, in one block of memory.

Words that share a prefix share states from the start, words that share a
suffix share states to the end. Each edge carries the number of words that
come before it at its state, so the sum along a word's path is the word's rank
among all words; the rank selects its ids. The block holds arrays only and can
be mapped from a file.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from itertools import chain

import numpy as np

#: Words of more bytes are not entered.
LONGEST = 48
_HEAD = 6


def compile_transducer(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The block for ``words`` with their ids.

    Words come in byte order, so the states of the last word beyond what the
    next one shares are final; each of these is replaced by a known state with
    the same edges, if there is one.
    """
    ordered = sorted(words)
    known: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[tuple] = []
    path: list[list] = [[False, []]]  # states of the last word: accepting, edges (byte, target)

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        found = known.get(key)
        if found is None:
            found = known[key] = len(finals)
            finals.append(state[0])
            edges.append(key[1])
        return found

    last = b""
    for word in ordered:
        shared = len(os.path.commonprefix((last, word)))
        while len(path) > shared + 1:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        for _ in word[shared:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    start = freeze(path.pop())

    below = [0] * len(finals)  # words from a state on; targets have smaller numbers
    keys, targets, skips = [], [], []
    for state, (final, own) in enumerate(zip(finals, edges, strict=True)):
        count = int(final)
        for byte, target in own:
            keys.append(state << 8 | byte)
            targets.append(target)
            skips.append(count)
            count += below[target]
        below[state] = count
    ids = [words[word] for word in ordered]
    arrays = [
        np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array(finals, np.uint8),
        np.cumsum([0, *map(len, ids)], dtype=np.int32), np.fromiter(chain.from_iterable(ids), np.int32),
    ]
    head = np.array([start, len(keys), len(finals), len(ordered), len(arrays[-1]), 0], np.int64)
    return b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in [head, *arrays])


def mapped(block: bytes) -> memoryview:
    """``block`` as a file mapped into memory: its pages count as cache, not as the worker's own memory.

    The file has no name any more once it is mapped, so nothing is left behind.
    """
    with tempfile.TemporaryFile() as file:
        file.write(block)
        file.flush()
        return memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


class Transducer:
    """Looks up many words at once in a block made by :func:`compile_transducer`."""

    def __init__(self, block: bytes | memoryview):
        head = np.frombuffer(block, np.int64, _HEAD)
        self.start, n_edges, n_states, self.words, n_ids, _ = map(int, head)
        place = _HEAD * 8
        arrays = []
        for kind, n in ((np.int64, n_edges), (np.int32, n_edges), (np.int32, n_edges), (np.uint8, n_states), (np.int32, self.words + 1), (np.int32, n_ids)):
            arrays.append(np.frombuffer(block, kind, n, place))
            place += -(-arrays[-1].nbytes // 8) * 8
        self.keys, self.targets, self.skips, self.finals, self.offsets, self.ids = arrays

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word in byte order, -1 for a word that was not entered."""
        found = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at = np.flatnonzero(lengths <= LONGEST)
        if not len(self.keys) or not len(at):
            return found
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        begins = np.cumsum(lengths) - lengths
        state, rank = np.full(len(at), self.start, np.int64), np.zeros(len(at), np.int64)
        for step in range(LONGEST + 1):
            ended = lengths[at] == step
            if ended.any():
                good = ended & (self.finals[state] > 0)
                found[at[good]] = rank[good]
                at, state, rank = at[~ended], state[~ended], rank[~ended]
            if not len(at):
                break
            key = state << 8 | data[begins[at] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            at, edge, rank = at[there], edge[there], rank[there]
            state, rank = self.targets[edge].astype(np.int64), rank + self.skips[edge]
        return found

    def entries(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by rank, one after the other, and the number of each word's ids."""
        return gathered(self.ids, self.offsets, ranks)


def gathered(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, one after the other, and their lengths; ``offsets`` says where runs begin."""
    begins = offsets[which].astype(np.int64)
    lengths = offsets[which + 1] - begins
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins - (ends - lengths), lengths) + np.arange(total)], lengths


def starts(lengths: np.ndarray) -> np.ndarray:
    """Offsets of runs of the given lengths."""
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
