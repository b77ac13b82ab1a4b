"""Words and word shingles of whole texts as hashes, straight from Arrow buffers.

Words are maximal runs of bytes other than blank and 0x09-0x0D, with A-Z lowered. A run of up to
``SPAN`` bytes is hashed by tabulation: every (place in the run, byte) has a random number of
64 bits, and their sum, read off prefix sums over a slice of texts, is the hash. No two
different runs, however built, collide more often than random numbers do. Longer runs are
hashed one by one (xxh3). No Python object is made per word. Where a collision must not matter,
callers compare bytes or a second hash from another table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

#: Words in a shingle.
WORDS = 5
#: Texts are taken in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Bytes of a run that are hashed by tabulation.
SPAN = 64


@cache
def folding() -> tuple[np.ndarray, np.ndarray]:
    """What each byte counts as (A-Z as a-z), and which bytes part words."""
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return fold, space


@cache
def _table(number: int) -> np.ndarray:
    return np.random.default_rng([20240501, number]).integers(0, 2**64, SPAN * 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Runs:
    """Maximal runs of bytes of one class within texts data[offsets[i]:offsets[i + 1]].

    ``inside`` has each byte's class, 0 or False outside runs; ``fold`` what each byte counts as.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray):
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        edge[1:n] |= inside[1:] != inside[:-1]
        self.starts = np.flatnonzero((inside != 0) & edge[:n])
        edge[n] = True
        self.ends = np.flatnonzero((inside != 0) & edge[1:]) + 1
        self.sizes = self.ends - self.starts
        #: runs before each text
        self.before = np.searchsorted(self.starts, offsets)
        #: the bytes of all runs one after another, as they count, and where each run begins among them
        self.folded = fold[data[inside != 0]]
        self.at = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.folded), dtype=np.int32) - np.repeat(self.at.astype(np.int32), self.sizes)
        self._cells = (place & (SPAN - 1)) << 8 | self.folded
        self._sums: dict[int, np.ndarray] = {}

    def _total(self, table: int, size: np.ndarray) -> np.ndarray:
        """Hashes of the first ``size`` bytes of each run."""
        if table not in self._sums:
            self._sums[table] = np.concatenate([[np.uint64(0)], np.cumsum(_table(table)[self._cells], dtype=np.uint64)])
        sums = self._sums[table]
        return mixed(sums[self.at + size] - sums[self.at] + size.astype(np.uint64))

    def hashes(self, table: int = 0) -> np.ndarray:
        """The hash of each run; those of different tables are independent."""
        h = self._total(table, self.sizes)
        for i in np.flatnonzero(self.sizes > SPAN).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.folded[self.at[i] : self.at[i] + self.sizes[i]], seed=table + 1)
        return h

    def heads(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes, SPAN at most; shorter runs get 0."""
        return np.where(self.sizes >= size, self._total(0, np.minimum(self.sizes, size)), np.uint64(0))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Runs:
    fold, space = folding()
    return Runs(data, offsets, ~space[data], fold)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive slices; a null text has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _rolled(h: np.ndarray, weights: np.ndarray, words: int) -> np.ndarray:
    """The hash of every ``words`` neighbouring words."""
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled += h[k : k + len(rolled)] * weights[k]
    return mixed(rolled + np.uint64(words))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, one text after another, and their bounds per text.

    A shingle is two independent hashes of 64 bits, in the order of the first within a text; a
    text with fewer words has their whole sequence as one.
    """
    runs = words_of(data, offsets)
    rng = np.random.default_rng(77)
    weights = rng.integers(1, 2**63, (2, words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = [runs.hashes(0), runs.hashes(1)]
    rolled = [_rolled(h[i], weights[i], words) for i in (0, 1)]
    counts, parts = np.diff(runs.before), []
    for a, n in zip(runs.before[:-1].tolist(), counts.tolist()):
        if n >= words:
            first, second = (r[a : a + n - words + 1] for r in rolled)
            order = np.argsort(first)
            first, second = first[order], second[order]
            new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            parts.append((first[new], second[new]))
        elif n:  # the count keeps lengths apart
            parts.append(tuple(mixed((h[i][a : a + n] * weights[i, :n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) for i in (0, 1)))
        else:
            parts.append((np.empty(0, np.uint64),) * 2)
    bounds = np.cumsum([0, *[len(p) for p, _ in parts]]).astype(np.int64)
    none = [np.empty(0, np.uint64)]
    return np.concatenate([*[p for p, _ in parts], *none]), np.concatenate([*[p for _, p in parts], *none]), bounds


def min_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k minima per text (row) under k orders of the hashes; texts without shingles get zeros."""
    rng = np.random.default_rng(4242)
    factors = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 2**63, k, dtype=np.uint64)
    out = np.zeros((len(bounds) - 1, k), np.uint64)
    some = np.diff(bounds) > 0
    if len(hashes):
        starts = bounds[:-1][some]
        for j in range(k):
            out[some, j] = np.minimum.reduceat((hashes ^ masks[j]) * factors[j], starts)
    return out
