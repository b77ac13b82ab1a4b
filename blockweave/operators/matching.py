"""Matches of blocks with their own past, many blocks at once.

Which earlier places a position may copy from does not depend on how a block is parsed, so the
best match of every position is found with array operations over a whole group of blocks laid
end to end; only the walk that takes one match after another is sequential.

Positions sorted by the hash of their three bytes stand beside their candidates: the k-th
nearest earlier one with the same hash is the k-th neighbour. Four equal bytes in the same block
are one comparison of neighbours, so candidates that cannot match cost next to nothing.
"""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np

#: Fixed values of the format and its parser.
WINDOW, LONGEST, SHORTEST, CANDIDATES = 65_535, 65_535, 4, 16
#: Factors of the hash of three bytes; the third has none.
FIRST, SECOND = 251, 31
#: Lengths found with array operations; a longer match is measured when it is taken.
MEASURED = 64


class Group(NamedTuple):
    """Blocks laid end to end: block i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, blocks: list[np.ndarray]) -> Group:
        data = blocks[0] if len(blocks) == 1 else np.concatenate([*blocks, np.empty(0, np.uint8)])
        return cls(data, np.cumsum([0, *map(len, blocks)]))

    def owners(self) -> np.ndarray:
        """The block of every byte."""
        sizes = np.diff(self.bounds)
        return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


class Parse(NamedTuple):
    """Steps of all blocks of a group in order; block i has steps[first[i]:first[i + 1]].

    A step is a run of literals and a match behind it; only the last of a block may be without
    a match (length and distance 0).
    """

    start: np.ndarray
    literals: np.ndarray
    length: np.ndarray
    distance: np.ndarray
    first: np.ndarray

    def of(self, block: int, offset: int = 0) -> list[tuple[int, int, int, int]]:
        """(first literal, literals, match length, distance) of each step of one block."""
        own = slice(int(self.first[block]), int(self.first[block + 1]))
        return list(zip((self.start[own] - offset).tolist(), self.literals[own].tolist(), self.length[own].tolist(), self.distance[own].tolist()))


def hash3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of three bytes (as 16-bit numbers or wider) that matching and scoring group places by."""
    return a * a.dtype.type(FIRST) ^ b * b.dtype.type(SECOND) ^ c


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four and the eight bytes from every place on as numbers, zeros behind the end."""
    w = np.zeros(len(data) + MEASURED + 16, np.uint64)
    w[: len(data)] = data
    w[:-1] |= w[1:] << np.uint64(8)
    w[:-2] |= w[2:] << np.uint64(16)
    four = w[: len(data)].copy()
    w[:-4] |= w[4:] << np.uint64(32)
    return four, w


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many of eight bytes agree from the first on, from the exclusive-or of both; 7 for all eight."""
    return (np.bitwise_count(differ ^ (differ - np.uint64(1))) - np.uint8(1)) >> np.uint8(3)


class Matches:
    """The best match of every position: length up to MEASURED (0 without one) and distance; of equal lengths the nearest."""

    def __init__(self, group: Group):
        self.group, data, n = group, group.data, len(group.data)
        self.length, self.distance = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self._rank: np.ndarray | None = None
        ends = group.bounds[1:][np.diff(group.bounds) > 0]
        inside = np.ones(n, bool)  # with three bytes left in the block
        inside[ends - 1] = inside[ends - 2] = False
        places = np.flatnonzero(inside).astype(np.int32)
        x = data.astype(np.uint16)
        self._hash = hash3(x[:-2], x[1:-1], x[2:]) if n > 2 else np.empty(0, np.uint16)
        self._order = places[np.argsort(self._hash[places], kind="stable")] if len(places) else places
        if len(places) > 1:
            self._measure(ends)

    def _measure(self, ends: np.ndarray) -> None:
        order, data = self._order, self.group.data
        four, eight = _words(data)
        owner = self.group.owners()
        four |= owner.astype(np.uint64) << np.uint64(32)
        last = ends - 3  # with three bytes left only: a candidate for others, but never a match
        last = last[last >= 0]
        four[last] = np.uint64(1 << 63) | last.astype(np.uint64)
        room = self.group.bounds[1:].astype(np.int32)[owner] - np.arange(len(data), dtype=np.int32)
        room = np.minimum(room, MEASURED).astype(np.uint8)
        four, next_eight, room = four[order], eight[order + SHORTEST], room[order]
        padded = np.concatenate([data, np.zeros(MEASURED, np.uint8)])
        far = int(np.diff(self.group.bounds).max()) > WINDOW
        length, which = np.zeros(len(order), np.uint8), np.zeros(len(order), np.uint8)
        for k in range(1, min(CANDIDATES, len(order) - 1) + 1):
            there = np.flatnonzero(four[k:] == four[:-k])
            if far:
                there = there[order[there + k] - order[there] <= WINDOW]
            if not len(there):
                continue
            here = there + k
            differ = next_eight[here] ^ next_eight[there]
            size = _equal_bytes(differ)
            size += np.uint8(SHORTEST)
            best = length[here]
            more = np.flatnonzero(differ == 0)
            if len(more):
                at, before, reached = order[here[more]], order[there[more]], best[more]
                # only a candidate that also agrees where the best one so far ends can be longer
                keep = (padded[at + reached] == padded[before + reached]) & (reached < MEASURED)
                size[more[~keep]] = 0
                more, at, before = more[keep], at[keep], before[keep]
                size[more] += np.uint8(1)
                for step in range(SHORTEST + 8, MEASURED, 8):
                    if not len(more):
                        break
                    differ = eight[at + step] ^ eight[before + step]
                    whole = differ == 0
                    size[more] += _equal_bytes(differ) + whole
                    more, at, before = more[whole], at[whole], before[whole]
            np.minimum(size, room[here], out=size)
            longer = size > best
            here = here[longer]
            length[here], which[here] = size[longer], k
        matched = np.flatnonzero(length)
        at = order[matched]
        self.length[at] = length[matched]
        self.distance[at] = at - order[matched - which[matched]]

    def whole(self, at: int, end: int, raw: bytes) -> tuple[int, int]:
        """(length, distance) of the best match at a place, measured to the end of its block."""
        if self._rank is None:
            self._rank = np.zeros(len(self.group.data), np.int32)
            self._rank[self._order] = np.arange(len(self._order), dtype=np.int32)
        rank, most, begin = int(self._rank[at]), min(LONGEST, end - at), int(self.group.bounds[np.searchsorted(self.group.bounds, at, side="right") - 1])
        best = (0, 0)
        for there in self._order[max(0, rank - CANDIDATES) : rank][::-1].tolist():
            if there < begin or at - there > WINDOW or self._hash[there] != self._hash[at]:
                break
            if (size := _common(raw, there, at, most)) > best[0]:
                best = size, at - there
                if size == most:
                    break
        return best


def _common(data: bytes, a: int, b: int, most: int) -> int:
    """Length of the common prefix of data[a:] and data[b:], at most ``most``."""
    size, step = 0, MEASURED
    while size < most:
        step = min(step, most - size)
        if data[a + size : a + size + step] == data[b + size : b + size + step]:
            size += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
    return size


def parse(group: Group) -> Parse:
    """Greedy parse of every block: a match wherever one of SHORTEST bytes at least is found, else a literal."""
    found, bounds, n = Matches(group), group.bounds, len(group.data)
    ahead = np.flatnonzero(found.length).astype(np.int32)
    size = found.length[ahead]
    # matches that begin before each place: the number of the first one from there on
    before = np.zeros(n + 1, np.int32)
    np.cumsum(found.length > 0, out=before[1:])
    after = before[ahead + size]
    after[size == MEASURED] = -1  # the whole length is not known yet
    following, taken, measured, i, raw, count = after.tolist(), array("i"), [], 0, b"", len(ahead)
    take = taken.append
    while i < count:
        take(i)
        i = following[i]
        if i < 0:
            at = int(ahead[taken[-1]])
            raw = raw or group.data.tobytes()
            whole = found.whole(at, int(bounds[np.searchsorted(bounds, at, side="right")]), raw)
            measured.append((len(taken) - 1, *whole))
            i = int(before[at + whole[0]])
    taken = np.frombuffer(taken, np.int32) if taken else np.empty(0, np.int32)
    at = ahead[taken]
    length, distance = found.length[at].astype(np.int64), found.distance[at].astype(np.int64)
    for place, whole, back in measured:
        length[place], distance[place] = whole, back
    # every block gets one more step, for the literals behind its last match
    blocks = len(bounds) - 1
    owner = np.searchsorted(bounds, at, side="right") - 1
    counts = np.bincount(owner, minlength=blocks) + 1
    last = np.cumsum(counts) - 1
    place = np.arange(len(at)) + owner
    start, end, lengths, distances = (np.zeros(len(at) + blocks, np.int64) for _ in range(4))
    lengths[place], distances[place] = length, distance
    end[place], end[last] = at, bounds[1:]  # where the literals of a step end
    start[1:] = (end + lengths)[:-1]
    start[np.concatenate([[0], last[:-1] + 1])[:blocks]] = bounds[:-1]
    some = (end > start) | (lengths > 0)
    first = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], last + 1])]
    return Parse(start[some], (end - start)[some], lengths[some], distances[some], first)
