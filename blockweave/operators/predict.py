"""Byte predictors: wrapping difference and exclusive-or with the byte before."""

from __future__ import annotations

import numpy as np

from blockweave.operators.matching import Group, hash3

#: Fixed values of the format.
NONE, DELTA, XOR = 0, 1, 2
#: A block shorter than LEAST is never predicted; at most SAMPLE bytes are looked at.
LEAST, SAMPLE, MARGIN, SLOTS = 64, 8192, 64, 4096
#: Stands for a block's number where three bytes belong to none.
CROSSING = 255


def forward(data: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == NONE or not len(data):
        return data
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    return data - before if predictor == DELTA else data ^ before


def inverse(data: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == NONE or not len(data):
        return data
    return np.cumsum(data, dtype=np.uint8) if predictor == DELTA else np.bitwise_xor.accumulate(data)


def transformed(group: Group, predictors: np.ndarray) -> Group:
    """The blocks of a group, each changed by its own predictor."""
    if (predictors == NONE).all() or not len(group.data):
        return group
    data = group.data
    before = np.zeros_like(data)
    before[1:] = data[:-1]
    before[group.bounds[:-1][np.diff(group.bounds) > 0]] = 0
    if (predictors == predictors[0]).all():
        return Group(data - before if predictors[0] == DELTA else data ^ before, group.bounds)
    own = predictors[group.owners()]
    return Group(np.where(own == DELTA, data - before, np.where(own == XOR, data ^ before, data)), group.bounds)


def scores(group: Group, predictor: int) -> np.ndarray:
    """Per block: places whose latest predecessor with the same 12-bit hash holds the same three bytes."""
    blocks = len(group.bounds) - 1
    if blocks >= CROSSING:  # the number of a block stands in the high byte of its triples
        parts = [Group(group.data[group.bounds[a] : group.bounds[b]], group.bounds[a : b + 1] - group.bounds[a]) for a, b in _runs(blocks, CROSSING - 1)]
        return np.concatenate([scores(part, predictor) for part in parts])
    changed = transformed(group, np.full(blocks, predictor)).data
    if len(changed) < 3:
        return np.zeros(blocks, np.int64)
    x = changed.astype(np.uint16)
    slot = hash3(x[:-2], x[1:-1], x[2:])
    slot &= np.uint16(SLOTS - 1)
    wide = changed.astype(np.uint32)
    owner = group.owners()[:-2].astype(np.uint32)
    triple = owner << np.uint32(24)
    triple |= wide[:-2] << np.uint32(16)
    triple |= wide[1:-1] << np.uint32(8)
    triple |= wide[2:]
    # places at the end of a block, whose three bytes reach into the next, equal nothing
    ends = group.bounds[1:][np.diff(group.bounds) > 0]
    crossing = np.concatenate([ends - 1, ends - 2])
    crossing = np.unique(crossing[(crossing >= 0) & (crossing < len(triple))])
    triple[crossing] = np.uint32(CROSSING << 24) | np.arange(len(crossing), dtype=np.uint32)
    order = np.argsort(slot, kind="stable")
    triple = triple[order]
    same = triple[1:][triple[1:] == triple[:-1]]  # equal bytes of a block have the same slot, too
    return np.bincount(same >> np.uint32(24), minlength=blocks)


def _runs(n: int, size: int) -> list[tuple[int, int]]:
    return [(at, min(at + size, n)) for at in range(0, n, size)]


def score(data: np.ndarray, predictor: int, stretch: int = 1 << 20) -> int:
    """As ``scores`` for one blob, a stretch at a time: the latest three bytes of each slot are carried on."""
    changed, total = forward(data, predictor), 0
    latest = np.full(SLOTS, -1, np.int64)
    for at in range(0, len(changed) - 2, stretch):
        x = changed[at : at + stretch + 2].astype(np.int64)
        slot, triple = hash3(x[:-2], x[1:-1], x[2:]) & SLOTS - 1, x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        slot, triple = slot[order], triple[order]
        new = np.concatenate([[True], slot[1:] != slot[:-1]])
        total += int(((triple[1:] == triple[:-1]) & ~new[1:]).sum()) + int((latest[slot[new]] == triple[new]).sum())
        last = np.concatenate([new[1:], [True]])
        latest[slot[last]] = triple[last]
    return total


def choices(group: Group) -> np.ndarray:
    """Per block the predictor whose sample repeats clearly more than the plain bytes."""
    sizes = np.minimum(np.diff(group.bounds), SAMPLE)
    sample = group
    if (np.diff(group.bounds) > SAMPLE).any():
        sample = Group.of([group.data[a : a + n] for a, n in zip(group.bounds[:-1].tolist(), sizes.tolist())])
    plain, delta, xor = (scores(sample, p) for p in (NONE, DELTA, XOR))
    return chosen(sizes, plain, delta, xor)


def chosen(sizes: np.ndarray, plain: np.ndarray, delta: np.ndarray, xor: np.ndarray) -> np.ndarray:
    bar = plain + sizes // MARGIN
    out = np.where((delta > bar) & (delta >= xor), DELTA, np.where(xor > bar, XOR, NONE))
    return np.where(sizes < LEAST, NONE, out)


def choose(data: np.ndarray) -> int:
    return int(choices(Group.of([data]))[0])
