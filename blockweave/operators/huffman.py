"""Canonical prefix codes over bytes: a count, 256 code lengths, then the codes, high bits first."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np

from blockweave.operators.errors import refuse

#: Fixed values of the format.
SYMBOLS, HEADER, LONGEST = 256, 260, 24
#: Bytes that are coded with array operations at once.
STRETCH = 1 << 16
#: Stands for bits that no code begins with; longer than any code.
NO_CODE = 255


def best_depths(counts: Sequence[int]) -> tuple[list[int], list[int]]:
    """The bytes that occur, by rising count, and their depths in the best prefix code, however deep; a byte alone has depth 0.

    Equal counts meet in the order in which they arose.
    """
    # Leaves in the order of their counts and merged nodes in the order in which they arise are two
    # sorted queues; of equal counts a leaf comes first, for it arose first.
    present = sorted((s for s, n in enumerate(counts) if n), key=counts.__getitem__)
    weights = [int(counts[s]) for s in present]
    leaves = len(weights)
    above = [0] * (2 * leaves - 1)
    leaf, node = 0, leaves
    for new in range(leaves, 2 * leaves - 1):
        weight = 0
        for _ in range(2):
            if leaf < leaves and (node == new or weights[leaf] <= weights[node]):
                least, leaf = leaf, leaf + 1
            else:
                least, node = node, node + 1
            above[least] = new
            weight += weights[least]
        weights.append(weight)
    levels = [0] * (2 * leaves - 1)
    for i in range(2 * leaves - 3, -1, -1):
        levels[i] = levels[above[i]] + 1
    return present, levels[:leaves]


def code_lengths(counts: Sequence[int]) -> np.ndarray | None:
    """Code length of every byte in the codec's own code, one bit for a byte alone. None without bytes or beyond LONGEST."""
    present, depths = best_depths(counts)
    if not present or max(depths) > LONGEST:
        return None
    depth = np.zeros(SYMBOLS, np.uint8)
    depth[present] = depths if len(present) > 1 else 1
    return depth


def canonical(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in the order of their codes, their codes aligned to LONGEST bits); refuses lengths that no prefix code has."""
    order = np.argsort(depth, kind="stable")
    sorted_depth = depth[order]
    unused = int(np.searchsorted(sorted_depth, 1))
    order = order[unused:]
    share = np.int64(1) << (LONGEST - sorted_depth[unused:].astype(np.int64))
    ends = np.cumsum(share)
    if len(ends) and ends[-1] > 1 << LONGEST:
        raise refuse("InvalidEntropyData", "code lengths")
    return order, ends - share


def bit_cost(counts: np.ndarray, depth: np.ndarray) -> int:
    return int((counts.astype(np.int64) * depth).sum())


def histograms(parts: list[bytes]) -> np.ndarray:
    """How often each byte occurs in each part, a row per part."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts), dtype=np.int32) << 8, list(map(len, parts)))
    return np.bincount(row | data, minlength=SYMBOLS * len(parts)).reshape(-1, SYMBOLS)


def least_sizes(counts: np.ndarray) -> np.ndarray:
    """Bytes that no coded form of each histogram's bytes can do without: its header and the entropy."""
    total = counts.sum(axis=1)
    bits = total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=1)
    return HEADER + np.floor(bits / 8 * 0.999999).astype(np.int64)


def encode(data: bytes, below: int | None = None, counts: np.ndarray | None = None) -> bytes | None:
    """The coded form; None without one, or if it would not be shorter than ``below``."""
    if below is not None and below <= HEADER + 1 or not data or len(data) >> 32:
        return None
    x = np.frombuffer(data, np.uint8)
    counts = np.bincount(x, minlength=SYMBOLS) if counts is None else counts
    depth = code_lengths(counts.tolist())
    if depth is None or below is not None and HEADER + -(-bit_cost(counts, depth) // 8) >= below:
        return None
    order, aligned = canonical(depth)
    # a row of bits for every byte, from which those behind its code are left out
    longest = int(depth.max())
    codes = np.zeros(SYMBOLS, np.int64)
    codes[order] = aligned
    bits = (codes[:, None] >> np.arange(LONGEST - 1, LONGEST - 1 - longest, -1) & 1).astype(np.uint8)
    used = np.arange(longest) < depth[:, None]
    packed = [np.packbits(bits[x][used[x]])] if len(x) <= STRETCH else _packed(x, bits, used)
    return b"".join([len(data).to_bytes(4, "little"), depth.tobytes(), *[p.tobytes() for p in packed]])


def _packed(x: np.ndarray, bits: np.ndarray, used: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of a long stream, a stretch at a time."""
    rest = np.empty(0, np.uint8)
    for at in range(0, len(x), STRETCH):
        part = x[at : at + STRETCH]
        rest = np.concatenate([rest, bits[part][used[part]]])
        whole = len(rest) & ~7
        yield np.packbits(rest[:whole])
        rest = rest[whole:]
    yield np.packbits(rest)


def decode(coded: bytes, limit: int) -> bytes:
    """The bytes of a coded stream, at most ``limit``."""
    if len(coded) < HEADER:
        raise refuse("InvalidEntropyData", "header")
    count = int.from_bytes(coded[:4], "little")
    if count > limit:
        raise refuse("OutputLimitExceeded", f"{count} over {limit}")
    depth = np.frombuffer(coded, np.uint8, SYMBOLS, 4)
    if depth.max() > LONGEST:
        raise refuse("InvalidEntropyData", "code length")
    order, aligned = canonical(depth)
    body = np.frombuffer(coded, np.uint8, offset=HEADER)
    if not count:
        if len(body):
            raise refuse("TrailingData", "entropy data")
        return b""
    if not len(order):
        raise refuse("InvalidEntropyData", "no codes")
    if not len(body):
        raise refuse("Truncated", "entropy data")
    # what would be read at every bit: a table over the bits of the longest code, each entry a byte
    # and below it the size of its code; then only the places are followed
    total, longest = 8 * len(body), int(depth.max())
    shares = (np.int64(1) << longest) >> depth[order].astype(np.int64)
    known = np.repeat(order.astype(np.uint16) << np.uint16(8) | depth[order], shares)
    table = np.concatenate([known, np.full((1 << longest) - len(known), NO_CODE, np.uint16)])
    padded = np.concatenate([body, np.zeros(4, np.uint8)])
    out: list[np.ndarray] = []
    at = made = 0
    shifts = np.arange(8, dtype=np.uint32)
    while made < count:
        # a stretch of bytes at a time, so that memory does not grow with the stream
        first = at >> 3
        part = padded[first : first + STRETCH + 3].astype(np.uint32)
        if len(part) < 5:
            raise refuse("Truncated", "entropy data")
        words = part[:-3] << 24 | part[1:-2] << 16 | part[2:-1] << 8 | part[3:]
        windows = ((words[:, None] << shifts) >> np.uint32(32 - longest)).ravel()
        found = table[windows]
        step, here, stop, places = found.astype(np.uint8).tobytes(), at - 8 * first, len(windows), array("i")
        take = places.append
        while here < stop:
            take(here)
            here += step[here]
        if made + len(places) > count:
            here = places[count - made]
            del places[count - made :]
        found = found[np.frombuffer(places, np.int32)]
        bad = np.flatnonzero(found == NO_CODE)
        if len(bad):
            raise refuse("InvalidEntropyData" if 8 * first + places[bad[0]] + LONGEST <= total else "Truncated", "code")
        out.append((found >> np.uint16(8)).astype(np.uint8))
        made += len(places)
        at = 8 * first + here
    if at > total:
        raise refuse("Truncated", "entropy data")
    if -(-at // 8) != len(body):
        raise refuse("TrailingData", "entropy data")
    if at % 8 and int(body[-1]) & (1 << 8 - at % 8) - 1:
        raise refuse("InvalidEntropyData", "padding")
    return b"".join([x.tobytes() for x in out])


#: Codes longer than this are left to ``decode``; entries of the tables of streams that are decoded together, at most.
QUICK, TABLES = 16, 1 << 19


def decode_all(streams: list[bytes], limits: list[int]) -> list[bytes | None]:
    """The bytes of many coded streams; None for one with anything odd, which ``decode`` can name."""
    out: list[bytes | None] = [None] * len(streams)
    sound = [i for i, s in enumerate(streams) if len(s) > HEADER and 0 < int.from_bytes(s[:4], "little") <= limits[i]]
    if not sound:
        return out
    depths = np.frombuffer(b"".join([streams[i][4:HEADER] for i in sound]), np.uint8).reshape(-1, SYMBOLS)
    longest = depths.max(axis=1)
    rows = np.flatnonzero((longest > 0) & (longest <= QUICK))
    if not len(rows):
        return out
    width = int(longest[rows].max())
    each = max(1, TABLES >> width)
    for at in range(0, len(rows), each):
        part = rows[at : at + each]
        _decode_group(streams, [sound[i] for i in part.tolist()], depths[part], width, out)
    return out


def _decode_group(streams: list[bytes], own: list[int], depths: np.ndarray, width: int, out: list[bytes | None]) -> None:
    order = np.argsort(depths, axis=1, kind="stable")
    ordered = np.take_along_axis(depths, order, axis=1)
    shares = np.where(ordered > 0, np.int64(1 << width) >> ordered.astype(np.int64), 0)
    rest = (1 << width) - shares.sum(axis=1)
    if (rest < 0).any():  # lengths that no prefix code has
        keep = np.flatnonzero(rest >= 0)
        if len(keep):
            _decode_group(streams, [own[i] for i in keep.tolist()], depths[keep], width, out)
        return
    entries = np.concatenate([order.astype(np.uint16) << np.uint16(8) | ordered, np.full((len(own), 1), NO_CODE, np.uint16)], axis=1)
    table = np.repeat(entries.ravel(), np.concatenate([shares, rest[:, None]], axis=1).ravel())
    bodies = [streams[i][HEADER:] for i in own]
    sizes = np.array([len(b) + 4 for b in bodies])
    data = np.frombuffer(b"\0\0\0\0".join([*bodies, b""]) + b"\0\0\0", np.uint8).astype(np.uint32)
    words = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
    base = np.repeat(np.arange(len(own), dtype=np.uint32) << np.uint32(width), sizes)
    windows = ((words[:, None] << np.arange(8, dtype=np.uint32)) >> np.uint32(32 - width)) + base[:, None]
    found = table[windows.ravel()]
    step = found.astype(np.uint8).tobytes()
    places, counts, ends, begins = array("i"), [], [], (np.cumsum(sizes) - sizes).tolist()
    take = places.append
    for i, body, begin in zip(own, bodies, begins):
        here, before, count = 8 * begin, len(places), int.from_bytes(streams[i][:4], "little")
        stop = here + 8 * len(body)
        while here < stop:
            take(here)
            here += step[here]
        if len(places) - before > count:
            here = places[before + count]
            del places[before + count :]
        counts.append(len(places) - before)
        ends.append(here - 8 * begin)
    values = found[np.frombuffer(places, np.int32)]
    broken = np.concatenate([[0], np.cumsum(values.astype(np.uint8) == NO_CODE)])
    decoded = (values >> np.uint16(8)).astype(np.uint8).tobytes()
    at = 0
    for i, body, n, end in zip(own, bodies, counts, ends):
        whole = n == int.from_bytes(streams[i][:4], "little") and -(-end // 8) == len(body) and not (end % 8 and body[-1] & (1 << 8 - end % 8) - 1)
        if whole and broken[at] == broken[at + n]:
            out[i] = decoded[at : at + n]
        at += n
