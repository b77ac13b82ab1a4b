"""Command streams: literal runs and matches, as one stream or split into four.

A command is a tag byte below 0x80 (tag + 1 literals follow), 0x80-0xBF (a match of length
(tag & 63) + 4) or 0xC0 (a match whose length follows as a varint); a match ends with its
distance in two bytes. Split apart, tags, literals, lengths and distances are streams of their
own, and a distance is a place in a move-to-front list of four or a varint of itself plus 4.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from blockweave.operators import huffman
from blockweave.operators.errors import CodecError, refuse
from blockweave.operators.matching import Group, Parse

#: Fixed values of the format.
RUN, SHORT_MATCH, LONG_MATCH = 128, 0x80, 0xC0
SHORTEST, SHORT_MOST, FARTHEST = 4, 67, 65_535
SPLIT_MAGIC = b"SPL1"

Step = tuple[int, int, int, int]


def put_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it) of a canonical varint of at most 32 bits."""
    value = 0
    for i in range(5):
        if at + i >= len(data):
            raise refuse("Truncated", "varint")
        byte = data[at + i]
        value |= (byte & 127) << 7 * i
        if byte < 128:
            if i and not byte or value >> 32:
                raise refuse("InvalidMatch", "varint is not canonical")
            return value, at + i + 1
    raise refuse("InvalidMatch", "varint is too long")


class Recent:
    """The four latest distances, the latest first."""

    def __init__(self) -> None:
        self.held: list[int] = []

    def use(self, distance: int) -> int | None:
        """Moves a distance to the front; its place before, if it had one."""
        place = self.held.index(distance) if distance in self.held else None
        if place is not None:
            del self.held[place]
        self.held.insert(0, distance)
        del self.held[4:]
        return place


def commands(data: bytes, steps: list[Step]) -> bytes:
    """The command stream of a parse."""
    out = bytearray()
    for start, literals, length, distance in steps:
        for at in range(start, start + literals, RUN):
            run = min(RUN, start + literals - at)
            out.append(run - 1)
            out += data[at : at + run]
        if length:
            if length <= SHORT_MOST:
                out.append(SHORT_MATCH + length - SHORTEST)
            else:
                out.append(LONG_MATCH)
                out += put_varint(length)
            out += distance.to_bytes(2, "little")
    return bytes(out)


_VARINTS: list[bytes] = []


def _distance_codes(distances: list[int]) -> bytes:
    """Each distance as its place among the four latest, or as a varint of itself plus 4."""
    if not _VARINTS:
        _VARINTS.extend(put_varint(v) for v in range(FARTHEST + SHORTEST + 1))
    out: list[bytes] = []
    a = b = c = d = 0  # the latest first; 0 is no distance
    for x in distances:
        if x == a:
            out.append(b"\0")
        elif x == b:
            out.append(b"\1")
            a, b = x, a
        elif x == c:
            out.append(b"\2")
            a, b, c = x, a, b
        else:
            out.append(b"\3" if x == d else _VARINTS[x + 4])
            a, b, c, d = x, a, b, c
    return b"".join(out)


def command_sizes(parse: Parse) -> np.ndarray:
    """Length of the command stream of each block."""
    length = parse.length
    long = length > SHORT_MOST
    each = parse.literals - (-parse.literals // RUN) + 3 * (length > 0) + long + (long & (length >> 7 > 0)) + (long & (length >> 14 > 0))
    sums = np.concatenate([[0], np.cumsum(each)])
    return sums[parse.first[1:]] - sums[parse.first[:-1]]


def split(group: Group, parse: Parse) -> list[tuple[bytes, bytes, bytes, bytes]]:
    """Tags, literals, lengths and distances of each block."""
    literals, length, first = parse.literals, parse.length, parse.first
    whole, rest = np.divmod(literals, RUN)
    # each step: full runs, the rest of a run, the match
    counts = np.stack([whole, rest > 0, length > 0], axis=1).ravel()
    kinds = np.stack([np.full(len(length), RUN - 1), rest - 1, np.where(length > SHORT_MOST, LONG_MATCH, SHORT_MATCH + length - SHORTEST)], axis=1).ravel()
    tags = np.repeat(kinds.astype(np.uint8), counts).tobytes()
    tag_at = np.concatenate([[0], np.cumsum(counts)])[3 * first].tolist()
    # literals are what no match covers
    edges = np.zeros(len(group.data) + 1, np.int8)
    matched = np.flatnonzero(length)
    begins = (parse.start + literals)[matched]
    edges[begins] += 1
    np.subtract.at(edges, begins + length[matched], 1)  # a match may begin where one ends
    literal_bytes = group.data[np.cumsum(edges[:-1], dtype=np.int8) == 0].tobytes()
    literal_at = np.concatenate([[0], np.cumsum(literals)])[first].tolist()
    match_at = np.searchsorted(matched, first).tolist()
    lengths, distances = length[matched].tolist(), parse.distance[matched].tolist()
    long = (np.flatnonzero(length[matched] > SHORT_MOST)).tolist()
    long_at = np.searchsorted(long, match_at).tolist()
    out = []
    for i in range(len(first) - 1):
        own = b"".join([put_varint(lengths[j]) for j in long[long_at[i] : long_at[i + 1]]])
        out.append((tags[tag_at[i] : tag_at[i + 1]], literal_bytes[literal_at[i] : literal_at[i + 1]], own, _distance_codes(distances[match_at[i] : match_at[i + 1]])))
    return out


def pack_split(blocks: list[tuple[bytes, ...]]) -> list[bytes]:
    """The split form of each block: each stream as it is or entropy-coded, whichever is smaller."""
    streams = [s for block in blocks for s in block]
    # most streams are too short or too even for a code; the entropy tells without making one
    long = [i for i, s in enumerate(streams) if len(s) > huffman.HEADER + 1]
    counts = huffman.histograms([streams[i] for i in long])
    worth = {i: row for i, row, least in zip(long, counts, huffman.least_sizes(counts).tolist()) if least < len(streams[i])}
    out, part = [], []
    for i, stream in enumerate(streams):
        coded = huffman.encode(stream, len(stream), worth[i]) if i in worth else None
        body = stream if coded is None else coded
        part += (b"\0" if coded is None else b"\1", len(body).to_bytes(4, "little"), body)
        if i % 4 == 3:
            out.append(SPLIT_MAGIC + b"".join(part))
            part = []
    return out


def command_limit(original: int) -> int:
    """Bytes that the commands of a block may take at most."""
    return original + -(-original // 128) + 1024


def _parts(body: bytes, original: int) -> list[tuple[bool, bytes]]:
    """Whether each of the four streams is coded, and its bytes as they stand."""
    if body[:4] != SPLIT_MAGIC:
        raise refuse("InvalidEntropyData", "split magic")
    at, parts = 4, []
    for _ in range(4):
        if at + 5 > len(body):
            raise refuse("Truncated", "split stream header")
        coded, size = body[at], int.from_bytes(body[at + 1 : at + 5], "little")
        part = body[at + 5 : at + 5 + size]
        if len(part) < size:
            raise refuse("Truncated", "split stream")
        at += 5 + size
        if coded > 1:
            raise refuse("InvalidEntropyData", "split stream method")
        parts.append((coded == 1, part))
    if at != len(body):
        raise refuse("TrailingData", "split streams")
    return parts


def split_limit(original: int) -> int:
    """Bytes that the four streams of a block may take at most, decoded."""
    return command_limit(original) + -(-original // 4)


def unpack_split(body: bytes, original: int) -> list[bytes]:
    left, streams = split_limit(original), []
    for coded, part in _parts(body, original):
        if not coded and len(part) > left:
            raise refuse("OutputLimitExceeded", "split streams")
        part = huffman.decode(part, left) if coded else part
        left -= len(part)
        streams.append(part)
    return streams


def unpack_all(bodies: list[bytes], originals: list[int]) -> list[list[bytes] | None]:
    """The streams of many split blocks; None for one with anything odd, which ``unpack_split`` can name."""
    out: list[list[bytes] | None] = []
    coded: list[bytes] = []
    limits: list[int] = []
    places: list[tuple[int, int]] = []
    for i, (body, original) in enumerate(zip(bodies, originals)):
        try:
            parts = _parts(body, original)
        except CodecError:
            out.append(None)
            continue
        for k, (is_coded, part) in enumerate(parts):
            if is_coded:
                coded.append(part)
                limits.append(split_limit(original))
                places.append((i, k))
        out.append([part for _, part in parts])
    for (i, k), part in zip(places, huffman.decode_all(coded, limits)):
        if part is None:
            out[i] = None
        elif out[i] is not None:
            out[i][k] = part
    return [x if x is not None and sum(map(len, x)) <= split_limit(n) else None for x, n in zip(out, originals)]


Command = tuple[bytes, int, int]


def read_commands(stream: bytes) -> Iterator[Command]:
    """(literals, match length, distance) of each command of one stream."""
    at, size = 0, len(stream)
    while at < size:
        tag = stream[at]
        at += 1
        if tag < SHORT_MATCH:
            end = at + tag + 1
            if end > size:
                raise refuse("Truncated", "literals")
            yield stream[at:end], 0, 0
            at = end
        elif tag <= LONG_MATCH:
            if tag < LONG_MATCH:
                length = (tag & 63) + SHORTEST
            else:
                length, at = get_varint(stream, at)
            if at + 2 > size:
                raise refuse("Truncated", "distance")
            yield b"", length, stream[at] | stream[at + 1] << 8
            at += 2
        else:
            raise refuse("InvalidMatch", "tag")


def read_split(streams: list[bytes], original: int) -> Iterator[Command]:
    """(literals, match length, distance) of each command of four streams, until ``original`` bytes are made."""
    tags, literals, lengths, distances = streams
    literal_at = length_at = distance_at = made = used = 0
    recent = Recent()
    while made < original:
        if used == len(tags):
            raise refuse("Truncated", "tags")
        tag = tags[used]
        used += 1
        if tag < SHORT_MATCH:
            part = literals[literal_at : literal_at + tag + 1]
            if len(part) <= tag:
                raise refuse("Truncated", "literals")
            literal_at += tag + 1
            made += tag + 1
            yield part, 0, 0
            continue
        if tag > LONG_MATCH:
            raise refuse("InvalidMatch", "tag")
        if tag < LONG_MATCH:
            length = (tag & 63) + SHORTEST
        else:
            length, length_at = get_varint(lengths, length_at)
        if distance_at < len(distances) and distances[distance_at] < 128:
            code, distance_at = distances[distance_at], distance_at + 1
        else:
            code, distance_at = get_varint(distances, distance_at)
        if code < 4 and code >= len(recent.held) or code == 4:
            raise refuse("InvalidMatch", "distance code")
        distance = recent.held[code] if code < 4 else code - 4
        if distance > FARTHEST:
            raise refuse("InvalidMatch", "distance")
        recent.use(distance)
        made += length
        yield b"", length, distance
    if (used, literal_at, length_at, distance_at) != tuple(map(len, streams)):
        raise refuse("TrailingData", "split streams")


class Expanded(NamedTuple):
    """The bytes that commands make, and what they were."""

    data: bytes
    literal_commands: int
    match_commands: int
    literal_bytes: int
    matched_bytes: int
    distance_total: int


def restore(found: Iterator[Command], original: int) -> Expanded:
    """The bytes that commands make; exactly ``original`` of them."""
    out = bytearray()
    runs = matches = literal_bytes = distances = 0
    for literals, length, distance in found:
        if literals:
            if len(out) + len(literals) > original:
                raise refuse("Truncated", "literals beyond the block")
            out += literals
            runs += 1
            literal_bytes += len(literals)
            continue
        if length < SHORTEST or not 0 < distance <= len(out) or len(out) + length > original:
            raise refuse("InvalidMatch")
        matches += 1
        distances += distance
        if distance >= length:
            start = len(out) - distance
            out += out[start : start + length]
        else:  # the copy overlaps itself
            unit = out[-distance:]
            out += (unit * (length // distance + 1))[:length]
    if len(out) != original:
        raise refuse("Truncated" if len(out) < original else "LengthMismatch", "block")
    return Expanded(bytes(out), runs, matches, literal_bytes, original - literal_bytes, distances)


def restore_split(streams: list[bytes], original: int) -> Expanded:
    """As ``restore`` of ``read_split``, in one loop; streams with anything odd are left to these two, which name what is wrong."""
    found = _restored(streams, original)
    return found if found is not None else restore(read_split(streams, original), original)


def _restored(streams: list[bytes], original: int) -> Expanded | None:
    tags, literals, lengths, codes = streams
    out, made, distances = bytearray(), 0, []
    literal_at = length_at = code_at = 0
    a = b = c = d = 0  # the latest distance first; 0 is none
    try:
        for tag in tags:
            if tag < SHORT_MATCH:
                end = literal_at + tag + 1
                out += literals[literal_at:end]
                made += end - literal_at
                literal_at = end
                continue
            if tag < LONG_MATCH:
                length = tag - (SHORT_MATCH - SHORTEST)
            else:
                length, length_at = get_varint(lengths, length_at)
                if tag > LONG_MATCH or length < SHORTEST:
                    return None
            code = codes[code_at]
            if code < 128:
                code_at += 1
            else:
                more = codes[code_at + 1]
                if 0 < more < 128:
                    code += (more << 7) - 128
                    code_at += 2
                else:
                    most = codes[code_at + 2]
                    if not more & 128 or not 0 < most < 128:
                        return None
                    code = code & 127 | (more & 127) << 7 | most << 14
                    code_at += 3
            if code > 4:
                distance = code - 4
                if distance == a or distance == b or distance == c:
                    return None
                a, b, c, d = distance, a, b, c
            elif code == 0:
                distance = a
            elif code == 1:
                distance = b
                a, b = b, a
            elif code == 2:
                distance = c
                a, b, c = c, a, b
            elif code == 3:
                distance = d
                a, b, c, d = d, a, b, c
            else:
                return None
            start = made - distance
            made += length
            if start < 0 or made > original:
                return None
            if distance >= length:
                out += out[start : start + length]
            else:
                out += (out[start:] * (length // distance + 1))[:length]
            distances.append(distance)
    except (IndexError, ZeroDivisionError, CodecError):
        return None
    if made != original or len(out) != original or (literal_at, length_at, code_at) != (len(literals), len(lengths), len(codes)):
        return None
    if distances and not 0 < min(distances) <= max(distances) <= FARTHEST:
        return None
    matches = len(distances)
    return Expanded(bytes(out), len(tags) - matches, matches, literal_at, original - literal_at, sum(distances))


def _varints(streams: list[bytes], counts: np.ndarray) -> np.ndarray | None:
    """The values of all streams, ``counts`` in each; None unless they are canonical and of three bytes at most."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    last = data < 128
    ends = np.flatnonzero(last)
    bounds = np.cumsum([0, *map(len, streams)])
    if len(data) and (not last[bounds[1:][np.diff(bounds) > 0] - 1].all()):
        return None
    if (np.diff(np.searchsorted(ends, bounds)) != counts).any():
        return None
    sizes = np.diff(ends, prepend=-1)
    if not len(ends):
        return np.empty(0, np.int64)
    if sizes.max() > 3 or ((sizes > 1) & (data[ends] == 0)).any():
        return None
    values = data[ends].astype(np.int64)
    two, three = np.flatnonzero(sizes > 1), np.flatnonzero(sizes > 2)
    values[two] = values[two] << 7 | data[ends[two] - 1] & 127
    values[three] = values[three] << 7 | data[ends[three] - 2] & 127
    return values


def _distances(codes: list[int], counts: list[int]) -> list[int] | None:
    """What distance codes stand for; each block begins with none held."""
    out: list[int] = []
    put, at = out.append, 0
    for n in counts:
        a = b = c = d = 0
        for code in codes[at : at + n]:
            if code > 4:
                code -= 4
                if code == a or code == b or code == c:
                    return None
                a, b, c, d = code, a, b, c
            elif code == 1:
                a, b = b, a
            elif code == 2:
                a, b, c = c, a, b
            elif code == 3:
                a, b, c, d = d, a, b, c
            elif code:
                return None
            put(a)
        at += n
    return out


def restore_all(blocks: list[list[bytes]], originals: list[int]) -> list[Expanded] | None:
    """As ``restore_split`` for many blocks with array operations; None if any of them has anything odd.

    A byte of a match points at the one it copies; pointers are followed by doubling until all
    stand at literals.
    """
    tags, literals, lengths, codes = ([b[k] for b in blocks] for k in range(4))
    tag = np.frombuffer(b"".join(tags), np.uint8)
    bounds = np.cumsum([0, *map(len, tags)])
    is_match = tag >= SHORT_MATCH
    long = np.flatnonzero(tag == LONG_MATCH)
    if len(tag) and tag.max() > LONG_MATCH:
        return None
    matches = np.concatenate([[0], np.cumsum(is_match)])[bounds]
    own = _varints(lengths, np.diff(np.searchsorted(long, bounds)))
    values = _varints(codes, np.diff(matches))
    if own is None or values is None or len(own) and own.min() < SHORTEST:
        return None
    distances = _distances(values.tolist(), np.diff(matches).tolist())
    if distances is None:
        return None
    size = np.where(is_match, tag.astype(np.int64) - (SHORT_MATCH - SHORTEST), tag.astype(np.int64) + 1)
    size[long] = own
    ends = np.concatenate([[0], np.cumsum(size)])
    base = ends[bounds]
    literal = np.concatenate([[0], np.cumsum(np.where(is_match, 0, size))])[bounds]
    if np.diff(base).tolist() != originals or np.diff(literal).tolist() != list(map(len, literals)):
        return None
    back = np.zeros(len(tag), np.int32)
    back[is_match] = distances
    reach = ends[:-1] - np.repeat(base[:-1], np.diff(bounds))  # bytes of the block before each command
    if (is_match & ((back < 1) | (back > np.minimum(reach, FARTHEST)))).any():
        return None
    back = np.repeat(back, size)
    copied = np.flatnonzero(back).astype(np.int32)
    out = np.empty(len(back), np.uint8)
    out[back == 0] = np.frombuffer(b"".join(literals), np.uint8)
    source = np.arange(len(back), dtype=np.int32)
    source -= back
    to = source[copied]
    while True:
        further = source[to]
        if (further == to).all():
            break
        source[copied] = to = further
    out[copied] = out[to]
    data, at = out.tobytes(), base.tolist()
    counts, runs = np.diff(matches).tolist(), np.diff(bounds).tolist()
    total = np.concatenate([[0], np.cumsum(distances, dtype=np.int64)])[matches]
    literal_bytes = np.diff(literal).tolist()
    return [
        Expanded(data[a:b], n - m, m, plain, b - a - plain, distance)
        for a, b, n, m, plain, distance in zip(at, at[1:], runs, counts, literal_bytes, np.diff(total).tolist())
    ]
