"""Archives: a header, blocks with headers of their own, and an end mark."""

from __future__ import annotations

from collections.abc import Generator
from mmap import mmap
from typing import NamedTuple

from blockweave.operators.block import REFERENCE, STORED, Block
from blockweave.operators.errors import refuse
from blockweave.plans.ranges import LEAST_BLOCK, MOST_BLOCK

#: Fixed values of the format: magic by version, sizes of headers, the end mark, flags and block sizes.
MAGIC = {4: b"XCA4", 5: b"XCA5", 6: b"XCA6", 7: b"XCA7", 8: b"XCA8"}
HEADER, BLOCK_HEADER, END = 12, 14, 255
HAS_CHECKSUMS, HAS_REFERENCES = 1, 2
DEFAULT_BLOCK = 256 * 1024
#: Decoded bytes that are accepted unless a caller says otherwise.
DEFAULT_LIMIT = 1 << 30


class Head(NamedTuple):
    """What the first bytes of an archive say."""

    version: int
    legacy_level: int | None
    has_references: bool
    block_size: int


def check_block_size(size: int) -> int:
    if not LEAST_BLOCK <= size <= MOST_BLOCK:
        raise refuse("InvalidBlockSize", str(size))
    return size


def header(block_size: int, references: bool = False) -> bytes:
    flags = HAS_CHECKSUMS | (HAS_REFERENCES if references else 0)
    return MAGIC[8] + bytes([0, flags, 0, 0]) + block_size.to_bytes(4, "little")


def block_bytes(b: Block) -> bytes:
    if max(b.original, len(b.payload)) >> 32:
        raise refuse("InputTooLarge", "a block is over the size a field can hold")
    head = bytes([b.method, b.predictor])
    return head + b"".join(x.to_bytes(4, "little") for x in (b.original, len(b.payload), b.checksum)) + b.payload


def end_mark() -> bytes:
    return bytes([END]) + bytes(BLOCK_HEADER - 1)


def read_header(data: bytes) -> Head:
    version = next((v for v, magic in MAGIC.items() if data[:4] == magic), None)
    if len(data) < HEADER or version is None:
        raise refuse("BadMagic")
    level, flags = data[4], data[5]
    if level if version == 8 else not 1 <= level <= 9:
        raise refuse("InvalidLevel", str(level))
    if not flags & HAS_CHECKSUMS or flags & ~(HAS_CHECKSUMS | HAS_REFERENCES) or any(data[6:8]):
        raise refuse("InvalidEntropyData", "flags")
    size = check_block_size(int.from_bytes(data[8:12], "little"))
    return Head(version, None if version == 8 else level, bool(flags & HAS_REFERENCES), size)


def _u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def read_block(data: bytes, at: int, head: Head, made: int, limit: int | None) -> tuple[Block, int] | None:
    """The block at ``at`` and the place behind it; none at the end mark. ``made`` bytes came before it."""
    field = data[at : at + BLOCK_HEADER]
    if len(field) < BLOCK_HEADER:
        raise refuse("Truncated", "block header")
    method, predictor = field[0], field[1]
    if method == END:
        if any(field[1:]):
            raise refuse("InvalidMatch", "end mark")
        return None
    original, packed, checksum = _u32(field, 2), _u32(field, 6), _u32(field, 10)
    if not 0 < original <= head.block_size or packed > original:
        raise refuse("InvalidBlockSize", f"{original}, packed {packed}")
    if method > REFERENCE or predictor > 2:
        raise refuse("UnsupportedMethod", f"{method}, predictor {predictor}")
    if limit is not None and made + original > limit:
        raise refuse("OutputLimitExceeded", f"{made + original} over {limit}")
    body = data[at + BLOCK_HEADER : at + BLOCK_HEADER + packed]
    if len(body) < packed:
        raise refuse("Truncated", "payload")
    if method == STORED and (predictor or packed != original):
        raise refuse("InvalidMatch", "stored block")
    if method == REFERENCE and (not head.has_references or predictor or packed != 4):
        raise refuse("InvalidMatch", "reference block")
    return Block(method, predictor, original, checksum, body), at + BLOCK_HEADER + packed


def read_blocks(data: bytes | mmap, limit: int | None = None, trailing: bool = False) -> Generator[Block, None, int]:
    """The blocks of an archive one by one, each with every structural rule checked; returns the place behind the end mark."""
    head, at, made = read_header(data[:HEADER]), HEADER, 0
    known: list[tuple[int, int]] = []
    while (step := read_block(data, at, head, made, limit)) is not None:
        b, at = step
        if b.method == REFERENCE:
            target = _u32(b.payload, 0)
            if target >= len(known):
                raise refuse("InvalidMatch", "reference to a later block")
            if known[target][0] != b.original:
                raise refuse("LengthMismatch", "reference")
            if known[target][1] != b.checksum:
                raise refuse("ChecksumMismatch", "reference")
        known.append((b.original, b.checksum))
        made += b.original
        yield b
    at += BLOCK_HEADER
    if not trailing and at != len(data):
        raise refuse("TrailingData", str(len(data) - at))
    return at


def parse(data: bytes, limit: int | None = None, trailing: bool = False) -> tuple[Head, list[Block], int]:
    """Header, blocks and the place behind the end mark; payloads are not decoded."""
    found: list[Block] = []
    blocks = read_blocks(data, limit, trailing)
    while True:
        try:
            found.append(next(blocks))
        except StopIteration as stop:
            return read_header(data[:HEADER]), found, stop.value


def target_of(b: Block) -> int | None:
    return _u32(b.payload, 0) if b.method == REFERENCE else None


def assemble(parts: list[Block]) -> bytes:
    """The archive of ordered blocks."""
    size = max([LEAST_BLOCK, *(b.original for b in parts)])
    references = any(b.method == REFERENCE for b in parts)
    return b"".join([header(size, references), *map(block_bytes, parts), end_mark()])
