"""The codec for single byte strings and files, without a session."""

from __future__ import annotations

import os
import tempfile
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice
from mmap import ACCESS_READ, mmap
from typing import BinaryIO, NamedTuple

from blockweave.operators import block as blocks
from blockweave.operators import frame
from blockweave.operators.block import REFERENCE, Block
from blockweave.operators.errors import CodecError, refuse
from blockweave.operators.tokens import Expanded
from blockweave.plans import ranges as plans
from blockweave.plans.ranges import Sizes

VERSION = "1.0"
#: Result codes for callers that want numbers.
CODES = {
    0: "success",
    1: "not bytes",
    2: "the buffer has another size than the output",
    3: "not an archive, or a damaged one",
    4: "the output is over the limit",
    5: "a worker failed",
    6: "out of memory",
}


def code_of(result: str | BaseException | None) -> int:
    """The number of a status, or of what a call raised."""
    if isinstance(result, CodecError):
        result = result.status
    if isinstance(result, str):
        return {"ok": 0, "LengthMismatch": 2, "OutputLimitExceeded": 4}.get(result, 3)
    if result is None:
        return 0
    return 6 if isinstance(result, MemoryError) else 1 if isinstance(result, TypeError) else 5


def error_string(code: int) -> str:
    return CODES.get(code, "no such code")


def compress(data: bytes, sizes: Sizes = Sizes(), smallest: bool = False) -> bytes:
    """The archive of ``data``."""
    return compress_all([data], sizes, smallest)[0]


def compress_all(items: list[bytes], sizes: Sizes = Sizes(), smallest: bool = False) -> list[bytes]:
    """The archive of each item; blocks of different items are encoded together."""
    planned = [plans.plan(data, sizes.checked()) for data in items]
    roots = iter(blocks.encode_all([data[r.start : r.end] for data, ranges in zip(items, planned) for r in ranges if r.target is None], smallest))
    out = []
    for ranges in planned:
        parts: list[Block] = []
        for r in ranges:
            parts.append(next(roots) if r.target is None else Block(REFERENCE, 0, r.end - r.start, parts[r.target].checksum, r.target.to_bytes(4, "little")))
        out.append(frame.assemble(parts))
    return out


def _read(archives: list[bytes], limit: int | None) -> Iterator[tuple[frame.Head, list[Block], Iterator[Expanded | CodecError]] | CodecError]:
    """Header and blocks of each archive, and what its blocks without references hold, decoded together with those of others."""
    parsed: list[tuple[frame.Head, list[Block]] | CodecError] = []
    for archive in archives:
        try:
            parsed.append(frame.parse(archive, limit)[:2])
        except CodecError as e:
            parsed.append(e)
    found = blocks.expand_all(b for p in parsed if not isinstance(p, CodecError) for b in p[1] if b.method != REFERENCE)
    for p in parsed:
        if isinstance(p, CodecError):
            yield p
            continue
        own = islice(found, sum(b.method != REFERENCE for b in p[1]))
        yield *p, own
        for _ in own:  # what the caller did not look at
            pass


def decompress_all(archives: list[bytes], limit: int | None = frame.DEFAULT_LIMIT) -> Iterator[bytes | CodecError]:
    """The bytes of each archive, or why it is refused; references may lead to references, as long as they lead back."""
    for read in _read(archives, limit):
        if isinstance(read, CodecError):
            yield read
            continue
        _, found, roots = read
        done: list[bytes] = []
        bad = None
        for b in found:
            if b.method == REFERENCE:
                done.append(done[frame.target_of(b)])
                continue
            root = next(roots)
            if isinstance(root, CodecError):
                bad = root
                break
            done.append(root.data)
        yield bad if bad is not None else b"".join(done)


def _one(found: Iterator):
    result = next(found)
    if isinstance(result, CodecError):
        raise result
    return result


def decompress(archive: bytes, limit: int | None = frame.DEFAULT_LIMIT) -> bytes:
    return _one(decompress_all([archive], limit))


def decompressed_size(archive: bytes, limit: int | None = None) -> int:
    """Bytes that an archive decodes to, from its headers."""
    return sum(b.original for b in frame.read_blocks(archive, limit))


def decompress_into(archive: bytes, buffer: bytearray | memoryview, limit: int | None = None) -> int:
    """Decodes block by block into a buffer of just the right size; returns the bytes written."""
    size = decompressed_size(archive, limit)
    with memoryview(buffer) as view:
        if size != len(view):
            raise refuse("LengthMismatch", f"{size} bytes for a buffer of {len(view)}")

        def put(at: int, data: bytes) -> None:
            view[at : at + len(data)] = data

        return _decode_to(archive, size, put, lambda at, n: bytes(view[at : at + n]))


def _decode_to(archive: bytes | mmap, limit: int | None, put: Callable[[int, bytes], None], get: Callable[[int, int], bytes]) -> int:
    """Decodes an archive to where ``put`` writes and ``get`` reads back; memory stays at a group of blocks. Returns the bytes written."""
    spans: list[tuple[int, int]] = []  # where each block stands
    held: deque[Block] = deque()
    roots = blocks.expand_all(b for b in _noted(frame.read_blocks(archive, limit), held) if b.method != REFERENCE)

    def write(b: Block, data: bytes) -> None:
        at = spans[-1][0] + spans[-1][1] if spans else 0
        put(at, data)
        spans.append((at, len(data)))

    for root in roots:
        if isinstance(root, CodecError):
            raise root
        while held[0].method == REFERENCE:
            b = held.popleft()
            write(b, get(*spans[frame.target_of(b)]))
        write(held.popleft(), root.data)
    while held:
        b = held.popleft()
        write(b, get(*spans[frame.target_of(b)]))
    return spans[-1][0] + spans[-1][1] if spans else 0


def _noted(found: Iterator[Block], into: deque[Block]) -> Iterator[Block]:
    for b in found:
        into.append(b)
        yield b


def check_all(archives: list[bytes], limit: int | None = frame.DEFAULT_LIMIT) -> Iterator[int | CodecError]:
    """Decoded size of each archive, or why it is refused; what blocks hold is dropped at once."""
    for read in _read(archives, limit):
        if isinstance(read, CodecError):
            yield read
            continue
        bad = next((r for r in read[2] if isinstance(r, CodecError)), None)
        yield bad if bad is not None else sum(b.original for b in read[1])


def check(archive: bytes, limit: int | None = frame.DEFAULT_LIMIT) -> int:
    """Decoded size of an archive that is sound; raises otherwise."""
    return _one(check_all([archive], limit))


def info(archive: bytes, limit: int | None = None) -> dict:
    head, found, _ = frame.parse(archive, limit)
    return {"version": head.version, "legacy_level": head.legacy_level, "block_size": head.block_size, "original_size": sum(b.original for b in found), "frame_size": len(archive), "checksum": True, "blocks": len(found)}


def analyze_all(archives: list[bytes]) -> Iterator[dict[str, int | str]]:
    """Counters of each archive: blocks by method and predictor, bytes and commands; every block is decoded once.

    A refused archive has its status; counters of commands are those of its sound blocks.
    """
    for archive, read in zip(archives, _read(archives, None), strict=True):
        _, found, roots = (None, [], iter(())) if isinstance(read, CodecError) else read
        status = read.status if isinstance(read, CodecError) else "ok"
        methods = {f"{n}_blocks": sum(b.method == m for b in found) for m, n in blocks.METHOD_NAMES.items()}
        predictors = {f"{n}_predictor": sum(b.predictor == p and b.method != REFERENCE for b in found) for p, n in blocks.PREDICTOR_NAMES.items()}
        totals = [0, 0, 0, 0, 0]
        for root in roots:
            if isinstance(root, CodecError):
                status = root.status if status == "ok" else status
            else:
                totals = [x + y for x, y in zip(totals, root[1:], strict=True)]
        sizes = {"original_size": sum(b.original for b in found), "payload_size": sum(len(b.payload) for b in found), "blocks": len(found)}
        commands = dict(zip(("literal_commands", "match_commands", "literal_bytes", "matched_bytes", "distance_total"), totals))
        referenced = sum(b.original for b in found if b.method == REFERENCE)
        yield {**sizes, **methods, **predictors, "referenced_bytes": referenced, **commands, "frame_size": len(archive), "status": status}


def analyze(archive: bytes) -> dict[str, int | str]:
    return next(analyze_all([archive]))


def derived(found: dict[str, int | str]) -> dict[str, int | float]:
    """Shares in thousandths and averages of an analysis; a denominator of zero counts as one."""
    size, matches = max(1, found["original_size"]), max(1, found["match_commands"])
    shares = {f"{c}_permille": found[f"{c}_bytes"] * 1000 // size for c in ("referenced", "literal", "matched")}
    averages = {"average_match": found["matched_bytes"] / matches, "average_distance": found["distance_total"] / matches}
    return {**shares, **averages, "ratio_percent": found["frame_size"] * 100 / size if found["original_size"] else 0.0}


class StreamStats(NamedTuple):
    """What a stream took and gave."""

    input_bytes: int
    output_bytes: int
    blocks: int


def compress_stream(source: BinaryIO, sink: BinaryIO, block_size: int = frame.DEFAULT_BLOCK) -> StreamStats:
    """Encodes a stream in fixed blocks, each on its own; memory stays at one block."""
    frame.check_block_size(block_size)
    taken = given = count = 0

    def put(x: bytes) -> None:
        nonlocal given
        sink.write(x)
        given += len(x)
        if max(taken, given) >> 64:
            raise refuse("InputTooLarge", "the stream is over the size that is counted")

    put(frame.header(block_size))
    while data := _fill(source, block_size):
        put(frame.block_bytes(blocks.encode(data)))
        taken += len(data)
        count += 1
    put(frame.end_mark())
    return StreamStats(taken, given, count)


def compress_fixed(items: list[bytes], block_size: int = frame.DEFAULT_BLOCK) -> list[bytes]:
    """What ``compress_stream`` writes for each item; blocks of different items are encoded together."""
    frame.check_block_size(block_size)
    encoded = iter(blocks.encode_all([x[at : at + block_size] for x in items for at in range(0, len(x), block_size)]))
    return [b"".join([frame.header(block_size), *[frame.block_bytes(next(encoded)) for _ in range(0, len(x), block_size)], frame.end_mark()]) for x in items]


def _fill(source: BinaryIO, size: int) -> bytes:
    """``size`` bytes, fewer only at the end, over any number of short reads."""
    parts, left = [], size
    while left and (part := source.read(left)):
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def decompress_stream(source: BinaryIO, sink: BinaryIO, limit: int | None = None, exact: bool = False) -> StreamStats:
    """Decodes a stream block by block up to its end mark; with ``exact`` nothing may follow.

    Archives with references are refused, since they would need all earlier blocks.
    """
    raw = _fill(source, frame.HEADER)
    head = frame.read_header(raw)
    if head.has_references:
        raise refuse("InvalidMatch", "references in a stream")
    taken, given, count = len(raw), 0, 0
    while True:
        field = _fill(source, frame.BLOCK_HEADER)
        packed = int.from_bytes(field[6:10], "little") if len(field) == frame.BLOCK_HEADER and field[0] != frame.END else 0
        # the sizes are checked before the payload is read
        if packed > head.block_size:
            raise refuse("InvalidBlockSize", str(packed))
        if limit is not None and len(field) == frame.BLOCK_HEADER and field[0] != frame.END and given + int.from_bytes(field[2:6], "little") > limit >= given and int.from_bytes(field[2:6], "little") <= head.block_size:
            raise refuse("OutputLimitExceeded", f"over {limit}")
        data = field + (_fill(source, packed) if packed else b"")
        taken += len(data)
        step = frame.read_block(data, 0, head, given, limit)
        if step is None:
            break
        out = blocks.decode(step[0])
        sink.write(out)
        given += len(out)
        count += 1
    if exact and source.read(1):
        raise refuse("TrailingData")
    return StreamStats(taken, given, count)


def decompress_streams(archives: list[bytes], limit: int | None = None) -> Iterator[tuple[bytes, str]]:
    """What ``decompress_stream`` passes on of each archive that is at hand, and its status; blocks of different archives are decoded together."""
    found: list[tuple[list[Block], str]] = []
    for archive in archives:
        own: list[Block] = []
        status = "ok"
        try:
            if frame.read_header(archive).has_references:
                raise refuse("InvalidMatch", "references in a stream")
            own.extend(frame.read_blocks(archive, limit))
        except CodecError as e:
            status = e.status
        found.append((own, status))
    roots = blocks.expand_all(b for own, _ in found for b in own)
    for own, status in found:
        parts: list[bytes] = []
        bad = None
        for root in islice(roots, len(own)):
            if isinstance(root, CodecError):
                bad = bad or root.status
            elif bad is None:
                parts.append(root.data)
        yield b"".join(parts), bad or status


def read_concatenated(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of each archive in a row of archives."""
    at = 0
    while at < len(data):
        _, _, size = frame.parse(data[at:], trailing=True)
        yield at, at + size
        at += size


def _same_file(a: str, b: str) -> bool:
    return os.path.realpath(a) == os.path.realpath(b) or os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


@contextmanager
def _atomic(path: str) -> Iterator[BinaryIO]:
    """A file beside ``path`` that is moved into place at the end, so that a failure leaves what was there."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(prefix=".blockweave-", dir=folder)
    try:
        with os.fdopen(handle, "w+b") as out:
            yield out
            out.flush()
            os.fsync(out.fileno())
        if os.path.exists(path):
            os.chmod(name, os.stat(path).st_mode & 0o7777)
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise


def write_atomic(path: str, data: bytes) -> None:
    with _atomic(path) as out:
        out.write(data)


@contextmanager
def _mapped(path: str) -> Iterator[bytes | mmap]:
    """The bytes of a file without reading them into memory; an empty file cannot be mapped."""
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            yield b""
            return
        with mmap(f.fileno(), 0, access=ACCESS_READ) as data:
            yield data


def _refuse_same(source: str, target: str) -> None:
    if _same_file(source, target):
        raise ValueError("input and output are the same file")


def compress_file(source: str, target: str, sizes: Sizes = Sizes()) -> tuple[int, int]:
    """(input bytes, output bytes). The input is mapped and the output written block by block."""
    _refuse_same(source, target)
    with _mapped(source) as data, _atomic(target) as out:
        ranges = plans.plan(data, sizes.checked())
        out.write(frame.header(max([frame.LEAST_BLOCK, *(r.end - r.start for r in ranges)]), any(r.target is not None for r in ranges)))
        sums: list[int] = []
        for at in range(0, len(ranges), blocks.TOGETHER):
            part = ranges[at : at + blocks.TOGETHER]
            for some in _some_bytes(part):
                roots = iter(blocks.encode_all([data[r.start : r.end] for r in some if r.target is None]))
                for r in some:
                    b = next(roots) if r.target is None else Block(REFERENCE, 0, r.end - r.start, sums[r.target], r.target.to_bytes(4, "little"))
                    sums.append(b.checksum)
                    out.write(frame.block_bytes(b))
        out.write(frame.end_mark())
        return len(data), out.tell()


def _some_bytes(ranges: list[plans.Range], most: int = 1 << 22) -> Iterator[list[plans.Range]]:
    """Neighbouring ranges of about ``most`` bytes."""
    held: list[plans.Range] = []
    for r in ranges:
        held.append(r)
        if r.end - held[0].start >= most:
            yield held
            held = []
    if held:
        yield held


def decompress_file(source: str, target: str, limit: int | None = frame.DEFAULT_LIMIT) -> tuple[int, int]:
    """(input bytes, output bytes). The archive is mapped, and references are read back from the output."""
    _refuse_same(source, target)
    with _mapped(source) as data, _atomic(target) as out:

        def put(at: int, x: bytes) -> None:
            out.seek(at)
            out.write(x)

        def get(at: int, n: int) -> bytes:
            out.seek(at)
            return out.read(n)

        return len(data), _decode_to(data, limit, put, get)


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


__all__ = [
    "CodecError", "Sizes", "StreamStats", "VERSION", "analyze", "analyze_all", "check", "check_all", "code_of", "compress", "compress_all", "compress_file", "compress_fixed", "compress_stream", "crc32",
    "decompress", "decompress_all", "decompress_file", "decompress_into", "decompress_stream", "decompress_streams", "decompressed_size", "derived", "error_string", "info", "read_concatenated", "write_atomic",
]
