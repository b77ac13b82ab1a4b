"""Archives: layouts, structure, corruption, limits, files and streams without a session."""

import io
import os
import random
import stat

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockweave import api, cli
from blockweave.operators import block, frame
from blockweave.operators.block import Block
from blockweave.operators.errors import CodecError
from blockweave.plans import ranges
from blockweave.plans.ranges import Sizes

SMALL = Sizes(block=4096, least_planned=8192, chunk_least=1024, chunk_most=16384, chunk_bits=11, least_period=1024)
TEXT = b"The quick brown fox jumps over the lazy dog. " * 300


def refused(status, call, *args, **kwargs):
    with pytest.raises(CodecError) as e:
        call(*args, **kwargs)
    assert e.value.status == status, e.value


#: About the borders of literal runs, matches, blocks, windows and plans.
BORDERS = sorted({max(0, edge + d) for edge in (0, 4, 64, 128, 260, 4096, 65_535, 131_072) for d in (-1, 0, 1)})


@pytest.mark.parametrize("n", BORDERS)
def test_sizes_round_trip_and_are_deterministic(n):
    data = random.Random(n).randbytes(n)
    archive = api.compress(data)
    assert archive == api.compress(data) and api.decompress(archive) == data
    assert api.check(archive) == n
    assert len(api.compress(b"")) == 26


def test_size_bounds():
    assert len(api.compress(bytes(300_000))) < 250
    assert len(api.compress(b"=" * 12_000)) < 100


def test_copies_become_references():
    base = np.random.default_rng(1).integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    archive = api.compress(base * 8, SMALL)
    _, found, _ = frame.parse(archive)
    referenced = sum(b.original for b in found if b.method == block.REFERENCE)
    assert referenced > 0.75 * 8 * len(base) and api.decompress(archive) == base * 8


@pytest.mark.parametrize("extra", [1, 2, 3])
def test_short_tails_are_never_references(extra):
    unit = random.Random(extra).randbytes(4 * 4096 + extra)
    archive = api.compress(unit * 2, Sizes(block=4096, least_planned=8192, least_period=4096))
    assert api.decompress(archive) == unit * 2


@pytest.mark.parametrize("shift", [1, 15, 255, 4095])
def test_chunks_realign_after_an_insertion(shift):
    base = random.Random(7).randbytes(200_000)
    data = base + random.Random(8).randbytes(shift) + base
    planned = ranges.plan(data, SMALL)
    assert sum(r.end - r.start for r in planned if r.target is not None) > 0.8 * len(base)
    assert [r.start for r in planned[1:]] == [r.end for r in planned[:-1]] and planned[-1].end == len(data)
    assert all(planned[r.target].target is None for r in planned if r.target is not None)


def test_period_detection():
    unit = random.Random(9).randbytes(3000)
    assert ranges.period_of(unit * 6, 1000) == 3000
    assert ranges.period_of(unit * 6 + b"x", 1000) is None
    assert ranges.period_of(unit * 6, 3001) == 6000


def test_every_prefix_is_refused():
    archive = api.compress(TEXT[:3000])
    for n in range(len(archive)):
        with pytest.raises(CodecError):
            api.decompress(archive[:n])
    refused("TrailingData", api.decompress, archive + b"\0")


def test_flips_are_refused():
    rng = random.Random(21)
    data = b"".join(rng.choice([b"north ", b"south ", b"east ", b"west ", b"%d " % rng.randrange(3000)]) for _ in range(4000))
    archive = bytearray(api.compress(data))
    for at in rng.sample(range(frame.HEADER + frame.BLOCK_HEADER, len(archive) - frame.BLOCK_HEADER), 300):
        flip = rng.randrange(1, 256)
        archive[at] ^= flip
        try:
            assert api.decompress(bytes(archive)) == data  # a flip that decodes the same is no corruption
        except CodecError:
            pass
        archive[at] ^= flip


def test_structural_rules():
    good = api.compress(TEXT)
    refused("BadMagic", api.decompress, b"nope" + good[4:])
    refused("BadMagic", api.decompress, good[:8])
    refused("InvalidLevel", api.decompress, good[:4] + b"\1" + good[5:])
    refused("InvalidEntropyData", api.decompress, good[:5] + b"\0" + good[6:])
    refused("InvalidEntropyData", api.decompress, good[:6] + b"\1" + good[7:])
    refused("InvalidBlockSize", api.decompress, good[:8] + (1).to_bytes(4, "little") + good[12:])
    refused("UnsupportedMethod", api.decompress, good[:12] + b"\5" + good[13:])
    refused("InvalidMatch", api.decompress, good[:-1] + b"\1")
    a = block.encode(TEXT)
    ref = Block(block.REFERENCE, 0, a.original, a.checksum, (0).to_bytes(4, "little"))
    assert api.decompress(frame.assemble([a, ref, ref._replace(payload=(1).to_bytes(4, "little"))])) == TEXT * 3
    refused("InvalidMatch", api.decompress, frame.assemble([ref, a]))
    refused("ChecksumMismatch", api.decompress, frame.assemble([a, ref._replace(checksum=1)]))
    refused("LengthMismatch", api.decompress, frame.assemble([a, ref._replace(original=5)]))
    refused("ChecksumMismatch", api.decompress, frame.assemble([a._replace(checksum=a.checksum ^ 1)]))


def test_limits():
    archive = api.compress(TEXT)
    assert api.decompress(archive, len(TEXT)) == TEXT
    refused("OutputLimitExceeded", api.decompress, archive, len(TEXT) - 1)
    refused("OutputLimitExceeded", api.check, archive, 10)
    buffer = bytearray(len(TEXT))
    assert api.decompress_into(archive, buffer) == len(TEXT) and buffer == TEXT
    refused("LengthMismatch", api.decompress_into, archive, bytearray(len(TEXT) + 1))
    assert (api.code_of("ok"), api.code_of("LengthMismatch"), api.code_of("BadMagic"), api.code_of("OutputLimitExceeded")) == (0, 2, 3, 4)
    assert (api.code_of(TypeError()), api.code_of(OSError()), api.code_of(MemoryError()), api.code_of(CodecError("Truncated"))) == (1, 5, 6, 3)
    assert len({api.error_string(c) for c in range(8)}) == 8
    assert api.decompressed_size(archive) == len(TEXT)
    refused("OutputLimitExceeded", api.decompressed_size, archive, len(TEXT) - 1)
    refused("OutputLimitExceeded", api.decompress_into, archive, buffer, 5)
    refused("InputTooLarge", frame.block_bytes, Block(0, 0, 1 << 32, 0, b""))


def test_sizes_are_checked():
    for bad in (Sizes(block=4095), Sizes(block=1 << 25), Sizes(chunk_least=0), Sizes(chunk_least=9, chunk_most=8), Sizes(chunk_most=1 << 25)):
        refused("InvalidBlockSize", api.compress, TEXT, bad)
    for bad in (Sizes(chunk_bits=0), Sizes(least_period=0)):
        with pytest.raises(ValueError):
            api.compress(TEXT, bad)


def test_references_decode_into_buffers_and_files(tmp_path):
    unit = random.Random(5).randbytes(9000)
    for data in (b"", unit * 5, unit + b"x" * 10 + unit + TEXT + unit, unit * 300):
        a, b, c = (str(tmp_path / n) for n in "abc")
        with open(a, "wb") as f:
            f.write(data)
        assert api.compress_file(a, b, SMALL)[0] == len(data)
        with open(b, "rb") as f:
            archive = f.read()
        assert archive == api.compress(data, SMALL)
        assert api.decompress_file(b, c) == (len(archive), len(data))
        with open(c, "rb") as f:
            assert f.read() == data
        buffer = bytearray(len(data))
        assert api.decompress_into(archive, buffer) == len(data) and buffer == data


def test_cuts_do_not_depend_on_stretches():
    data = np.frombuffer(random.Random(4).randbytes(50_000), np.uint8)
    whole = ranges.cut_candidates(data, 8)
    assert len(whole) > 100
    for stretch in (1, 63, 64, 1000, 49_999):
        assert ranges.cut_candidates(data[: 5000 if stretch == 1 else None], 8, stretch).tolist() == whole[whole <= (5000 if stretch == 1 else 50_000)].tolist()


def test_earlier_versions():
    archive = api.compress(TEXT)
    for version, level in ((4, 1), (5, 3), (6, 5), (7, 7)):
        old = frame.MAGIC[version] + bytes([level]) + archive[5:]
        assert api.decompress(old) == TEXT and api.info(old)["legacy_level"] == level and api.info(old)["version"] == version
    refused("InvalidLevel", api.decompress, frame.MAGIC[4] + b"\0" + archive[5:])


class Slow(io.RawIOBase):
    """Gives a few bytes at a time."""

    def __init__(self, data):
        self.inner = io.BytesIO(data)

    def read(self, n=-1):
        return self.inner.read(min(n, 7) if n > 0 else n)


def test_streams():
    data = TEXT * 3
    out = io.BytesIO()
    stats = api.compress_stream(Slow(data), out, 4096)
    assert stats == (len(data), len(out.getvalue()), -(-len(data) // 4096))
    back = io.BytesIO()
    assert api.decompress_stream(Slow(out.getvalue()), back, exact=True).output_bytes == len(data) and back.getvalue() == data
    two = out.getvalue() * 2
    source = io.BytesIO(two)
    api.decompress_stream(source, io.BytesIO())
    assert source.tell() == len(out.getvalue())  # stops behind the end mark
    assert [b - a for a, b in api.read_concatenated(two)] == [len(out.getvalue())] * 2
    refused("TrailingData", api.decompress_stream, io.BytesIO(two), io.BytesIO(), exact=True)
    part = io.BytesIO()
    refused("OutputLimitExceeded", api.decompress_stream, io.BytesIO(out.getvalue()), part, 5000)
    assert part.getvalue() == data[:4096]
    refused("InvalidBlockSize", api.compress_stream, io.BytesIO(b""), io.BytesIO(), 100)
    unit = random.Random(3).randbytes(10_000)
    refused("InvalidMatch", api.decompress_stream, io.BytesIO(api.compress(unit * 4, SMALL)), io.BytesIO())


def test_streams_at_hand_are_decoded_like_streams():
    rng = random.Random(14)
    whole = [api.compress_fixed([TEXT[:n]], 4096)[0] for n in (0, 1, 5000, 13_000)] + [api.compress(random.Random(3).randbytes(10_000) * 4, SMALL)]
    some = list(whole)
    for archive in whole * 30:
        bad = bytearray(archive[: rng.choice([len(archive), rng.randrange(len(archive) + 1)])] + rng.choice([b"", b"x"]))
        if bad and rng.random() < 0.7:
            bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        some.append(bytes(bad))
    for limit in (None, 6000):
        for archive, (data, status) in zip(some, api.decompress_streams(some, limit), strict=True):
            out, want = io.BytesIO(), "ok"
            try:
                api.decompress_stream(io.BytesIO(archive), out, limit, exact=True)
            except CodecError as e:
                want = e.status
            assert data == out.getvalue() and (status == want or {status, want} <= {"InvalidBlockSize", "OutputLimitExceeded", "UnsupportedMethod", "Truncated", "InvalidMatch"})


def test_files(tmp_path):
    a, b, c = (str(tmp_path / n) for n in "abc")
    with open(a, "wb") as f:
        f.write(TEXT)
    api.compress_file(a, b)
    api.decompress_file(b, c)
    with open(c, "rb") as f:
        assert f.read() == TEXT
    assert stat.S_IMODE(os.stat(b).st_mode) == 0o600
    os.link(a, str(tmp_path / "alias"))
    with pytest.raises(ValueError):
        api.compress_file(a, str(tmp_path / "alias"))
    with open(c, "rb") as f:
        before = f.read()
    with pytest.raises(CodecError):
        api.decompress_file(a, c)  # not an archive
    with open(c, "rb") as f:
        assert f.read() == before
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".blockweave")]
    assert cli.main(["compress", a, b]) == 0 and cli.main(["check", b]) == 0 and cli.main(["info", b]) == 0
    assert cli.main(["analyze", b]) == 0 and cli.main(["bench", a, "1"]) == 0 and cli.main(["decompress", a, c]) == 1


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.data())
def test_any_input_is_decoded_or_refused(noise, draw):
    archive = bytearray(api.compress(TEXT[:500]))
    for _ in range(draw.draw(st.integers(0, 4))):
        archive[draw.draw(st.integers(0, len(archive) - 1))] = draw.draw(st.integers(0, 255))
    for data in (noise, frame.MAGIC[8] + noise, bytes(archive), bytes(archive) + noise):
        for call in (api.decompress, api.check, api.info):
            try:
                call(data)
            except CodecError:
                pass
