"""Kernels for one block, against plain loops."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockweave.operators import block, huffman, matching, predict, tokens
from blockweave.operators.errors import CodecError


def samples():
    rng = np.random.default_rng(5)
    yield b""
    yield b"x"
    yield b"abcabcabcabc"
    yield bytes(20_000)
    yield bytes(range(256)) * 40
    yield b"".join(b'{"id":%d,"level":"INFO","value":%d}\n' % (i, i % 97) for i in range(2000))
    yield rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    yield rng.integers(0, 3, 9000, dtype=np.uint8).tobytes()
    for n in (63, 64, 65, 127, 128, 129, 130):
        yield b"abcdefghijklmnopq" * n + b"tail"
        yield bytes([7]) * n


@pytest.mark.parametrize("data", list(samples()), ids=lambda d: f"{len(d)}-{zlib.crc32(d):08x}")
def test_block_round_trip(data):
    for smallest in (False, True):
        b = block.encode(data, smallest)
        assert block.decode(b) == data
        assert len(b.payload) <= len(data)
    assert len(block.encode(data, True).payload) <= len(block.encode(data).payload)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 5))
def test_any_bytes_round_trip(data, copies):
    assert block.decode(block.encode(data * copies)) == data * copies


def test_predictors_invert_and_choose():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        x = rng.integers(0, 256, n, dtype=np.uint8)
        for p in (predict.NONE, predict.DELTA, predict.XOR):
            assert (predict.inverse(predict.forward(x, p), p) == x).all()
    assert predict.choose((np.arange(8192) % 256).astype(np.uint8)) == predict.DELTA
    assert predict.choose(np.zeros(63, np.uint8)) == predict.NONE


def test_score_is_a_direct_mapped_cache():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, 3000, dtype=np.uint8)
    for p in (0, 1, 2):
        y, seen, hits = predict.forward(x, p).tolist(), {}, 0
        for i in range(len(y) - 2):
            slot = (y[i] * 251 ^ y[i + 1] * 31 ^ y[i + 2]) & 4095
            hits += slot in seen and y[seen[slot] : seen[slot] + 3] == y[i : i + 3]
            seen[slot] = i
        assert predict.score(x, p) == hits


def test_best_match_is_the_longest_of_sixteen_nearest():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcd") for _ in range(3000))
    x = np.frombuffer(data, np.uint8)
    found = matching.Matches(matching.Group.of([x]))
    length, distance = found.length, found.distance
    def h(i):
        return (data[i] * 251 ^ data[i + 1] * 31 ^ data[i + 2]) & 65535

    for p in rng.sample(range(len(data) - 2), 200):
        near, best = [q for q in range(p - 1, -1, -1) if h(q) == h(p)][:16], (0, 0)
        for q in near:
            n = 0
            while p + n < len(data) and n < matching.MEASURED and data[q + n] == data[p + n]:
                n += 1
            if n > best[0] and n >= 4:
                best = (n, p - q)
        assert (length[p], distance[p]) == best


def test_long_matches_are_measured_in_full():
    unit = np.random.default_rng(4).integers(0, 256, 500, dtype=np.uint8).tobytes()
    def steps(data):
        return matching.parse(matching.Group.of([data])).of(0)

    assert steps(np.frombuffer(unit * 3, np.uint8))[-1][2:] == (1000, 500)
    assert max(s[2] for s in steps(np.zeros(200_000, np.uint8))) == 65_535


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=40), st.sampled_from([b"", b"a" * 300, b"abcd" * 50, bytes(200), b"abcdefgh"])), max_size=8))
def test_a_group_is_parsed_like_its_blocks_alone(blocks):
    assert block.encode_all(blocks) == [block.encode(x) for x in blocks]
    arrays = [np.frombuffer(x, np.uint8) for x in blocks] or [np.empty(0, np.uint8)]
    group = matching.Group.of(arrays)
    assert predict.choices(group).tolist() == [predict.choose(x) for x in arrays]
    whole = matching.parse(group)
    assert [whole.of(i, int(group.bounds[i])) for i in range(len(arrays))] == [matching.parse(matching.Group.of([x])).of(0) for x in arrays]


def outcome(call, *args):
    try:
        return call(*args)
    except CodecError as e:
        return e.status


def test_groups_are_decoded_like_their_blocks_alone():
    """Also with any of them damaged, whichever path then reads them."""
    rng = random.Random(10)
    text = [b" ".join(rng.choice([b"alpha", b"beta", bytes(rng.choices(b"etaoin shrdlu", k=9))]) for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    text += [b"", b"x", bytes(3000), rng.randbytes(700), b"ab" * 40_000, bytes(i % 256 for i in range(5000))]
    whole = [block.encode(x) for x in text if x]
    assert {b.method for b in whole} >= {block.STORED, block.SPLIT} and any(coded for b in whole if b.method == block.SPLIT for coded, _ in tokens._parts(b.payload, b.original))
    assert [x.data for x in block.expand_all(whole)] == [x for x in text if x]
    assert list(block.expand_all(whole)) == [block.expand(b) for b in whole]
    for _ in range(150):
        part = rng.sample(whole, 5)
        i = rng.randrange(5)
        payload = bytearray(part[i].payload)
        for _ in range(rng.randrange(1, 3)):
            payload[rng.randrange(min(len(payload), 700))] ^= 1 << rng.randrange(8)
        part[i] = part[i]._replace(payload=bytes(payload[: rng.choice([len(payload), len(payload) - 1])]))
        got = [x.status if isinstance(x, CodecError) else x for x in block.expand_all(part)]
        assert got == [outcome(block.expand, b) for b in part]


def test_many_streams_are_decoded_like_each_alone():
    rng = random.Random(11)
    plain = [bytes(rng.choices(range(rng.randrange(1, 256)), k=rng.randrange(1, 3000))) for _ in range(50)] + [b"z" * 5000, bytes(range(256)) * 30]
    coded = [huffman.encode(x) for x in plain]
    assert huffman.decode_all(coded, [len(x) for x in plain]) == plain
    for _ in range(200):
        bad = bytearray(rng.choice(coded))
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        found, alone = huffman.decode_all([coded[0], bytes(bad), coded[1]], [1 << 20] * 3), outcome(huffman.decode, bytes(bad), 1 << 20)
        assert found[0] == plain[0] and found[2] == plain[1] and (found[1] == alone if found[1] is not None else True)
        assert isinstance(alone, str) or max(bad[4:260]) > huffman.QUICK or found[1] == alone


def test_the_quick_reader_agrees_with_the_strict_one():
    rng = random.Random(6)
    data = bytes(rng.choice(b"abcab") for _ in range(3000)) + bytes(500)
    group = matching.Group.of([np.frombuffer(data, np.uint8)])
    streams = list(tokens.split(group, matching.parse(group))[0])
    want = tokens.restore(tokens.read_split(streams, len(data)), len(data))
    assert tokens._restored(streams, len(data)) == want == tokens.restore_split(streams, len(data)) and want.data == data
    for _ in range(400):  # whatever it accepts, the strict one gives as well
        bad = [bytearray(s) for s in streams]
        part = rng.choice([s for s in bad if s])
        part[rng.randrange(len(part))] ^= 1 << rng.randrange(8)
        bad = [bytes(s) for s in bad]
        found = tokens._restored(bad, len(data))
        if found is not None:
            assert found == tokens.restore(tokens.read_split(bad, len(data)), len(data))


def test_varints():
    for v in (0, 1, 127, 128, 16383, 16384, 2**32 - 1):
        assert tokens.get_varint(tokens.put_varint(v), 0) == (v, len(tokens.put_varint(v)))
    for bad, why in ((b"", "Truncated"), (b"\x80", "Truncated"), (b"\x80\x00", "InvalidMatch"), (b"\xff\xff\xff\xff\x1f", "InvalidMatch"), (b"\x80" * 5 + b"\x01", "InvalidMatch")):
        with pytest.raises(CodecError) as e:
            tokens.get_varint(bad, 0)
        assert e.value.status == why


def test_recent_distances_move_to_the_front():
    recent = tokens.Recent()
    assert [recent.use(d) for d in (5, 6, 5, 7, 8, 9, 6)] == [None, None, 1, None, None, None, None]
    assert recent.held == [6, 9, 8, 7]


@pytest.mark.parametrize("stream, original, why", [
    (b"\xc1", 4, "InvalidMatch"), (b"\x05ab", 6, "Truncated"), (b"\x00a\x80\x00\x00", 5, "InvalidMatch"), (b"\x00a\x80\x02\x00", 5, "InvalidMatch"),
    (b"\x00a\x80\x01\x00", 3, "InvalidMatch"), (b"\x00a", 2, "Truncated"), (b"\x00a\x80\x01", 5, "Truncated"), (b"\x00a\xc0\x03\x01\x00", 4, "InvalidMatch"),
])
def test_bad_commands_are_refused(stream, original, why):
    with pytest.raises(CodecError) as e:
        tokens.restore(tokens.read_commands(stream), original)
    assert e.value.status == why


def test_huffman_refuses_what_is_not_canonical():
    data = bytes(i % 251 if i % 11 == 0 else 0 for i in range(20_000))
    coded = huffman.encode(data)
    assert len(coded) < len(data) and huffman.decode(coded, len(data)) == data
    assert huffman.decode(huffman.encode(b"X" * 4096), 4096) == b"X" * 4096
    for bad, why in ((coded[:200], "InvalidEntropyData"), (coded + b"\0", "TrailingData"), (coded[:-1], "Truncated"), (coded[:-1] + bytes([coded[-1] ^ 1]), "InvalidEntropyData")):
        with pytest.raises(CodecError) as e:
            huffman.decode(bad, len(data))
        assert e.value.status in ({why, "Truncated"} if why == "InvalidEntropyData" else {why})
    with pytest.raises(CodecError) as e:
        huffman.decode(coded, len(data) - 1)
    assert e.value.status == "OutputLimitExceeded"
    over = bytearray(coded)
    over[4:260] = bytes([1]) * 256
    with pytest.raises(CodecError):
        huffman.decode(bytes(over), len(data))


def test_huffman_is_optimal():
    counts = np.zeros(256, np.int64)
    counts[:6] = (5, 9, 12, 13, 16, 45)
    assert huffman.bit_cost(counts, huffman.code_lengths(counts)) == 224
    steep = np.array([1 << min(i, 40) for i in range(40)] + [0] * 216)
    assert huffman.code_lengths(steep) is None
