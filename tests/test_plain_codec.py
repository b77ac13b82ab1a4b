"""Blocks against an encoder in plain loops: forms, streams and counters, byte for byte."""

import heapq
import random

import numpy as np
import pytest

from blockweave import api, queries
from blockweave.operators import block, huffman, predict, tokens
from blockweave.runtime import table


def plain_score(x):
    latest, hits = {}, 0
    for i in range(len(x) - 2):
        slot, three = (x[i] * 251 ^ x[i + 1] * 31 ^ x[i + 2]) % 4096, x[i : i + 3]
        hits += latest.get(slot) == three
        latest[slot] = three
    return hits


def plain_forward(x, predictor):
    return bytes((b - a) % 256 if predictor == predict.DELTA else b ^ a if predictor == predict.XOR else b for a, b in zip(b"\0" + x, x))


def plain_choice(x):
    x = x[:8192]
    if len(x) < 64:
        return predict.NONE
    plain, delta, xor = (plain_score(plain_forward(x, p)) for p in (predict.NONE, predict.DELTA, predict.XOR))
    if delta > plain + len(x) // 64 and delta >= xor:
        return predict.DELTA
    return predict.XOR if xor > plain + len(x) // 64 else predict.NONE


def plain_parse(x):
    """(literals, length, distance) of each step: the longest match with one of the 16 nearest places of the same hash."""
    places, steps, at, literals = {}, [], 0, b""

    def note(i):
        if i + 3 <= len(x):
            places.setdefault((x[i] * 251 ^ x[i + 1] * 31 ^ x[i + 2]) & 65535, []).append(i)

    while at < len(x):
        best = (0, 0)
        if at + 4 <= len(x):
            for there in places.get((x[at] * 251 ^ x[at + 1] * 31 ^ x[at + 2]) & 65535, [])[:-17:-1]:
                size = 0
                while at + size < len(x) and size < 65_535 and x[at + size] == x[there + size]:
                    size += 1
                if at - there <= 65_535 and size >= 4 and size > best[0]:
                    best = (size, at - there)
        step = best[0] or 1
        for i in range(at, at + step):
            note(i)
        if best[0]:
            steps.append((literals, *best))
            literals = b""
        else:
            literals += x[at : at + 1]
        at += step
    return steps + ([(literals, 0, 0)] if literals else [])


def plain_code(data):
    """A prefix code's header and bits, by a heap of (count, order of arising, bytes)."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate((s, data.count(s)) for s in range(256) if s in data)]
    if not heap:
        return None
    depth, serial = [0] * 256, len(heap)
    if serial == 1:
        depth[heap[0][2][0]] = 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
        serial += 1
    code, last, codes = 0, 0, {}
    for size, s in sorted((d, s) for s, d in enumerate(depth) if d):
        code <<= size - last
        codes[s], last = format(code, f"0{size}b"), size
        code += 1
    bits = "".join(codes[s] for s in data)
    bits += "0" * (-len(bits) % 8)
    return len(data).to_bytes(4, "little") + bytes(depth) + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def plain_block(data):
    """(method, predictor, payload, streams, counters)."""
    predictor = plain_choice(data)
    changed = plain_forward(data, predictor)
    steps, held = plain_parse(changed), []
    tags, literals, lengths, codes, whole = bytearray(), bytearray(), bytearray(), bytearray(), bytearray()
    runs = 0
    for run, length, distance in steps:
        for i in range(0, len(run), 128):
            part = run[i : i + 128]
            tags.append(len(part) - 1)
            literals += part
            whole += bytes([len(part) - 1]) + part
            runs += 1
        if length:
            tag = 0x80 + length - 4 if length <= 67 else 0xC0
            tags.append(tag)
            more = tokens.put_varint(length) if tag == 0xC0 else b""
            lengths += more
            codes += bytes([held.index(distance)]) if distance in held else tokens.put_varint(distance + 4)
            held = [distance, *[h for h in held if h != distance]][:4]
            whole += bytes([tag]) + more + distance.to_bytes(2, "little")
    streams = (bytes(tags), bytes(literals), bytes(lengths), bytes(codes))
    split = b"SPL1"
    for s in streams:
        coded = plain_code(s)
        small = coded is not None and len(coded) < len(s)
        split += bytes([small]) + len(coded if small else s).to_bytes(4, "little") + (coded if small else s)
    counters = (runs, sum(n > 0 for _, n, _ in steps), len(literals), sum(n for _, n, _ in steps), sum(d for *_, d in steps))
    if len(split) < len(whole):
        method, payload = block.SPLIT, split
    else:
        coded = plain_code(bytes(whole))
        method, payload = (block.CODED_COMMANDS, coded) if coded is not None and len(coded) < len(whole) else (block.COMMANDS, bytes(whole))
    if len(payload) >= len(data):
        return block.STORED, predict.NONE, data, None, (0, 0, len(data), 0, 0)
    return method, predictor, payload, streams, counters


def inputs():
    rng = random.Random(31)
    for n in (1, 3, 4, 5, 70, 300, 2000):
        yield bytes(rng.choices(b"abcd", k=n))
        yield rng.randbytes(n)
        yield bytes([n % 256]) * n
    yield bytes(i * 3 % 256 for i in range(3000))
    unit = rng.randbytes(20)
    steps = b"".join(unit + rng.randbytes(1) for _ in range(120))  # what repeats is only what changes from byte to byte
    yield bytes(np.bitwise_xor.accumulate(np.frombuffer(steps, np.uint8)))
    yield bytes(np.cumsum(np.frombuffer(steps, np.uint8), dtype=np.uint8))
    yield b"".join(b"%d;%s\n" % (rng.randrange(100), rng.choice([b"alpha", b"beta", b"a" * 200])) for _ in range(150))
    yield bytes(rng.choices(b"etaoinshrdlu ", k=6000))


def same(data, got):
    method, predictor, payload, streams, counters = plain_block(data)
    assert (got.method, got.predictor, got.payload) == (method, predictor, payload)
    assert block.expand(got)[1:] == counters
    if method == block.SPLIT:
        assert tuple(tokens.unpack_split(got.payload, got.original)) == streams


@pytest.mark.parametrize("data", list(inputs()), ids=len)
def test_block(data):
    same(data, block.encode(data))


def test_all_forms_are_reached():
    assert {block.encode(x).method for x in inputs()} >= {block.STORED, block.COMMANDS, block.SPLIT}
    assert {plain_choice(x) for x in inputs()} == {predict.NONE, predict.DELTA, predict.XOR}


def test_codes_match_a_heap():
    rng = random.Random(32)
    for _ in range(200):
        data = bytes(rng.choices(rng.sample(range(256), rng.randint(1, 256)), k=rng.randint(1, 2000)))
        assert huffman.encode(data) == plain_code(data)


def test_queries_match(spark, small_dir):
    """Forms, streams and counters of the registered queries, over whole texts of the smallest table that fit one block."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, small_dir, "documents").collect()}
    some = {i: plain_block(x) for i, x in sorted(texts.items()) if 0 < len(x) <= queries.SMALL}
    assert len(some) > 100
    analysis = {r["blob_id"]: r for r in queries.q27_analyze(spark, small_dir).collect()}
    streams = {(r["doc_id"], r["block_index"]): (r["tags"], r["literals"], r["lengths"], r["distances"]) for r in queries.q22_split_streams(spark, small_dir).collect()}
    for i, (method, predictor, payload, parts, counters) in some.items():
        r = analysis[i]
        assert (r["literal_commands"], r["match_commands"], r["literal_bytes"], r["matched_bytes"], r["distance_total"]) == counters
        assert r["payload_size"] == len(payload) and r[f"{block.METHOD_NAMES[method]}_blocks"] == 1 and r[f"{block.PREDICTOR_NAMES[predictor]}_predictor"] == 1
        assert (i, 0) not in streams if parts is None or method != block.SPLIT else streams[i, 0] == tuple(map(len, parts))
    forms = {r["method"]: r.asDict() for r in queries.q23_representation(spark, small_dir).collect()}
    assert sum(f["original"] for f in forms.values()) == sum(map(len, texts.values()))
    whole = {}
    for x in api.compress_all(list(texts.values()), queries.SMALL_SIZES):
        for b in api.frame.parse(x)[1]:
            kind = whole.setdefault(block.METHOD_NAMES[b.method], [0, 0, 0])
            whole[block.METHOD_NAMES[b.method]] = [kind[0] + 1, kind[1] + b.original, kind[2] + len(b.payload)]
    assert {k: [f["blocks"], f["original"], f["packed"]] for k, f in forms.items()} == whole
