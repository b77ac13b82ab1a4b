"""Sharding, search, chats, the registered queries and the pipeline."""

import glob
import json
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from blockweave.llm import chat, queries, sharding, topk
from blockweave.runtime import numbered, settle, table

from .test_dedup import exact_truth, near_truth

# -- sharding ----------------------------------------------------------------------------------


def shards_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append(r)
    return out


def test_shards_are_even_and_numbered_without_gaps(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = sharding.shard_documents(docs).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    shards = shards_of(rows)
    assert sorted(shards) == list(range(8))
    loads = [sum(r["size"] for r in v) for v in shards.values()]
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 8
    for v in shards.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))


def test_cuts_are_weighted_medians(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([3, 3, 3, rng.randrange(1000)]), rng.randrange(50), rng.randint(1, 20), rng.randrange(2**31)) for i in range(3000)]
    df = settle(spark.createDataFrame(rows, "id long, a long, b long, w long, tie long"), "kd")
    for leaves in (1, 2, 3, 7, 8):
        got = {r["id"]: r["shard"] for r in sharding.kd_shards(df, ["a", "b"], "w", leaves=leaves).collect()}
        loads = np.bincount([got[r[0]] for r in rows], [r[3] for r in rows], leaves)
        assert len(loads) == leaves and loads.max() - loads.min() <= 20 * np.ceil(np.log2(max(2, leaves))) + 20
    # the first cut goes along the first of equally wide dimensions, by value and then by the tie
    halves = {r["id"]: r["shard"] for r in sharding.kd_shards(df, ["a", "b"], "w", leaves=2).collect()}
    assert max((r[1], r[4]) for r in rows if halves[r[0]] == 0) < min((r[1], r[4]) for r in rows if halves[r[0]] == 1)
    many = [r["count"] for r in sharding.kd_shards(df, ["a", "b"], "w", leaves=700).groupBy("shard").count().collect()]
    assert len(many) > 650
    by_target = sharding.kd_shards(df, ["a", "b"], "w", target_bytes=5000).select("shard").distinct().count()
    assert by_target == -(-sum(r[3] for r in rows) // 5000)


def plain_tree(rows, leaves):
    """Shards of rows (id, dimensions, weight, tie) by a k-d tree in plain loops."""
    out, spread = {}, None

    def split(own, first, n):
        nonlocal spread
        if n == 1 or not own:
            out.update((r[0], first) for r in own)
            return
        widths = [max(r[1][d] for r in own) - min(r[1][d] for r in own) for d in range(len(own[0][1]))]
        spread = spread or widths
        best = max(range(len(widths)), key=lambda d: (widths[d] / spread[d] if spread[d] else 0, -d))
        own = sorted(own, key=lambda r: (r[1][best], r[3]))
        goal, before, left = sum(r[2] for r in own) * (n // 2) / n, 0, 0
        for r in own:  # ties of (value, tie) do not occur here
            if before + r[2] < goal or before < goal and before + r[2] - goal <= goal - before:
                left += 1
            before += r[2]
        split(own[:left], first, n // 2)
        split(own[left:], first + n // 2, n - n // 2)

    split(rows, 0, leaves)
    return out


@pytest.mark.parametrize("few", [256, 0, 5])
def test_shards_match_a_plain_tree(spark, monkeypatch, few):
    monkeypatch.setattr(sharding, "FEW", few)
    rng = random.Random(few)
    rows = [(i, (rng.choice([3, 3, rng.randrange(1000)]), rng.randrange(-50, 50), i), rng.randint(1, 20), rng.randrange(2**31)) for i in range(1500)]
    df = settle(spark.createDataFrame([(i, *x, w, t) for i, x, w, t in rows], "id long, a long, b long, c long, w long, tie long"), "kd")
    for leaves in (2, 7, 24):
        got = {r["id"]: r["shard"] for r in sharding.kd_shards(df, ["a", "b", "c"], "w", leaves=leaves).collect()}
        assert got == plain_tree(rows, leaves)


def test_numbers_and_times_keep_their_order(spark):
    """Also beyond 1e15, by fractions and by microseconds."""
    rows = [(i, "x" * 20, 1e300 * (i % 5) + i / 7e9, f"2020-01-01 00:00:00.{i % 900:06d}", str(i % 300 / 8)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x double, t string, d string").withColumns({"t": F.col("t").cast("timestamp"), "d": F.col("d").cast("decimal(10,3)")})
    for name in ("x", "t", "d"):
        value = {r["doc_id"]: r[name] for r in df.collect()}
        got = sharding.shard_documents(df, shards=2, dimensions=(name,)).collect()
        low, high = ([value[r["doc_id"]] for r in got if r["shard"] == n] for n in (0, 1))
        assert len(got) == 900 and max(low) <= min(high) and abs(len(low) - 450) < 4


def test_texts_with_one_beginning_are_parted(spark):
    rows = [(i, "x" * 50, f"https://host/{i % 8}" if i % 9 else None) for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = {i: s or "https://host/0" for i, _, s in rows}
    got = sharding.shard_documents(df, shards=2, dimensions=("source",)).collect()
    low, high = (sorted({sources[r["doc_id"]] for r in got if r["shard"] == n}) for n in (0, 1))
    assert len(got) == 1600 and low[-1] <= high[0]
    narrow = spark.createDataFrame([("source_2",), ("b",), (None,), ("source_1",), ("source_2",), ("",)], "axis string")
    assert sorted(r["axis"] for r in sharding.ranked(narrow, "axis").collect()) == [0, 0, 1, 2, 3, 3]


def test_sharding_takes_odd_tables(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, shard int, tie int"
    assert sharding.shard_documents(spark.createDataFrame([], shape)).count() == 0
    rows = [(1, "a", None, None, None, 0, 0), (1, "a", None, None, None, 0, 0), (None, None, "x", "y", 1, 0, 0), (2, "é" * 50_000, "x", "y", 1, 0, 0)]
    got = sharding.shard_documents(spark.createDataFrame(rows, shape)).collect()
    assert sorted(r["size"] for r in got) == [1, 2, 2, 100_001] and all(0 <= r["shard"] < 8 for r in got)
    for v in shards_of(got).values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    same = spark.createDataFrame([(i, "same text", "en", "s", 9, 0, 0) for i in range(800)], shape)
    loads = [r["count"] for r in sharding.shard_documents(same).groupBy("shard").count().collect()]
    assert len(loads) == 8 and max(loads) - min(loads) <= 3


# -- search --------------------------------------------------------------------------------------


@pytest.mark.parametrize("width, k, block", [(64, 20, 4096), (5, 3, 4096), (33, 7, 8)])
def test_search_is_exact_with_ties(spark, width, k, block):
    rng = np.random.default_rng(width)
    v = rng.normal(size=(400, width)).astype(np.float32)
    v[50:90] = v[3]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, []), (502, [float("nan")] * width), (503, [None] * width), (504, [float("inf")] * width), (None, [1.0] * width), (505, [1.0] * (width + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    own = topk.quantised(df, "vec_id", "embedding")
    got = {}
    for r in topk.top_k(own, own.where("vec_id % 20 = 0"), k, block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64)
    for q in range(0, 400, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:k]
        assert sorted(got.pop(q)) == [(n + 1, i, s[i]) for n, i in enumerate(order)]
    assert not got
    assert topk.top_k(own.limit(0), own.limit(0), k).count() == 0


def test_blocks_of_dimensions_prune_without_loss():
    rng = np.random.default_rng(8)
    x = (np.floor(64 * rng.normal(size=(64, 3000)) * np.linspace(2, 0.1, 64)[:, None])).astype(np.int64)
    best = topk.TopK(np.arange(10), x[:, :10], 5)
    for at in range(0, 3000, 500):
        best.feed(np.arange(at, at + 500), np.ascontiguousarray(x[:, at : at + 500]))
    rows = best.rows(np.arange(10))
    for q in range(10):
        s = x[:, q] @ x
        want = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        assert [n for i, n in zip(rows.column("query_id").to_pylist(), rows.column("vec_id").to_pylist()) if i == q] == want


@pytest.mark.parametrize("bits", [20, 25, 29, 30, 31])
def test_scores_are_exact_beyond_floating_point(bits):
    """Sums below 2**53, below 2**62 and beyond are held to whole numbers of any size."""
    rng = random.Random(bits)
    x = [[(1 << bits) + rng.randrange(4) for _ in range(3)] + [rng.choice([-1, 1]) * rng.randrange(1 << bits) // 2 for _ in range(20)] for _ in range(300)]
    columns = np.ascontiguousarray(np.array(x, np.int64).T)
    best = topk.TopK(np.arange(8), np.ascontiguousarray(columns[:, :8]), 5, step=4)
    for at in range(0, 300, 100):
        best.feed(np.arange(at, at + 100), np.ascontiguousarray(columns[:, at : at + 100]))
    for q in range(8):
        exact = [sum(a * b for a, b in zip(x[q], y)) for y in x]
        want = sorted((-s, i) for i, s in enumerate(exact) if i != q)[:5]
        assert list(zip([-s for s in best.scores[q]], best.names[q])) == want


def test_search_takes_odd_tables(spark):
    shape = "vec_id long, v array<long>, V2 string, query_id int, ROW int"
    big = [640000001, 640000001]
    rows = [(1, big, "x", 0, 0), (2, [640000003, 640000002], "x", 0, 0), (2, [640000003, 640000002], "x", 0, 0), (1, big, "y", 1, 1), (3, [1, 2, 3], "x", 0, 0), (1, [5, -5], "x", 0, 0)]
    df = spark.createDataFrame(rows, shape)
    got = topk.top_k(df, df.where("vec_id = 1"), 3)
    # a repeated query counts once; another vector of the same id has a list of its own
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == [(1, 1, 2, 5), (1, 1, 2, 819200004480000005), (1, 2, 2, 5), (1, 2, 2, 819200004480000005)]
    with pytest.raises(Exception, match="too large"):
        topk.quantised(spark.createDataFrame([(1, [1e300])], "vec_id long, e array<double>"), "vec_id", "e").collect()
    huge = spark.createDataFrame([(1, [1 << 61] * 3), (2, [1 << 61] * 3)], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(huge, huge, 1).collect()


# -- chats -----------------------------------------------------------------------------------------

TOOLS = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"], "additionalProperties": False}}
TURN = "conv_id long, turn long, role string, text string"


def calls(*found, content=None):
    return json.dumps({"tool_calls": list(found)} | ({"content": content} if content else {}))


def result(name, content):
    return json.dumps({"tool_call_id": name, "content": content})


def call(name, x=1, tool="f", **more):
    return {"id": name, "name": tool, "arguments": {"x": x}} | more


def linked(spark, rows):
    out = chat.linked(spark.createDataFrame(rows, TURN).repartition(3), TOOLS)
    return out.orderBy("conv_id", "order_turn", "depth", "turn", "row", "part").collect()


def test_calls_are_linked_ordered_and_validated(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", calls(call("b", depends_on=["a"]), call("a", "no"), content="ok")), (1, 2, "tool", result("a", "A")), (1, 3, "tool", result("b", "B")),
        (1, 4, "tool", result("zz", "Z")), (1, 5, "assistant", calls(call("c", tool="g"))), (2, 0, "assistant", calls(call("p", depends_on=["q"]), call("q", depends_on=["p"]))),
        (2, 1, "tool", result("p", "P")), (2, 1, "tool", result("q", "Q")), (None, None, None, None), (3, 0, "user", "{broken"), (3, 1, "user", ""), (3, 1, "user", ""),
    ]
    got = linked(spark, rows)
    one = [(r["kind"], r["call_id"], r["status"]) for r in got if r["conv_id"] == 1]
    assert one == [
        ("plain", None, "ok"), ("plain", None, "ok"), ("call", "a", "invalid $.x: not of type integer"), ("result", "a", "ok"), ("call", "b", "ok"), ("result", "b", "ok"),
        ("result", "zz", "orphan"), ("call", "c", "unanswered"),
    ]
    assert {r["status"] for r in got if r["conv_id"] == 2} == {"cyclic"}
    assert [r["json"] for r in got if r["conv_id"] == 3] == ['{"content":"{broken","role":"user"}', '{"content":"","role":"user"}', '{"content":"","role":"user"}']
    assert [r["json"] for r in got if r["conv_id"] is None] == ['{"content":null,"role":"unknown"}']
    assert '{"role":"assistant","tool_call":{"arguments":{"x":1},"depends_on":["a"],"id":"b","name":"f"}}' in [r["json"] for r in got]
    assert chat.linked(spark.createDataFrame([], TURN), TOOLS).count() == 0


def test_envelopes_behind_white_space_are_read(spark):
    rows = [(1, 0, "assistant", " \r\n\t" + calls(call("a"))), (1, 1, "tool", "\n" + result("a", "A")), (1, 2, "user", "\n {plain")]
    got = [(r["kind"], r["call_id"], r["status"]) for r in linked(spark, rows)]
    assert got == [("call", "a", "ok"), ("result", "a", "ok"), ("plain", None, "ok")]


def test_links_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        names = [f"c{i}" for i in range(6)]
        for turn in range(14):
            name = rng.choice(names)  # identifiers recur
            rows.append((conv, turn, "assistant", calls(call(name))) if rng.random() < 0.5 else (conv, turn, "tool", result(name, str(turn))))
    waiting, want = {}, {}
    for conv, turn, role, text in rows:
        kind = "call" if role == "assistant" else "result"
        name = json.loads(text)["tool_calls"][0]["id"] if kind == "call" else json.loads(text)["tool_call_id"]
        waiting.setdefault((conv, name, kind), []).append(turn)
    for (conv, name, kind), turns in waiting.items():
        other = len(waiting.get((conv, name, "result" if kind == "call" else "call"), []))
        for n, turn in enumerate(turns):
            want[conv, turn] = "ok" if n < other else ("unanswered" if kind == "call" else "orphan")
    assert {(r["conv_id"], r["turn"]): r["status"] for r in linked(spark, rows)} == want


def test_nothing_in_an_envelope_is_lost(spark):
    rows = [
        (1, 0, "assistant", '{"reasoning": "why", "tool_calls": [{"id": "a", "name": "f", "arguments": "{\\"x\\": 1}", "type": "function"}, {"id": 7, "name": "f", "arguments": {"x": 2.0}}], "role": "bot"}'),
        (1, 1, "tool", '{"tool_call_id": "a", "content": {"b": [1, 2.5], "a": null}, "is_error": true}'),
        (1, 2, "tool", '{"tool_call_id": 7, "content": "seven"}'),
        (1, 3, "assistant", '{"tool_calls": [{"id": "q", "name": "f", "arguments": {"x": 1, "x": 2}}]}'),
        (1, 4, "assistant", '{"tool_calls": [{"id": "r", "name": "f", "arguments": "{\\"x\\": 1, \\"x\\": 2}"}, {"id": null, "name": "f"}]}'),
        (1, 5, "assistant", '{"tool_calls": "none"}'), (1, 6, "tool", '{"tool_call_id": "\\ud800", "content": "\\ud83d"}'), (1, 7, "tool", '{"tool_call_id": "n", "content": NaN}'),
        (1, 8, "user", "[" * 100_000), (1, 9, "assistant", '{"a":' * 100_000), (1, 10, "user", "x" * 300_000),
    ]
    got = linked(spark, rows)
    of = {}
    for r in got:
        of.setdefault(r["turn"], []).append((r["kind"], r["status"], r["json"]))
    assert of[0] == [
        ("plain", "ok", '{"content":null,"extra":{"reasoning":"why","role":"bot"},"role":"assistant"}'),
        ("call", "ok", '{"role":"assistant","tool_call":{"arguments":{"x":1},"extra":{"type":"function"},"id":"a","name":"f"}}'),
        ("call", "ok", '{"role":"assistant","tool_call":{"arguments":{"x":2},"id":"7","name":"f"}}'),
    ]
    assert of[1] == [("result", "ok", '{"content":{"a":null,"b":[1,2.5]},"extra":{"is_error":true},"role":"tool","tool_call_id":"a"}')]
    assert of[2] == [("result", "ok", '{"content":"seven","role":"tool","tool_call_id":"7"}')]
    assert [x[:2] for x in of[3]] == [("plain", "invalid $: repeated key x")] and json.loads(of[3][0][2])["content"] == rows[3][3]
    assert [x[:2] for x in of[4]] == [("call", "invalid $: repeated key x"), ("call", "invalid $.x: missing")]
    assert [x[:2] for x in of[5]] == [("plain", "ok")] and of[6] == [("result", "orphan", '{"content":"\\ud83d","role":"tool","tool_call_id":"\\\\ud800"}')]
    assert [x[0] for x in of[7] + of[8] + of[9] + of[10]] == ["plain"] * 4


def order_truth(edges):
    """Places by relaxing every edge until nothing moves; what would move on for ever is cyclic, and so is what is behind it."""
    nodes = {x for e in edges for x in e}
    place = {x: (x[2], 0) for x in nodes}
    for step in range(2 * len(nodes) + 2):
        moved = set()
        for a, b in edges:
            if (place[a][0], place[a][1] + 1) > place[b]:
                place[b] = (place[a][0], place[a][1] + 1)
                moved.add(b)
    bad = set(moved)
    while more := {b for a, b in edges if a in bad} - bad:
        bad |= more
    return {x: None if x in bad else place[x] for x in nodes}


def test_order_matches_brute_force_in_one_task_and_by_rounds(spark):
    rng = random.Random(12)
    for _ in range(30):
        nodes = [(i, 0, rng.randrange(6)) for i in range(rng.randrange(2, 14))]
        edges = [tuple(rng.sample(nodes, 2)) for _ in range(rng.randrange(1, 12))]
        want = order_truth(edges)
        got = {(row, part): None if cyclic else (place["turn"], place["depth"]) for row, part, place, cyclic in chat.order(edges)}
        assert got == {x[:2]: p for x, p in want.items()}
    shape = "conv_id long, before struct<row: long, part: int, turn: long>, after struct<row: long, part: int, turn: long>"
    df = spark.createDataFrame([(1, a, b) for a, b in edges] + [(None, (90, 0, None), (91, 0, 3))], shape)
    whole = {(r["row"], r["part"], r["place"], r["cyclic"]) for r in chat._grouped(df).collect()}
    rounds = {(r["row"], r["part"], r["place"], r["cyclic"]) for r in chat._by_rounds(df).collect()}
    assert {(a, b, d) for a, b, _, d in whole} == {(a, b, d) for a, b, _, d in rounds}
    assert {x for x in whole if not x[3]} == {x for x in rounds if not x[3]}


def test_a_chain_of_a_thousand_calls_takes_few_jobs(spark):
    rows = []
    for i in range(1000):  # every call waits for the result of the one before, and all calls come first
        rows.append((1, 0, "assistant", calls(call(f"c{i}", depends_on=[f"c{i - 1}"] if i else []))))
        rows.append((1, 1, "tool", result(f"c{i}", str(i))))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    random.Random(1).shuffle(rows)
    got = linked(spark, rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 60
    assert [(r["kind"], r["call_id"]) for r in got] == [x for i in range(1000) for x in (("call", f"c{i}"), ("result", f"c{i}"))]
    assert {r["status"] for r in got} == {"ok"}


def test_chats_take_odd_tables(spark):
    rows = [(1, 1, "assistant", calls(call("a")))] * 3 + [(None, None, "tool", result("a", "x")), (None, None, "assistant", calls(call("a"))), (1, None, None, None)]
    df = spark.createDataFrame(rows, TURN).withColumns({"Row": F.lit(1), "PLACE": F.lit(2), "kind": F.lit("k"), "call_ID": F.lit("i"), "nth": F.lit(0), "_part": F.lit(0)})
    got = sorted((r["conv_id"] or 0, r["kind"], r["status"]) for r in chat.linked(df, TOOLS).collect())
    assert got == [(0, "call", "ok"), (0, "result", "ok"), (1, "call", "unanswered")] + [(1, "call", "unanswered")] * 2 + [(1, "plain", "ok")]


def test_places_are_numbered_across_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["a", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, l string, i long").repartition(5)
    got = {r["i"]: r["nth"] for r in numbered(df, ["k", "l"], ["i"]).collect()}
    count = {}
    for k, l, i in rows:
        count[k, l] = count.get((k, l), 0) + 1
        assert got[i] == count[k, l]


def test_schemas_and_canonical_json():
    schema = {"type": "object", "properties": {"n": {"type": "number", "minimum": 0, "maximum": 5}, "s": {"type": ["string", "null"], "maxLength": 3, "pattern": "^a"}, "l": {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}, "u": {"anyOf": [{"const": 1}, {"type": "boolean"}]}}}
    assert chat.invalid({"n": 5, "s": "ab", "l": [1, 2], "u": True}, schema) is None
    for bad in ({"n": 6}, {"n": True}, {"s": "abcd"}, {"s": "b"}, {"l": [3]}, {"l": [1, 1, 1]}, {"u": 2}, []):
        assert chat.invalid(bad, schema)
    assert chat.canonical({"b": 1.0, "a": [1, {"z": None, "y": "é"}], "c": 1.5}) == '{"a":[1,{"y":"é","z":null}],"b":1,"c":1.5}'
    with pytest.raises(ValueError):
        chat.canonical(float("nan"))


# -- registered queries and the pipeline ----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_twin(spark, small_dir, name):
    c = duckdb.connect()
    for p in glob.glob(f"{small_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    twin = c.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == sorted(map(repr, twin))


def test_all_ten_are_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_against_brute_force(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    scored = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op8_toxicity"](spark, small_dir).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if not scored[r["doc_id"]]]
    keep = {i for i, _, _, kept, _ in exact_truth(rows) if kept}
    rows = [r for r in rows if r[0] in keep]
    keep = {i for i, _, _, kept in near_truth(rows) if kept}
    out = corpus_pipeline.run(spark, small_dir).collect()
    assert {r["doc_id"] for r in out} == keep
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = settle(stage(spark, kept, small_dir), "stage")
        assert kept.columns == docs.columns and kept.schema == docs.schema


def test_pipeline_takes_odd_tables(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "x", "y", 0), (2, "", "x", "y", 0), (None, "z", "x", "y", 1), (3, "a b " * 20_000, "x", "y", 1)], docs.schema)
    for start, least in ((odd, 3), (docs.limit(0), 0)):
        rows = start.withColumns({"kept": F.lit(1), "digest": F.lit(2), "row": F.lit(3)})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = rows.columns
            rows = settle(stage(spark, rows, small_dir), "stage")
            assert rows.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, small_dir).select("doc_id").distinct().count() == least
