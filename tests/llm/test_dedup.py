"""Exact and near de-duplication against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockweave.llm import components, exact_dedup, near_dedup

DOC = "doc_id long, text string, lang string"


def exact_truth(rows):
    import hashlib
    import re

    groups, out = {}, {}
    for i, text, *_ in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(key, []).append(i)
        out[i] = hashlib.sha256(key.encode()).hexdigest()
    return {(i, min(v), len(v), i == min(v), out[i]) for v in groups.values() for i in v}


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(1)
    pool = ["", None, " ", "a b", "a\tb", "a \n b", "A b", "é x", "é x", "x" * 50_000] + [f"t{i}" for i in range(40)]
    rows = [(i, rng.choice(pool), "en") for i in range(600)]
    for heavy, tracked in ((256, 2048), (2, 16)):  # with and without many digests on the ordinary path
        got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOC).repartition(5), heavy=heavy, tracked=tracked)
        assert {tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == exact_truth(rows)


def test_exact_dedup_takes_odd_tables(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a", "x"), (2, "a", "x"), (2, "a", "x"), (None, "b", "x"), (3, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, DOC).withColumns({"row": F.lit(1), "first": F.lit("f"), "digest": F.lit(0), "text_sha256": F.lit("no")})
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()), key=repr)
    assert sum(k for *_, k in got) == 3 and (None, 2, 3, False) in got and (None, None, 1, True) in got and (4, 3, 2, False) in got
    df = df.withColumns({"_DIGEST": F.lit(b"own"), "_Id": F.lit(7), "_place": F.lit(8), "_HOT": F.lit(9), "First_id": F.lit(10), "ID": F.lit(11)})
    for heavy in (256, 1):
        kept = exact_dedup.drop_exact_copies(df, heavy=heavy)
        assert kept.columns == df.columns
        got = kept.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == [(2, "a"), (3, None), (None, "b")]
        assert {(bytes(r["_DIGEST"]), r["_Id"], r["_place"], r["_HOT"], r["First_id"], r["ID"]) for r in got} == {(b"own", 7, 8, 9, 10, 11)}


def test_dropping_exact_copies_matches_the_groups(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([i, i, i, 5, None]), rng.choice(["", None, "a  b", "a b"] + [f"t{k}" for k in range(60)]), "en") for i in range(500)]
    df = spark.createDataFrame(rows, DOC).repartition(4).cache()
    for heavy, few in ((256, True), (2, True), (2, False)):
        monkeypatch.setattr(exact_dedup, "few_bytes", lambda df, few=few: few)
        want = sorted(((r["doc_id"], r["text_sha256"]) for r in exact_dedup.exact_groups(df, heavy=heavy).where("kept").collect()), key=repr)
        kept = exact_dedup.drop_exact_copies(df, heavy=heavy)
        got = kept.select("doc_id", exact_dedup.digest(F.col("text")).alias("d")).collect()
        assert sorted(((r["doc_id"], r["d"]) for r in got), key=repr) == want


def test_frequent_digests_are_found(spark):
    rows = [("hot",)] * 5000 + [(f"c{i}",) for i in range(3000)]
    found = exact_dedup.frequent_digests(spark.createDataFrame(rows, "d string").repartition(7), "d", heavy=8, tracked=64)
    assert "hot" in {r["d"] for r in found.collect()}


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def near_truth(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(rng, families, members, words=(3, 120)):
    rows = []
    for _ in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, members)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(400)}"
            text = rng.choice([" ", "  ", "\n", "\t"]).join(copy)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text, "en"))
    return rows


#: Small limits send everything through bands, blocks, pivots and joins.
TIGHT = {"BLOCK": 4, "SHINGLES": 300, "HOT": 6, "FREQUENT": 2, "HOT_KEYS": 40}


@pytest.mark.parametrize("limits", [{}, TIGHT, TIGHT | {"PIVOT_SHINGLES": 150, "ROUNDS": 1}])
def test_near_duplicates_match_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    if limits:
        monkeypatch.setattr(near_dedup, "few_bytes", lambda df: False)
    rng = random.Random(7)
    rows = corpus(rng, 40, 9)
    base = [f"v{i}" for i in range(80)]  # one large group of near copies, and texts that share a passage with it
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(400)}"
        rows.append((len(rows), " ".join(copy), "en"))
    for k in range(25):
        rows.append((len(rows), " ".join(base[: rng.randrange(45, 75)] + [f"y{rng.randrange(5000)}" for _ in range(rng.randrange(10, 40))]), "en"))
    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    odd = ["", None, " \t", "one", "ONE", "one two", "one two three four", "É a b c d", "é a b c d", "a b c d e f", a, b, f"{a} {b} {a} {a}", f"{b} {a} {b} {b}"]
    rows += [(len(rows) + i, t, "en") for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    by_pivots, met = near_dedup._by_pivots, []
    monkeypatch.setattr(near_dedup, "_by_pivots", lambda *args: met.append(by_pivots(*args)) or met[-1])
    got = near_dedup.near_duplicates(df)
    assert {tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()} == near_truth(rows)
    (_, crossing, links), = met
    if limits:  # pivots were at work, and left sets between
        assert sum(x.count() for x in links) > 10 and near_dedup._crossing(crossing).count() > 4
    else:
        assert not crossing and not links


def test_blocks_and_bands_miss_no_pair_and_hold_none_twice(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = random.Random(8)
    sizes = [rng.choice([1, 2, 3, 10, 12, 13, 14, 17, 40, 300]) for _ in range(120)]
    rows = [(i % 3, i, n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "key long, rep long, n_shingles long")
    groups: dict = {}
    for r in near_dedup.dealt(near_dedup.sized(df)).collect():
        groups.setdefault((r["key"], r["part"], r["low"], r["high"]), []).append((r["rep"], r["block"]))
    met: dict = {}
    for (_, _, low, high), own in groups.items():
        for x, (a, ba) in enumerate(own):
            for b, bb in own[x + 1 :]:
                if low == high or ba != bb:
                    met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 3 == j % 3 and 4 * min(sizes[i], sizes[j]) >= 3 * max(sizes[i], sizes[j])}
    assert want <= set(met) and set(met.values()) == {1}
    assert max(map(len, groups.values())) < 40


def test_every_pair_within_the_distance_shares_a_key():
    import numpy as np

    rng = np.random.default_rng(9)
    left = rng.integers(0, 1 << 16, (2000, near_dedup.SYMBOLS), dtype=np.uint16)
    right = left.copy()
    for row in right:  # the most symbols that may differ
        row[rng.permutation(near_dedup.SYMBOLS)[: near_dedup.DISTANCE]] ^= 1
    assert (near_dedup._keys(left) == near_dedup._keys(right)).any(axis=1).all()


def test_near_duplicates_take_odd_tables(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "x"), (5, text, "x"), (7, text + " end", "x"), (None, text, "x"), (9, "other words stand here alone", "x"), (9, text + " end", "x")]
    df = spark.createDataFrame(rows, DOC).withColumns({"rep": F.lit(1), "key": F.lit(2), "_gone": F.lit(5), "kept": F.lit(False), "_Text": F.lit("a"), "SIZE": F.lit(1)})
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, None, True), (9, 9, True), (9, 5, False)], key=repr)
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {5, None}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [-1, components.FEW])
def test_components_of_few_edges_take_no_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    order = list(range(200))
    random.Random(5).shuffle(order)
    links = [*zip(order, order[1:]), (1000, 1001), (1001, 1000), (7, 7), (2000, 2000)]
    settle, settled = components.settle, []
    monkeypatch.setattr(components, "settle", lambda *args: settled.append(args) or settle(*args))
    got = [tuple(r) for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()]
    assert sorted(got) == [*((i, 0) for i in range(200)), (1000, 1000), (1001, 1000)]
    assert len(settled) == 2 if few > 0 else len(settled) > 2
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("kept, linked", [(170, False), (185, True)])
def test_a_pair_that_shares_many_keys_is_compared_once(monkeypatch, kept, linked):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[:kept] + [f"x{i}" for i in range(200 - kept)])]
    parts = [near_dedup.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    signs = [near_dedup._signatures(first, bounds) for first, _, bounds in parts]
    digests = [near_dedup._digests(near_dedup._sets(*p))[0] for p in parts]
    keys = near_dedup._keys(np.concatenate(signs))
    shared = keys[0][keys[0] == keys[1]].tolist()
    assert len(shared) > 5
    group = {"key": pa.array(np.repeat(shared, 2)), **{c: pa.array([0] * 2 * len(shared), pa.int32()) for c in ("part", "low", "high", "block")}}
    rows = pa.table({**group, **{c: x * len(shared) for c, x in {"rep": [5, 9], "set_hash": digests, "signature": [s.tobytes() for s in signs], "text": texts}.items()}})
    compare, compared = near_dedup._shared, []
    monkeypatch.setattr(near_dedup, "_shared", lambda *sets: compared.append(sets) or compare(*sets))
    found = near_dedup._linked(rows, np.repeat(np.arange(2, 2 * len(shared) + 1, 2), 2))
    assert len(compared) == 1
    assert (found.to_pylist() == [{"u": 5, "v": 9}]) if linked else found is None


def test_large_groups_give_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([1, 2, 90, 3, 47, 48, 49, 1, 2, 2])
    ends = np.repeat(np.cumsum(sizes), sizes)
    symbols = rng.integers(0, 3, (len(ends), near_dedup.SYMBOLS)).astype("<u2")
    block, apart = rng.integers(0, 3, len(ends)), np.repeat(rng.random(len(sizes)) < 0.5, sizes)
    want = {
        (i, j)
        for i in range(len(ends)) for j in range(i + 1, ends[i])
        if (symbols[i] == symbols[j]).sum() >= near_dedup.SYMBOLS - near_dedup.DISTANCE and not (apart[i] and block[i] == block[j])
    }
    for large in (2, 48, 1000):
        monkeypatch.setattr(near_dedup, "LARGE", large)
        got = [p for i, j in near_dedup._gathered(near_dedup._pairs(symbols, block, apart, ends)) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(want) > 50 and set(got) == want
