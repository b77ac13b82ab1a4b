"""The codec and byte-level SQL over DataFrames."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from blockweave import api
from blockweave.functions import bytes as byte_sql
from blockweave.operators import codec, huffman
from blockweave.operators.block import REFERENCE
from blockweave.plans import ranges
from blockweave.plans.ranges import Sizes
from blockweave.sources import blobs as sources
from blockweave.streaming import stream

SMALL = Sizes(block=4096, least_planned=8192, chunk_least=1024, chunk_most=16384, chunk_bits=11, least_period=1024)


@pytest.fixture(scope="module")
def items():
    unit = random.Random(1).randbytes(9000)
    return [b"", b"a", b"hello " * 2000, unit, unit * 3, unit + b"x" * 10 + unit, bytes(range(256)) * 64]


@pytest.fixture(scope="module")
def archives(spark, items):
    return codec.compress(sources.from_memory(spark, items), SMALL, deal=0).cache()


def test_same_archives_however_blocks_are_dealt(spark, items, archives):
    want = {i: api.compress(x, SMALL) for i, x in enumerate(items)}
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        for deal in (0, 10_000, codec.DEAL):
            got = codec.compress(sources.from_memory(spark, items).repartition(parts), SMALL, deal=deal)
            assert {r["blob_id"]: bytes(r["archive"]) for r in got.collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    small = codec.compress_small(sources.from_memory(spark, items), SMALL)
    assert {r["blob_id"]: bytes(r["archive"]) for r in small.collect()} == want


def test_both_decoders_agree(items, archives):
    for back in (codec.decompress(archives), codec.decompress_parallel(archives, deal=0), codec.decompress_parallel(archives, deal=3000)):
        rows = back.collect()
        assert {r["blob_id"]: bytes(r["data"]) for r in rows} == dict(enumerate(items))
        assert {r["status"] for r in rows} == {"ok"}


def test_damaged_archives_are_refused_however_they_are_dealt(spark, archives):
    bad = archives.withColumn("archive", F.expr("CASE WHEN blob_id % 2 = 0 THEN overlay(archive PLACING X'00112233' FROM 23 FOR 4) ELSE archive END"))
    whole = {r["blob_id"]: (r["status"], r["data"]) for r in codec.decompress(bad).collect()}
    assert {s for s, _ in whole.values()} > {"ok"}
    for deal in (0, 1 << 30):
        assert {r["blob_id"]: (r["status"], r["data"]) for r in codec.decompress_parallel(bad, deal=deal).collect()} == whole


def test_analysis_adds_up(items, archives):
    for r in codec.derived(codec.analyze(archives)).collect():
        assert r["literal_bytes"] + r["matched_bytes"] + r["referenced_bytes"] == r["original_size"] == len(items[r["blob_id"]])
        assert r["stored_blocks"] + r["commands_blocks"] + r["coded_commands_blocks"] + r["split_blocks"] + r["reference_blocks"] == r["blocks"]
    info = {r["blob_id"]: r for r in codec.frame_info(archives).collect()}
    assert info[0]["blocks"] == 0 and info[0]["frame_size"] == 26 and info[4]["original_size"] == 27_000


def test_refusals_are_rows(spark, archives):
    bad = archives.withColumn("archive", F.expr("substring(archive, 1, length(archive) - 1)"))
    assert {r["status"] for r in codec.check(bad).collect()} == {"Truncated"}
    assert {r["status"] for r in codec.decompress(archives, limit=1).where("blob_id > 1").collect()} == {"OutputLimitExceeded"}
    assert {r["status"] for r in codec.frame_info(bad).collect()} == {"Truncated"}
    with pytest.raises(Exception, match="Truncated"):
        codec.decompress(bad, strict=True).collect()


def test_chained_references_resolve(spark):
    rows = [(1, 0, 1, None), (1, 1, REFERENCE, 0), (1, 2, REFERENCE, 1), (1, 3, REFERENCE, 2)]
    blocks = spark.createDataFrame(rows, "blob_id long, block_index int, method int, ref_target int")
    assert {r["ref_target"] for r in codec.resolved(blocks).collect()} == {0}


def test_sql_predictors_and_scores_match_the_kernels(spark):
    import numpy as np

    from blockweave.operators import predict

    data = bytes(random.Random(5).choices(b"abcab", k=2500))
    rows = byte_sql.byte_rows(sources.from_memory(spark, [data]), ["blob_id"], "data")
    found = byte_sql.with_inverses(byte_sql.with_predictions(rows, ["blob_id"]), ["blob_id"]).orderBy("pos").collect()
    x = np.frombuffer(data, np.uint8)
    assert [r["delta"] for r in found] == predict.forward(x, 1).tolist() and [r["xored"] for r in found] == predict.forward(x, 2).tolist()
    assert all(r["from_delta"] == r["b"] == r["from_xored"] for r in found)
    assert byte_sql.scores(rows, ["blob_id"], "b", "s").first()["s"] == predict.score(x, 0)


def test_sql_codes_match_the_kernel(spark):
    import numpy as np

    counts = np.bincount(np.frombuffer(b"abracadabra", np.uint8), minlength=256)
    depth = huffman.code_lengths(counts)
    lengths = spark.createDataFrame([(1, int(s), int(depth[s])) for s in np.flatnonzero(depth)], "k int, symbol int, length int")
    order, aligned = huffman.canonical(depth)
    want = {int(s): int(c) >> (24 - int(depth[s])) for s, c in zip(order, aligned)}
    assert {r["symbol"]: r["code"] for r in byte_sql.canonical_codes(lengths, ["k"]).collect()} == want


def test_sql_plans_match_the_kernels(spark, items):
    blobs = sources.from_memory(spark, items)
    got = ranges.fixed_ranges(blobs, 4096).groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("r"))
    assert {r["blob_id"]: [(x["start"], x["end"]) for x in r["r"]] for r in got.collect()} == {i: [(r.start, r.end) for r in ranges.cut(len(x), 4096)] for i, x in enumerate(items) if x}
    assert {r["blob_id"]: r["period"] for r in ranges.periods(blobs, least_period=1000).collect()} == {i: ranges.period_of(x, 1000) for i, x in enumerate(items)}
    cut = ranges.slices(ranges.fixed_ranges(blobs, 3000))
    refs = {(r["blob_id"], r["block_index"]): r["target"] for r in ranges.references(cut, ["blob_id"], ["block_index"]).collect()}
    for i, x in enumerate(items):
        for j, r in enumerate(ranges.with_references(x, ranges.cut(len(x), 3000))):
            assert refs[i, j] == r.target
    assert {(r["blob_id"], r["block_index"]): r["crc"] for r in cut.withColumn("crc", F.crc32("block")).collect()} == {
        (i, j): zlib.crc32(x[3000 * j : 3000 * j + 3000]) for i, x in enumerate(items) for j in range(-(-len(x) // 3000))
    }


def test_structured_streaming(spark, items, tmp_path):
    sources.from_memory(spark, items).select("blob_id", "data").repartition(3).write.parquet(str(tmp_path / "in"))
    encoded = stream.encode_stream(stream.blob_source(spark, str(tmp_path / "in"), "blob_id long, data binary", 1), 4096)
    stream.run_to_end(encoded, str(tmp_path / "a"), str(tmp_path / "log1"))
    decoded = stream.decode_stream(stream.blob_source(spark, str(tmp_path / "a"), "blob_id long, archive binary"))
    stream.run_to_end(decoded, str(tmp_path / "out"), str(tmp_path / "log2"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["blob_id"]: bytes(r["data"]) for r in rows} == dict(enumerate(items)) and {r["status"] for r in rows} == {"ok"}


def test_files_as_blobs(spark, items, tmp_path):
    items = [x for x in items if x]  # Spark's scan passes over empty files
    for i, x in enumerate(items):
        (tmp_path / f"{i}.bin").write_bytes(x)
    df = sources.from_files(spark, str(tmp_path), "*.bin")
    assert sorted(bytes(r["data"]) for r in df.collect()) == sorted(items)
    sources.write_archives(codec.compress_small(df, SMALL), str(tmp_path / "archives"))
    back = codec.decompress(spark.read.parquet(str(tmp_path / "archives")), strict=True)
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted(items)


def test_profiles_agree_with_byte_sql_and_between_stretches(spark, monkeypatch):
    from blockweave.operators import predict, profile

    rng = random.Random(8)
    items = [b"", b"a", b"ab", b"abc", None, bytes(rng.choices(b"abcab", k=700)), b"abcabcabc" * 40, rng.randbytes(900)]
    blobs = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(items)], "blob_id long, data binary")
    want = {}
    rows = byte_sql.with_predictions(byte_sql.byte_rows(blobs, ["blob_id"], "data", together=True), ["blob_id"])
    for column, into in (("b", "plain_score"), ("delta", "delta_score"), ("xored", "xor_score")):
        want[into] = {r["blob_id"]: r[into] for r in byte_sql.scores(rows, ["blob_id"], column, into).collect()}
    near = {r["blob_id"]: (r["c"], r["p"], r["s"]) for r in byte_sql.candidate_counts(rows, ["blob_id"]).groupBy("blob_id").agg(F.sum("candidates").alias("c"), F.count("nearest").alias("p"), F.sum("nearest").alias("s")).collect()}
    sums = {r["blob_id"]: r["s"] for r in rows.groupBy("blob_id").agg(F.sum(F.col("delta").cast("long") * (F.col("pos") % 1021 + 1)).alias("s")).collect()}
    for r in profile.scores(blobs).collect():
        assert r["n_bytes"] == len(items[r["blob_id"]] or b"")
        assert all(r[c] == want[c].get(r["blob_id"], 0) for c in want)
    for r in profile.candidates(blobs).collect():
        assert (r["candidates"], r["places"], r["nearest_sum"] or None) == (lambda x: (x[0], x[1], x[2]))(near.get(r["blob_id"], (0, 0, None)))
    assert {r["blob_id"]: r["d"] for r in profile.predictions(blobs, predict.DELTA, "d").collect() if r["n_bytes"]} == sums
    assert {r["mismatches"] for p in (1, 2) for r in profile.inverses(blobs, p).collect()} == {0}
    named = blobs.withColumn("k", F.when(F.col("blob_id") > 3, "x"))
    got = {(r["k"], r["symbol"]): r["n"] for r in profile.histogram(named, "k").collect()}
    assert got == {(k, b): n for k, ids in ((None, range(4)), ("x", range(4, len(items)))) for b, n in __import__("collections").Counter(b"".join(items[i] or b"" for i in ids)).items()}


@pytest.mark.parametrize("predictor", [0, 1, 2])
def test_long_blobs_are_measured_in_stretches(predictor):
    import numpy as np

    from blockweave.operators import predict, profile
    from blockweave.operators.matching import Group

    x = np.frombuffer(bytes(random.Random(9).choices(b"abcabd", k=5000)), np.uint8)
    for stretch in (1, 7, 1000, 4999):
        assert predict.score(x, predictor, stretch) == predict.scores(Group.of([x]), predictor)[0]
    whole = profile._candidates(Group.of([x]), 0)
    parts = sum(profile._candidates(Group(x[: at + 902], np.array([0, len(x[: at + 902])])), at) for at in range(0, 5000, 900))
    assert (parts == whole).all()
