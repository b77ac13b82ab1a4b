"""SQL functions, synthetic corpora and run statistics."""

from blockweave import api
from blockweave.functions import stats, udfs
from blockweave.operators import codec
from blockweave.plans.ranges import Sizes
from blockweave.sources import blobs as sources
from blockweave.sources import corpora

SMALL = Sizes(block=4096, least_planned=8192, chunk_least=1024, chunk_most=16384, chunk_bits=11, least_period=1024)


def test_sql_functions(spark):
    assert len(udfs.register(spark)) == 4
    items = [b"", b"abc" * 500, b"x"]
    sources.from_memory(spark, items).createOrReplaceTempView("blobs")
    rows = spark.sql("SELECT blob_id, data, bw_decompress(a) AS back, bw_status(a) AS ok, bw_status(data) AS bad, bw_original_size(a) AS n FROM (SELECT *, bw_compress(data) AS a FROM blobs)").collect()
    for r in rows:
        assert bytes(r["back"]) == bytes(r["data"]) and r["ok"] == "ok" and r["bad"] == "BadMagic" and r["n"] == len(r["data"])
    assert spark.sql("SELECT bw_compress(CAST(NULL AS BINARY)) AS x").first()["x"] is None


def test_corpora_are_seeded_and_round_trip(spark):
    found = corpora.corpora(spark, 0.2).cache()
    data = {r["name"]: bytes(r["data"]) for r in found.collect()}
    assert set(data) == set(corpora.NAMES)
    assert all(data[n] == corpora.corpus(n, 0.2) for n in data)
    analysis = {r["blob_id"]: r for r in codec.analyze(codec.compress(found, SMALL)).collect()}
    by_name = {n: analysis[i] for i, n in enumerate(corpora.NAMES)}
    assert by_name["repeated-text"]["frame_size"] < 0.1 * len(data["repeated-text"])
    assert by_name["shifted-repeats"]["referenced_bytes"] > 0.7 * len(data["shifted-repeats"])
    # of five copies the one with a single edit repeats almost whole
    assert by_name["near-duplicates"]["referenced_bytes"] > 0.18 * len(data["near-duplicates"])
    assert by_name["random"]["frame_size"] < 1.01 * len(data["random"]) + 100
    for n, x in data.items():
        assert api.decompress(api.compress(x, SMALL)) == x, n


def test_run_statistics(spark):
    runs = spark.createDataFrame([("a", 1 << 20, s) for s in (1.0, 2.0, 3.0, 4.0)] + [("b", 1 << 20, 0.0)], "engine string, n long, s double")
    got = {r["engine"]: r for r in stats.summary(stats.throughput(runs, "n", "s"), ["engine"], "s").collect()}
    assert (got["a"]["median"], got["a"]["q1"], got["a"]["q3"], got["a"]["iqr"], got["a"]["n"]) == (2.5, 1.75, 3.25, 1.5, 4)
    assert stats.throughput(runs, "n", "s").where("engine = 'b'").first()["mib_per_second"] is None
