"""Every query of the catalogue on the smallest tables, against its twin where it has one."""

import glob
import os
import subprocess
import sys
import zlib

import duckdb
import pytest

from blockweave import queries as catalogue
from blockweave.runtime import table


@pytest.fixture(scope="module")
def duck(small_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{small_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, small_dir, name):
    df = catalogue.QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    assert rows
    if name in catalogue.ORACLE_SQL:
        twin = duck.sql(f"select {', '.join(columns)} from ({catalogue.ORACLE_SQL[name]})")
        assert plain(rows) == plain(twin.fetchall())


def test_code_cost_is_between_entropy_and_entropy_plus_one(spark, small_dir):
    for r in catalogue.q16_code_cost(spark, small_dir).collect():
        assert r["kraft"] == 1 << 24
        assert r["entropy_bits"] <= r["code_bits"] <= r["entropy_bits"] + r["n_bytes"] + 1


def test_code_cost_of_codes_that_the_codec_does_not_have(spark, tmp_path):
    counts = [1, 1]
    while len(counts) < 28:
        counts.append(counts[-1] + counts[-2])
    deep = "".join(chr(65 + i) * n for i, n in enumerate(counts))  # 27 bits for the rarest
    rows = [(1, deep, "deep"), (2, "aaaa", "one"), (3, "abracadabra", "some"), (4, None, "none")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.q16_code_cost(spark, str(tmp_path))
    columns = sorted(df.columns)
    found = df.select(columns).collect()
    assert {r["lang"]: (r["code_bits"], r["kraft"]) for r in found}["one"] == (0, 1 << 24)
    assert len(found) == 3
    assert plain(found) == plain(c.sql(f"select {', '.join(columns)} from ({catalogue.ORACLE_SQL['q16_code_cost']})").fetchall())


def test_block_checksums(spark, small_dir):
    texts = {r["doc_id"]: r["text"].encode() for r in table(spark, small_dir, "documents").collect()}
    for r in catalogue.q17_block_crc(spark, small_dir).collect():
        at = r["block_index"] * catalogue.SMALL
        assert r["crc"] == zlib.crc32(texts[r["doc_id"]][at : at + catalogue.SMALL])


@pytest.mark.parametrize("absent", ["xxhash", "public_tokenizers", "blockweave.llm.shingles"])
def test_what_cannot_be_imported_hides_nothing_else(absent):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); sys.modules[{absent!r}] = None\nimport __spark_entry__ as e\nassert 'q01_blob_sizes' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True)


def test_code_reaches_workers_that_have_no_path_to_it(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\nimport __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "assert e.queries()['q24_roundtrip_docs'](s, '/root/testdata/sf0.001').count() == 200"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_entry_imports_without_the_llm_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "blockweave"):
        os.symlink(os.path.join(root, name), tmp_path / name)
    code = "import sys; sys.path.insert(0, '.'); sys.modules['blockweave.llm'] = None\nimport __spark_entry__ as e\nassert 'q01_blob_sizes' in e.queries() and not [k for k in e.queries() if k[:2] == 'op'], e.queries()\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
