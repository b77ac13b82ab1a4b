"""The catalogue: one query per operator, over whole tables, and its DuckDB twin where SQL has one."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.functions import bytes as byte_sql
from blockweave.functions import stats
from blockweave.operators import block as kernel
from blockweave.operators import codec, frame, huffman, predict, profile
from blockweave.plans import ranges as plans
from blockweave.plans.ranges import Sizes
from blockweave.runtime import settle, shared_folder, spread, table
from blockweave.sources import blobs as sources
from blockweave.sources import corpora as synthetic
from blockweave.streaming import stream

#: Blocks and chunks small enough for single documents to have several.
SMALL = 4096
SMALL_SIZES = Sizes(block=SMALL, least_planned=2 * SMALL, chunk_least=1024, chunk_most=16 * 1024, chunk_bits=12, least_period=256)
#: Documents of a corpus blob, and bytes from which its blocks are dealt over tasks.
GROUP, LARGE = 64, 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_text(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is heavy on each."""
    return spread(documents(spark, sf_dir), "blob_id")


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ``GROUP`` neighbouring documents as one blob."""
    return sources.concatenated(table(spark, sf_dir, "documents"), F.floor(F.col("doc_id") / GROUP).cast("long"))


def fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents, numbered over the whole table in the order of ids, with the first equal block."""
    cut = plans.slices(plans.fixed_ranges(documents(spark, sf_dir), SMALL))
    keyed = cut.withColumns({"digest": F.sha2("block", 256), "at": F.struct("blob_id", "block_index")})
    # a digest that is very common shrinks in the map side of the aggregate, not in a window
    first = keyed.groupBy("digest").agg(F.min("at").alias("first"))
    return keyed.join(first, "digest").select(F.col("blob_id").alias("doc_id"), "lang", "block_index", (F.col("end") - F.col("start")).alias("size"), F.col("first.blob_id").alias("first_doc"), F.col("first.block_index").alias("first_block"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of single documents, settled since they are costly and read more than once."""
    return settle(codec.compress_small(dealt(spark, sf_dir), SMALL_SIZES), "archives")


# -- plans and references ------------------------------------------------------------------


def q01_blob_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("blob_id").alias("doc_id"), "n_bytes")


def q02_fixed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = plans.fixed_ranges(documents(spark, sf_dir), SMALL)
    return cut.select(F.col("blob_id").alias("doc_id"), "block_index", F.col("start").alias("range_start"), F.col("end").alias("range_end"))


def q03_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_blocks(spark, sf_dir).select("doc_id", "block_index", "size", "first_doc", "first_block")


def q04_dedup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeat = ~((F.col("first_doc") == F.col("doc_id")) & (F.col("first_block") == F.col("block_index"))) & (F.col("size") > plans.REFERENCE_BYTES)
    return fixed_blocks(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("blocks"),
        F.count_if(repeat).alias("refs"),
        F.sum("size").cast("long").alias("total_bytes"),
        F.coalesce(F.sum(F.when(repeat, F.col("size"))), F.lit(0)).cast("long").alias("referenced_bytes"),
    )


def _roots(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = (F.col("first_doc") == F.col("doc_id")) & (F.col("first_block") == F.col("block_index"))
    roots = blocks.where(own).select("doc_id", "block_index", "size")
    used = blocks.where(~own).select(F.col("first_doc").alias("doc_id"), F.col("first_block").alias("block_index"))
    return roots, used


def q05_root_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = settle(fixed_blocks(spark, sf_dir), "fixed-blocks")
    roots, used = _roots(blocks)
    used = used.distinct()
    referenced = roots.join(used, ["doc_id", "block_index"], "left_semi").withColumn("referenced", F.lit(True))
    return referenced.unionByName(roots.join(used, ["doc_id", "block_index"], "left_anti").withColumn("referenced", F.lit(False)))


def q06_ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = settle(fixed_blocks(spark, sf_dir), "fixed-blocks")
    roots, used = _roots(blocks)
    uses = used.groupBy("doc_id", "block_index").agg(F.count("*").alias("uses"))
    return roots.join(uses, ["doc_id", "block_index"]).select("doc_id", "block_index", "size", "uses", (F.col("size") * F.col("uses")).alias("saved_bytes"))


def q07_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = plans.fixed_ranges(documents(spark, sf_dir), SMALL).withColumn("original", F.col("end") - F.col("start"))
    placed = plans.offsets(cut, ["blob_id"])
    # the block that holds the middle byte of its document
    middle = F.floor(F.col("n_bytes") / 2)
    holds = placed.where((F.col("offset") <= middle) & (middle < F.col("offset") + F.col("original")))
    return holds.select(F.col("blob_id").alias("doc_id"), "block_index", F.col("offset").alias("block_offset"), middle.alias("middle"))


# -- predictors ----------------------------------------------------------------------------


def _predicted(spark: SparkSession, sf_dir: str, predictor: int, into: str) -> DataFrame:
    sums = profile.predictions(dealt(spark, sf_dir), predictor, into)
    return sums.where("n_bytes > 0").select(F.col("blob_id").alias("doc_id"), into)


def q08_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, predict.DELTA, "delta_sum")


def q09_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, predict.XOR, "xored_sum")


def _inverse(spark: SparkSession, sf_dir: str, predictor: int) -> DataFrame:
    back = profile.inverses(dealt(spark, sf_dir), predictor)
    return back.where("n_bytes > 0").select(F.col("blob_id").alias("doc_id"), "n_bytes", "mismatches")


def q10_inverse_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inverse(spark, sf_dir, predict.DELTA)


def q11_inverse_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inverse(spark, sf_dir, predict.XOR)


def q12_predictor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over whole documents (the codec itself looks at a sample of each block)."""
    return profile.scores(dealt(spark, sf_dir)).where("n_bytes > 0").withColumnRenamed("blob_id", "doc_id")


def q13_predictor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    bar = F.col("plain_score") + F.floor(F.col("n_bytes") / predict.MARGIN)
    delta = (F.col("delta_score") > bar) & (F.col("delta_score") >= F.col("xor_score"))
    choice = F.when(F.col("n_bytes") < predict.LEAST, "none").when(delta, "delta").when(F.col("xor_score") > bar, "xor").otherwise("none")
    return q12_predictor_score(spark, sf_dir).groupBy(choice.alias("predictor")).agg(F.count("*").alias("docs"))


# -- entropy coding --------------------------------------------------------------------------


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(dealt(spark, sf_dir), "lang")


def q14_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def _code_lengths(counts: DataFrame) -> DataFrame:
    """(lang, symbol, n, length) of each language's best prefix code; 256 counts reach a task per language."""
    import pandas as pd

    def lengths(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(256, np.int64)
        counts[group["symbol"]] = group["n"]
        depth = huffman.code_lengths(counts.tolist())
        return group.assign(length=depth[group["symbol"]].astype(np.int32)) if depth is not None else group.assign(length=0).iloc[:0]

    return counts.groupBy("lang").applyInPandas(lengths, "lang string, symbol int, n long, length int")


def q15_canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec's own code of every byte that occurs in a language."""
    return byte_sql.canonical_codes(_code_lengths(_counts(spark, sf_dir)).drop("n"), ["lang"])


def _code_costs(counts: DataFrame) -> DataFrame:
    """(lang, n_bytes, code_bits, kraft) of each language's best prefix code, also where the codec has none; 256 counts reach a task per language."""
    import pandas as pd

    def costs(group: pd.DataFrame) -> pd.DataFrame:
        counts = [0] * 256
        for symbol, n in zip(group["symbol"].tolist(), group["n"].tolist()):
            counts[symbol] = n
        present, depths = huffman.best_depths(counts)
        bits = sum(counts[s] * d for s, d in zip(present, depths))
        deepest = max(depths)
        kraft = (sum(1 << deepest - d for d in depths) << huffman.LONGEST) >> deepest  # of any depth
        return group.iloc[:1][["lang"]].assign(n_bytes=sum(counts), code_bits=bits, kraft=kraft)

    return counts.groupBy("lang").applyInPandas(costs, "lang string, n_bytes long, code_bits long, kraft long")


def q16_code_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: bits of the best prefix code, its Kraft sum in 2**-24, and the entropy it cannot beat."""
    counts = settle(_counts(spark, sf_dir), "counts")
    floor = byte_sql.entropy_bits(counts, ["lang"]).select("lang", F.floor("bits").alias("entropy_bits"))
    return _code_costs(counts).join(floor, "lang")


def q17_block_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = plans.slices(plans.fixed_ranges(documents(spark, sf_dir), SMALL))
    return cut.select(F.col("blob_id").alias("doc_id"), "block_index", F.crc32("block").alias("crc"))


# -- layouts and matching ----------------------------------------------------------------------


def q18_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period of every benchmark text written two to nine times."""
    items = table(spark, sf_dir, "benchmark").withColumn("copies", (F.col("item_id") % 8 + 2).cast("int"))
    text = F.repeat(F.coalesce("text", F.lit("")), F.col("copies"))
    blobs = sources.with_size(items.select("item_id", "copies", text.cast("binary").alias("data")))
    return plans.periods(blobs, least_period=1).select("item_id", "n_bytes", "period")


def _layout(planned: DataFrame) -> DataFrame:
    size = F.col("end") - F.col("start")
    return planned.where("block_index IS NOT NULL").groupBy("blob_id").agg(
        F.count("*").alias("blocks"), F.min(size).alias("least"), F.max(size).alias("most"), F.sum(size).cast("long").alias("n_bytes"), F.count("ref_target").alias("refs")
    )


def q19_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each corpus blob in the layout that suits it."""
    return _layout(codec.plan(corpora(spark, sf_dir), SMALL_SIZES))


def q20_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.candidates(dealt(spark, sf_dir)).where("n_bytes > 2")
    return found.select(F.col("blob_id").alias("doc_id"), "candidates", "places", "nearest_sum")


def q21_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that literals, matches and references make, per document."""
    found = codec.analyze(archives(spark, sf_dir))
    return found.select(F.col("blob_id").alias("doc_id"), (F.col("literal_bytes") + F.col("matched_bytes") + F.col("referenced_bytes")).alias("made_bytes"))


def q22_split_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the four streams of split blocks, decoded."""
    blocks = codec.read_blocks(archives(spark, sf_dir)).where(F.col("method") == kernel.SPLIT)
    return codec.stream_sizes(blocks).withColumnRenamed("blob_id", "doc_id")


def q23_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in kernel.METHOD_NAMES.items() for x in kv])
    blocks = codec.read_blocks(archives(spark, sf_dir)).where("method IS NOT NULL")
    return blocks.groupBy(names[F.col("method")].alias("method")).agg(F.count("*").alias("blocks"), F.sum("original").alias("original"), F.sum("packed").alias("packed"))


# -- archives ------------------------------------------------------------------------------------


def q24_roundtrip_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = codec.decompress(codec.compress_small(dealt(spark, sf_dir), SMALL_SIZES), strict=True)
    return back.select(F.col("blob_id").alias("doc_id"), F.md5("data").alias("md5"))


def q25_roundtrip_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of many documents, with references; the blocks of the larger ones dealt over tasks both ways."""
    packed = settle(codec.compress(corpora(spark, sf_dir), SMALL_SIZES, deal=LARGE), "archives")
    return codec.decompress_parallel(packed, deal=LARGE * 2 // 3).select("blob_id", "status", F.md5("data").alias("md5"))


def q26_frame_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = codec.frame_info(archives(spark, sf_dir))
    return info.select(F.col("blob_id").alias("doc_id"), "version", "original_size", "checksum", "status")


def q27_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.derived(codec.analyze(archives(spark, sf_dir)))


def q28_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.check(archives(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("archives"), F.sum("original").alias("original"))


def q29_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archive cut short and with a byte of a checksum flipped: none may pass."""
    whole = archives(spark, sf_dir).where(F.octet_length("archive") > frame.HEADER + frame.BLOCK_HEADER)
    size = F.octet_length("archive")
    short = F.substring("archive", F.lit(1), (size * 2 / 3).cast("int"))
    # the checksum of the first block stands in the last four bytes of its header
    at = frame.HEADER + frame.BLOCK_HEADER
    byte = F.conv(F.hex(F.substring("archive", at, 1)), 16, 10).cast("int")
    flipped = F.concat(F.substring("archive", 1, at - 1), F.unhex(F.lpad(F.hex(byte.bitwiseXOR(255)), 2, "0")), F.expr(f"substring(archive, {at + 1})"))
    bad = whole.select("blob_id", F.lit("short").alias("kind"), short.alias("archive")).unionByName(whole.select("blob_id", F.lit("flipped").alias("kind"), flipped.alias("archive")))
    keyed = bad.withColumn("id", F.col("blob_id") * 2 + (F.col("kind") == "short").cast("int"))
    done = codec.check(keyed.select(F.col("id").alias("blob_id"), "archive"))
    kind = F.when(F.col("blob_id") % 2 == 1, "short").otherwise("flipped")
    return done.groupBy(kind.alias("kind")).agg(F.count("*").alias("archives"), F.count_if(F.col("status") != "ok").alias("refused"))


def q30_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document stays within a limit of its bytes, as decoding says."""
    limit = 3000
    done = codec.check(archives(spark, sf_dir), limit)
    return done.select(F.col("blob_id").alias("doc_id"), F.col("status") == "ok", "status").toDF("doc_id", "within", "status")


def q31_stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a stream that encodes and another that decodes."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    dealt(spark, sf_dir).select("blob_id", "data").write.parquet(f"{folder}/in")
    encoded = stream.encode_stream(stream.blob_source(spark, f"{folder}/in", "blob_id long, data binary"), SMALL)
    stream.run_to_end(encoded, f"{folder}/archives", f"{folder}/encode-log")
    decoded = stream.decode_stream(stream.blob_source(spark, f"{folder}/archives", "blob_id long, archive binary"))
    stream.run_to_end(decoded, f"{folder}/out", f"{folder}/decode-log")
    back = spark.read.schema("blob_id long, data binary, status string").parquet(f"{folder}/out")
    return back.select(F.col("blob_id").alias("doc_id"), "status", F.md5("data").alias("md5"))


def q32_legacy_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives under the four earlier magics, with a level, decode as well."""
    version = (F.col("blob_id") % 4 + 4).cast("int")
    magic = F.element_at(F.array(*[F.lit(frame.MAGIC[v]) for v in (4, 5, 6, 7)]), version - 3)
    old = archives(spark, sf_dir).withColumn("archive", F.concat(magic, F.lit(b"\x05"), F.expr("substring(archive, 6)")))
    info = codec.frame_info(old).select("blob_id", "version", "legacy_level")
    back = codec.decompress(old, strict=True).select("blob_id", F.md5("data").alias("md5"))
    return back.join(info, "blob_id").select(F.col("blob_id").alias("doc_id"), "version", "legacy_level", "md5")


#: Order keys of one column block.
COLUMN = 4096


def q33_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys per line number as columns of eight bytes each, in blocks of neighbouring keys: sums of the bytes and of what both predictors make of them."""
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", F.floor(F.col("l_orderkey") / COLUMN).alias("block"))
    before = F.lag("l_orderkey").over(Window.partitionBy("l_linenumber", "block").orderBy("l_orderkey"))
    rows = lines.withColumn("before", before)

    def byte(name: str, i: int) -> Column:
        return F.call_function("shiftright", F.col(name), F.lit(8 * i)).bitwiseAND(255)

    # the byte before a value's first one is the last of the value before
    pairs = [(byte("l_orderkey", i), byte("l_orderkey", i - 1) if i else F.coalesce(byte("before", 7), F.lit(0).cast("long"))) for i in range(8)]

    def total(each) -> Column:
        return reduce(add, [each(b, a) for b, a in pairs])

    own = rows.select("l_linenumber", total(lambda b, a: b).alias("b"), total(lambda b, a: F.pmod(b - a, F.lit(256))).alias("d"), total(lambda b, a: b.bitwiseXOR(a)).alias("x"))
    return own.groupBy("l_linenumber").agg((F.count("*") * 8).alias("n"), F.sum("b").alias("byte_sum"), F.sum("d").alias("delta_sum"), F.sum("x").alias("xor_sum"))


def q34_bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and quartiles of a measure per group, interpolated; in quarters of a cent, which are whole."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", cents.alias("cents"))
    found = stats.quantiles(lines, ["l_returnflag", "l_linestatus"], "cents", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    whole = {c: F.round(F.col(c) * 4).cast("long") for c in ("q1", "median", "q3")}
    return found.withColumns(whole).withColumn("iqr", F.col("q3") - F.col("q1"))


def q35_chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each corpus blob: contiguous from 0 to its end, none too long, references only to roots that are as long."""
    planned = settle(codec.plan(corpora(spark, sf_dir), SMALL_SIZES), "plan")
    before = Window.partitionBy("blob_id").orderBy("block_index")
    target = planned.select("blob_id", F.col("block_index").alias("ref_target"), (F.col("end") - F.col("start")).alias("target_size"), F.col("ref_target").isNull().alias("root"))
    rows = planned.withColumn("gap", F.col("start") - F.lag("end", 1, 0).over(before)).join(target, ["blob_id", "ref_target"], "left")
    size = F.col("end") - F.col("start")
    bad = F.col("ref_target").isNotNull() & (~F.col("root") | (F.col("target_size") != size))
    return rows.groupBy("blob_id").agg(
        F.max("end").alias("n_bytes"), F.sum(F.abs("gap")).alias("gap_bytes"), F.count_if(size > SMALL_SIZES.chunk_most).alias("too_long"), F.count_if(bad).alias("bad_references")
    )


def q36_periodic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every benchmark text written 20 to 26 times: cut by its period, all units but the first are references."""
    text = F.repeat(F.coalesce("text", F.lit("")), (F.col("item_id") % 7 + 20).cast("int"))
    blobs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("blob_id"), text.cast("binary").alias("data"))
    return _layout(codec.plan(blobs, SMALL_SIZES))


def q37_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded corpora through the codec and back: sizes, references, and whether each comes back whole."""
    found = settle(synthetic.corpora(spark, 0.1), "corpora")
    packed = settle(codec.compress(found, SMALL_SIZES), "archives")
    counts = codec.analyze(packed).select("blob_id", "original_size", "frame_size", "blocks", "referenced_bytes", "status")
    back = codec.decompress_parallel(packed).select("blob_id", F.md5("data").alias("back"))
    return found.select("blob_id", "name", F.md5("data").alias("md5")).join(counts, "blob_id").join(back, "blob_id").select("*", (F.col("md5") == F.col("back")).alias("whole")).drop("back")


# -- twins -----------------------------------------------------------------------------------------

_BLOCKS = """
cut AS (
  SELECT doc_id, lang, encode(coalesce(text, '')) AS data, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents
), ranges AS (
  SELECT *, unnest(range(0, (n_bytes + 4095) // 4096)) AS i FROM cut
), blocks AS (
  SELECT doc_id, lang, n_bytes, CAST(i AS INTEGER) AS block_index, i * 4096 AS range_start, least(i * 4096 + 4096, n_bytes) AS range_end,
         data[i * 4096 + 1 : least(i * 4096 + 4096, n_bytes)] AS block
  FROM ranges
), firsts AS (
  SELECT *, range_end - range_start AS size,
         first_value(doc_id) OVER w AS first_doc, first_value(block_index) OVER w AS first_block
  FROM blocks WINDOW w AS (PARTITION BY block ORDER BY doc_id, block_index)
)
"""
_BYTES = """
bytes AS (
  SELECT doc_id, lang, p - 1 AS pos, CAST('0x' || h AS INTEGER) AS b FROM (
    SELECT doc_id, lang, unnest(l) AS h, generate_subscripts(l, 1) AS p
    FROM (SELECT doc_id, lang, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents))
), predicted AS (
  SELECT *, (b - lag(b, 1, 0) OVER w + 256) % 256 AS delta, xor(b, lag(b, 1, 0) OVER w) AS xored
  FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), inverse AS (
  SELECT *, sum(delta) OVER w % 256 AS from_delta, bit_xor(xored) OVER w AS from_xored
  FROM predicted WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
"""


def _score(value: str) -> str:
    return f"""
{value}_tri AS (
  SELECT doc_id, pos, xor(xor({value} * 251, lead({value}, 1) OVER w * 31), lead({value}, 2) OVER w) AS h,
         {value} * 65536 + lead({value}, 1) OVER w * 256 + lead({value}, 2) OVER w AS t
  FROM predicted WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), {value}_score AS (
  SELECT doc_id, count(*) FILTER (WHERE same) AS score FROM (
    SELECT doc_id, t = lag(t) OVER (PARTITION BY doc_id, h & 4095 ORDER BY pos) AS same FROM {value}_tri WHERE t IS NOT NULL) GROUP BY doc_id
)"""


_SCORES = f"""{_BYTES}, {_score("b")}, {_score("delta")}, {_score("xored")}, scores AS (
  SELECT s.doc_id, n_bytes, coalesce(p.score, 0) AS plain_score, coalesce(d.score, 0) AS delta_score, coalesce(x.score, 0) AS xor_score
  FROM (SELECT doc_id, count(*) AS n_bytes FROM bytes GROUP BY doc_id) s
  LEFT JOIN b_score p USING (doc_id) LEFT JOIN delta_score d USING (doc_id) LEFT JOIN xored_score x USING (doc_id)
)"""
_OWN = "first_doc = doc_id AND first_block = block_index"
_COUNTS = f"{_BYTES}, counts AS (SELECT lang, b AS symbol, count(*) AS n FROM bytes GROUP BY ALL)"
_CORPORA = f"SELECT doc_id // {GROUP} AS blob_id, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1"



def _plan(blobs: str, sizes: Sizes = SMALL_SIZES) -> str:
    """Ranges of every blob of ``blobs`` (blob_id, data) in the layout that suits it, as (blob_id, n, i, s, e, ref); ref marks references.

    The rolling hash of 64 bytes is summed up by doubling; what content-defined cuts follow is one
    recursion per blob.
    """
    gear = ", ".join(f"({i}, {int(g)})" for i, g in enumerate(plans._GEAR))
    rolled = "h0 AS (SELECT blob_id, pos, CAST(g AS HUGEINT) AS h FROM single JOIN gear USING (b))"
    for k in range(6):
        rolled += f""", h{k + 1} AS (
          SELECT blob_id, pos, (h + lag(h, {1 << k}, 0) OVER (PARTITION BY blob_id ORDER BY pos) * {1 << (1 << k)}) % 18446744073709551616 AS h FROM h{k})"""
    return f"""
blobs AS ({blobs}), sized AS (SELECT *, CAST(octet_length(data) AS BIGINT) AS n FROM blobs),
gear(b, g) AS (VALUES {gear}),
single AS (
  SELECT blob_id, p - 1 AS pos, CAST('0x' || h AS INTEGER) AS b
  FROM (SELECT blob_id, unnest(l) AS h, generate_subscripts(l, 1) AS p FROM (SELECT blob_id, regexp_extract_all(hex(data), '..') AS l FROM sized WHERE n >= {sizes.least_planned}))
), {rolled}, ends AS (
  SELECT blob_id, list(pos + 1 ORDER BY pos) AS places FROM h6 WHERE h < {1 << (64 - sizes.chunk_bits)} GROUP BY blob_id
), content AS (
  SELECT blob_id, n, coalesce(places, []) AS places, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e FROM sized LEFT JOIN ends USING (blob_id) WHERE n >= {sizes.least_planned}
  UNION ALL
  SELECT blob_id, n, places, i + 1, e, least(coalesce(list_filter(places, lambda x: x >= e + {sizes.chunk_least})[1], n), e + {sizes.chunk_most}, n) FROM content WHERE e < n
), tried AS (SELECT blob_id, data, n, unnest(range(2, {plans.MOST_COPIES + 1})) AS copies FROM sized WHERE n >= {sizes.least_planned}
), periodic AS (
  SELECT blob_id, min(n // copies) AS unit FROM tried WHERE n % copies = 0 AND n // copies >= {sizes.least_period} AND data[n // copies + 1 :] = data[: n - n // copies] GROUP BY blob_id
), units AS (SELECT blob_id, n, unit, unnest(range(0, n, unit)) AS begin FROM sized JOIN periodic USING (blob_id)
), parts AS (SELECT blob_id, n, begin + unit AS stop, unnest(range(begin, begin + unit, {sizes.block})) AS s FROM units
), ranges AS (
  SELECT blob_id, n, 'fixed' AS kind, s, least(s + {sizes.block}, n) AS e FROM (SELECT blob_id, n, unnest(range(0, n, {sizes.block})) AS s FROM sized)
  UNION ALL SELECT blob_id, n, 'planned', s, least(s + {sizes.block}, stop) FROM parts
  UNION ALL SELECT blob_id, n, 'planned', s, e FROM content WHERE i >= 0 AND blob_id NOT IN (SELECT blob_id FROM periodic)
), marked AS (
  SELECT blob_id, n, kind, s, e, e - s > {plans.REFERENCE_BYTES} AND n >= {sizes.least_planned}
         AND row_number() OVER (PARTITION BY blob_id, kind, data[s + 1 : e] ORDER BY s) > 1 AS ref
  FROM ranges JOIN sized USING (blob_id, n)
), chosen AS (
  SELECT blob_id, CASE WHEN coalesce(sum(e - s) FILTER (WHERE kind = 'planned' AND ref), 0) >= any_value(n) // 100 AND any_value(n) >= {sizes.least_planned} THEN 'planned' ELSE 'fixed' END AS kind
  FROM marked GROUP BY blob_id
), planned AS (SELECT blob_id, n, row_number() OVER (PARTITION BY blob_id ORDER BY s) - 1 AS i, s, e, ref FROM marked JOIN chosen USING (blob_id, kind))"""


_PLANNED = "SELECT blob_id, count(*) AS blocks, min(e - s) AS least, max(e - s) AS most, CAST(sum(e - s) AS BIGINT) AS n_bytes, count(*) FILTER (WHERE ref) AS refs FROM planned GROUP BY blob_id"
_BENCHMARK_COPIES = "SELECT item_id AS blob_id, encode(repeat(coalesce(text, ''), CAST(item_id % 7 + 20 AS BIGINT))) AS data FROM benchmark"

ORACLE_SQL = {
    "q01_blob_sizes": f"WITH {_BLOCKS} SELECT doc_id, n_bytes FROM cut",
    "q02_fixed_ranges": f"WITH {_BLOCKS} SELECT doc_id, block_index, range_start, range_end FROM blocks",
    "q03_block_dedup": f"WITH {_BLOCKS} SELECT doc_id, block_index, size, first_doc, first_block FROM firsts",
    "q04_dedup_coverage": f"""WITH {_BLOCKS} SELECT lang, count(*) AS blocks, count(*) FILTER (WHERE NOT ({_OWN}) AND size > 4) AS refs,
        CAST(sum(size) AS BIGINT) AS total_bytes, CAST(coalesce(sum(size) FILTER (WHERE NOT ({_OWN}) AND size > 4), 0) AS BIGINT) AS referenced_bytes FROM firsts GROUP BY lang""",
    "q05_root_blocks": f"""WITH {_BLOCKS} SELECT doc_id, block_index, size, EXISTS (
        SELECT 1 FROM firsts u WHERE u.first_doc = r.doc_id AND u.first_block = r.block_index AND NOT (u.doc_id = r.doc_id AND u.block_index = r.block_index)) AS referenced
        FROM firsts r WHERE {_OWN}""",
    "q06_ref_resolve": f"""WITH {_BLOCKS} SELECT first_doc AS doc_id, first_block AS block_index, any_value(size) AS size, count(*) AS uses, CAST(sum(size) AS BIGINT) AS saved_bytes
        FROM firsts WHERE NOT ({_OWN}) GROUP BY first_doc, first_block""",
    "q07_offsets": f"WITH {_BLOCKS} SELECT doc_id, block_index, range_start AS block_offset, n_bytes // 2 AS middle FROM blocks WHERE range_start <= n_bytes // 2 AND n_bytes // 2 < range_end",
    "q08_delta": f"WITH {_BYTES} SELECT doc_id, CAST(sum(delta * (pos % 1021 + 1)) AS BIGINT) AS delta_sum FROM predicted GROUP BY doc_id",
    "q09_xor": f"WITH {_BYTES} SELECT doc_id, CAST(sum(xored * (pos % 1021 + 1)) AS BIGINT) AS xored_sum FROM predicted GROUP BY doc_id",
    "q10_inverse_delta": f"WITH {_BYTES} SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE from_delta <> b) AS mismatches FROM inverse GROUP BY doc_id",
    "q11_inverse_xor": f"WITH {_BYTES} SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE from_xored <> b) AS mismatches FROM inverse GROUP BY doc_id",
    "q12_predictor_score": f"WITH {_SCORES} SELECT * FROM scores",
    "q13_predictor_choice": f"""WITH {_SCORES} SELECT CASE WHEN n_bytes < 64 THEN 'none'
        WHEN delta_score > plain_score + n_bytes // 64 AND delta_score >= xor_score THEN 'delta'
        WHEN xor_score > plain_score + n_bytes // 64 THEN 'xor' ELSE 'none' END AS predictor, count(*) AS docs FROM scores GROUP BY 1""",
    "q14_histogram": f"WITH {_COUNTS} SELECT lang, symbol, n FROM counts",
    # merges of the two least nodes (count, order of arising, bytes below); a byte's length is the number of merges it takes part in
    "q15_canonical_codes": f"""WITH RECURSIVE {_COUNTS}, steps AS (
          SELECT lang, list(struct_pack(w := CAST(n AS BIGINT), s := CAST(0 AS BIGINT), k := CAST(symbol AS BIGINT), b := [symbol]) ORDER BY n, symbol) AS q, CAST([] AS INTEGER[]) AS merged, CAST(1 AS BIGINT) AS step
          FROM counts GROUP BY lang
          UNION ALL
          SELECT lang, list_sort(list_append(q[3:], struct_pack(w := q[1].w + q[2].w, s := step, k := CAST(0 AS BIGINT), b := list_concat(q[1].b, q[2].b)))), list_concat(q[1].b, q[2].b), step + 1
          FROM steps WHERE len(q) > 1
        ), depths AS (SELECT lang, symbol, CAST(count(*) AS INTEGER) AS length FROM (SELECT lang, unnest(merged) AS symbol FROM steps) GROUP BY ALL
        ), lengths AS (SELECT * FROM depths WHERE lang IN (SELECT lang FROM depths GROUP BY lang HAVING max(length) <= 24)
        ) SELECT lang, symbol, length, CAST(coalesce(sum(CAST(1 AS BIGINT) << (24 - length)) OVER w, 0) AS BIGINT) >> (24 - length) AS code
        FROM lengths WINDOW w AS (PARTITION BY lang ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    # the best code's cost is the sum of all merged counts, whatever the order of equal ones
    "q16_code_cost": f"""WITH RECURSIVE {_COUNTS}, merged AS (
          SELECT lang, list_sort(list(CAST(n AS BIGINT))) AS w, CAST(0 AS BIGINT) AS cost FROM counts GROUP BY lang
          UNION ALL SELECT lang, list_sort(list_append(w[3:], w[1] + w[2])), cost + w[1] + w[2] FROM merged WHERE len(w) > 1
        ), entropy AS (
          SELECT lang, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(floor(sum(-n * log2(n / total))) AS BIGINT) AS entropy_bits
          FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM counts) GROUP BY lang
        ) SELECT lang, n_bytes, cost AS code_bits, CAST(16777216 AS BIGINT) AS kraft, entropy_bits FROM merged JOIN entropy USING (lang) WHERE len(w) = 1""",
    # the checksum is linear: every set bit adds what it becomes after the bytes that follow it
    "q17_block_crc": f"""WITH RECURSIVE {_BYTES}, steps AS (
          SELECT 0 AS k, i AS bit, CAST(CASE WHEN i = 8 THEN 4294967295 ELSE 1 << i END AS BIGINT) AS x FROM range(9) t(i)
          UNION ALL
          SELECT k + 1, bit, list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) FROM steps WHERE k < {SMALL}
        ), placed AS (
          SELECT doc_id, pos // {SMALL} AS block_index, b, count(*) OVER w AS n, pos % {SMALL} AS i FROM bytes WINDOW w AS (PARTITION BY doc_id, pos // {SMALL})
        ), bits AS (SELECT doc_id, block_index, n, n - i AS k, unnest(list_filter(range(8), lambda j: (b >> j) & 1 = 1)) AS bit FROM placed)
        , sums AS (SELECT doc_id, block_index, n, bit_xor(x) AS s FROM bits JOIN steps USING (k, bit) GROUP BY ALL)
        SELECT doc_id, CAST(block_index AS INTEGER) AS block_index, xor(4294967295, xor(s, x)) AS crc FROM sums JOIN steps ON steps.k = n AND steps.bit = 8""",
    "q18_period": """WITH items AS (SELECT item_id, text AS t, encode(repeat(text, CAST(item_id % 8 + 2 AS BIGINT))) AS data FROM benchmark),
        tried AS (SELECT item_id, data, octet_length(data) AS n, unnest(range(2, 65)) AS copies FROM items)
        SELECT item_id, CAST(n AS BIGINT) AS n_bytes, min(n // copies) FILTER (WHERE n % copies = 0 AND data[n // copies + 1 :] = data[: n - n // copies]) AS period
        FROM tried GROUP BY item_id, n""",
    "q19_chunks": f"WITH RECURSIVE {_plan(f'SELECT blob_id, encode(t) AS data FROM ({_CORPORA})')} {_PLANNED}",
    "q36_periodic_plan": f"WITH RECURSIVE {_plan(_BENCHMARK_COPIES)} {_PLANNED}",
    "q20_candidates": f"""WITH {_BYTES}, {_score("b")}, near AS (
          SELECT doc_id, pos, {" + ".join(f"CASE WHEN pos - lag(pos, {k}) OVER w <= 65535 THEN 1 ELSE 0 END" for k in range(1, 17))} AS candidates,
                 CASE WHEN pos - lag(pos) OVER w <= 65535 THEN pos - lag(pos) OVER w END AS nearest
          FROM b_tri WHERE t IS NOT NULL WINDOW w AS (PARTITION BY doc_id, h ORDER BY pos)
        ) SELECT doc_id, CAST(sum(candidates) AS BIGINT) AS candidates, count(nearest) AS places, CAST(coalesce(sum(nearest), 0) AS BIGINT) AS nearest_sum FROM near GROUP BY doc_id""",
    "q21_tokens": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS made_bytes FROM documents",
    "q24_roundtrip_docs": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    "q25_roundtrip_corpus": f"SELECT blob_id, 'ok' AS status, md5(t) AS md5 FROM ({_CORPORA})",
    "q26_frame_info": "SELECT doc_id, CAST(8 AS INTEGER) AS version, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS original_size, true AS checksum, 'ok' AS status FROM documents",
    "q28_check": "SELECT 'ok' AS status, count(*) AS archives, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS original FROM documents",
    "q29_corruption": "SELECT kind, count(*) AS archives, count(*) AS refused FROM documents, (VALUES ('short'), ('flipped')) k(kind) WHERE text <> '' GROUP BY kind",
    "q30_limit": """SELECT doc_id, octet_length(encode(coalesce(text, ''))) <= 3000 AS within,
        CASE WHEN octet_length(encode(coalesce(text, ''))) <= 3000 THEN 'ok' ELSE 'OutputLimitExceeded' END AS status FROM documents""",
    "q31_stream_roundtrip": "SELECT doc_id, 'ok' AS status, md5(coalesce(text, '')) AS md5 FROM documents",
    "q32_legacy_headers": "SELECT doc_id, CAST(doc_id % 4 + 4 AS INTEGER) AS version, CAST(5 AS INTEGER) AS legacy_level, md5(coalesce(text, '')) AS md5 FROM documents",
    "q33_columns": f"""WITH vals AS (
          SELECT l_linenumber, l_orderkey AS v, lag(l_orderkey) OVER (PARTITION BY l_linenumber, l_orderkey // {COLUMN} ORDER BY l_orderkey) AS p FROM lineitem
        ), bytes AS (SELECT l_linenumber, v, p, unnest(range(8)) AS i FROM vals
        ), pairs AS (SELECT l_linenumber, (v >> (8 * i)) & 255 AS b, CASE WHEN i > 0 THEN (v >> (8 * i - 8)) & 255 ELSE coalesce((p >> 56) & 255, 0) END AS a FROM bytes)
        SELECT l_linenumber, count(*) AS n, CAST(sum(b) AS BIGINT) AS byte_sum, CAST(sum((b - a + 256) % 256) AS BIGINT) AS delta_sum, CAST(sum(xor(a, b)) AS BIGINT) AS xor_sum FROM pairs GROUP BY l_linenumber""",
    "q34_bench_stats": """WITH c AS (SELECT l_returnflag, l_linestatus, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem), s AS (
          SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(quantile_cont(cents, 0.25) * 4) AS BIGINT) AS q1,
                 CAST(round(quantile_cont(cents, 0.5) * 4) AS BIGINT) AS median, CAST(round(quantile_cont(cents, 0.75) * 4) AS BIGINT) AS q3 FROM c GROUP BY ALL
        ) SELECT *, q3 - q1 AS iqr FROM s""",
    "q35_chunk_bounds": f"""SELECT blob_id, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS gap_bytes, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS bad_references
        FROM ({_CORPORA})""",
}

QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
