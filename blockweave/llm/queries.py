"""The registered queries ``opN_<name>`` of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_file

from blockweave.llm import byte_bpe, chat, exact_dedup, html_extract, license_scan, near_dedup, packing, sharding, topk, toxicity
from blockweave.runtime import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, dealt over all cores if it is only a few files."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


#: Schemas of the tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.linked(table(spark, sf_dir, "conversations"), TOOLS)
    return linked.select("conv_id", "turn", "part", "order_turn", "depth", "kind", "call_id", "status", "json")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spread(table(spark, sf_dir, "pages"), "page_id"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh
  FROM w
), e AS (
  SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(doc, root) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.doc
), named AS (SELECT doc, min(root) AS component_id FROM reach GROUP BY doc)
SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN named ON doc = doc_id
"""

OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

#: On these tables every page has one article of headings, paragraphs, line breaks and bold text; other markup is tested on fixtures.
OP6_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 20
"""

#: The tables hold no tool calls, so every turn is one plain message of status ok; linking is tested on fixtures.
OP5_SQL = """
SELECT conv_id, turn, CAST(0 AS INTEGER) AS part, turn AS order_turn, CAST(0 AS INTEGER) AS depth, 'plain' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'ok' AS status,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || CAST(to_json(coalesce(role, 'unknown')) AS VARCHAR) || '}' AS json
FROM conversations
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_near_dedup": op2_near_dedup,
    "op3_kd_sharding": op3_kd_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_tool_call_linking": op5_tool_call_linking,
    "op6_html_extraction": op6_html_extraction,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_exact_topk": op9_exact_topk,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL = {
    "op2_near_dedup": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_tool_call_linking": OP5_SQL,
    "op6_html_extraction": OP6_SQL,
    "op9_exact_topk": OP9_SQL,
}
