"""Exact de-duplication with a heavy-hitter split, in DataFrame operations only.

1. Every text is normalised and digested once; the narrow table (row, id, digest) is settled.
2. A Misra-Gries summary (Spark's frequent-items sketch) per group of input partitions, then
   one merge, names the most frequent digests, at most ``heavy``: each with more than
   ``rows / tracked`` copies is among them unless there are over ``heavy`` such.
3. The exact winner and count of each named digest come from an aggregate whose map side
   already shrinks to ``heavy`` rows per task. At most ``heavy`` winners are broadcast, so the
   copies of a frequent text are decided where they lie and never meet in one task.
4. All other digests go through ordinary shuffling: an aggregate with a map side, and a join back
   whose rows of one digest Spark can split over tasks.

Defined results: a null text counts as empty. Among equal texts the smallest id stays; a null
id loses to any other. Of wholly repeated rows exactly one stays. An empty table gives no rows.
Further columns, whatever their names and case, are not read, and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.runtime import few_bytes, settle

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: At most so many digests are broadcast (64 hex digits, an id and a count each: under 64 KB).
HEAVY = 256
#: Counters of a Misra-Gries summary.
TRACKED = 2048
#: Summaries are merged in so many groups before the last merge.
MERGE_GROUPS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def frequent_digests(digests: DataFrame, column: str, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """At most ``heavy`` values of ``column``, among them each with over rows/tracked copies as far as ``heavy`` allows."""
    parts = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("sketch")
    )
    # grouped by a constant, since a global aggregate cannot merge the buffers of tasks without rows
    whole = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {heavy})")).alias("hit"))
    return found.where(F.col("hit.count") > 1).select(F.col("hit.item").alias(column))


def _first() -> Column:
    """The row that stays of equal texts: the smallest id, a null id last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = [F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest(F.col(text_col)).alias("digest")]
    return settle(docs.select(own), "digests")


def verified_winners(narrow: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """(digest, first, group_size) of at most ``heavy`` frequent digests, counted exactly."""
    frequent = settle(frequent_digests(narrow, "digest", heavy, tracked), "frequent-digests")
    own = narrow.join(F.broadcast(frequent), "digest", "left_semi")
    return settle(own.groupBy("digest").agg(_first().alias("first"), F.count("*").alias("group_size")), "winners")


def _rare(narrow: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of all other digests with first and group_size."""
    rows = narrow.join(F.broadcast(winners), "digest", "left_anti")
    groups = rows.groupBy("digest").agg(_first().alias("first"), F.count("*").alias("group_size"))
    # a key of its own, in bytes, so that the join does not happen where the groups were counted: it could not be split there
    groups = groups.select(F.unhex("digest").alias("key"), "first", "group_size")
    return rows.withColumn("key", F.unhex("digest")).join(groups, "key").drop("key")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = _digests(docs, id_col, text_col)
    winners = verified_winners(narrow, heavy, tracked)
    sha256 = F.col("digest").alias("text_sha256")
    shape = ["doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), sha256]
    common = narrow.join(F.broadcast(winners), "digest")
    return common.select(*shape).unionByName(_rare(narrow, winners).select(*shape))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep; all its columns stay as they are.

    Copies of frequent texts go where they lie. Of the others the (id, digest) pairs that go are
    taken away by a join, broadcast if they are few bytes; whole documents are shuffled only if not.
    """
    narrow = _digests(docs, id_col, text_col)
    winners = verified_winners(narrow, heavy, tracked)
    own, name, hot, first, place = (_unused(docs, x) for x in ("_digest", "_id", "_hot", "_first", "_place"))
    marked = docs.withColumns({own: digest(F.col(text_col)), name: F.coalesce(F.col(id_col).cast("string"), F.lit(""))})
    told = F.broadcast(winners.select(F.col("digest").alias(hot), F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias(first)))
    left = marked.join(told, F.col(own) == F.col(hot), "left")
    left = left.where(F.col(hot).isNull() | (F.col(name) == F.col(first))).drop(hot, first)
    rare = _rare(narrow, winners).select("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("first_id"))
    gone = settle(rare.where("id <> first_id").select("digest", "id"), "gone")
    left = _without(left, gone, own, name)
    # what is left of a text has one id; rows that repeat it are told apart by their places alone
    kept = narrow.groupBy("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    again = settle(_without(kept.select("digest", "id"), gone, "digest", "id"), "repeated")
    if again.isEmpty():
        return left.select(docs.columns)
    once = _meeting(left, again, own, name, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(own, name).orderBy(F.lit(0)))).where(F.col(place) == 1)
    return _without(left, again, own, name).select(docs.columns).unionByName(once.select(docs.columns))


def _meeting(rows: DataFrame, pairs: DataFrame, digest_col: str, id_col: str, how: str) -> DataFrame:
    """``rows`` that have, or have not, one of the (digest, id) pairs; these are broadcast if they are few bytes."""
    a, b = _unused(rows, "_a"), _unused(rows, "_b")
    pairs = (F.broadcast(pairs) if few_bytes(pairs) else pairs).toDF(a, b)
    return rows.join(pairs, (F.col(digest_col) == F.col(a)) & (F.col(id_col) == F.col(b)), how)


def _without(rows: DataFrame, pairs: DataFrame, digest_col: str, id_col: str) -> DataFrame:
    return _meeting(rows, pairs, digest_col, id_col, "left_anti")


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in no case."""
    known = {c.lower() for c in docs.columns}
    while name in known:
        name += "_"
    return name
