"""Byte-level relations: one row per byte, and predictors as window functions over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from blockweave.operators.matching import FIRST, SECOND
from blockweave.operators.predict import SLOTS


#: Rows of an Arrow batch of single bytes.
BYTES_AT_ONCE = 1 << 16


def byte_rows(df: DataFrame, keys: list[str], data: str, together: bool = False) -> DataFrame:
    """(keys, pos, b): every byte of a binary column with its place from 0; empty values have no rows.

    For looking at bytes with SQL; what is asked of whole blobs is cheaper in ``operators.profile``.
    With ``together`` the values are dealt by ``keys`` before they are taken apart. Windows over
    ``keys``, alone or with more columns, then need no shuffle of single bytes.
    """
    if together:
        df = df.select(*keys, data).repartition(*keys)
    df = df.select(*keys, data)
    names = [*keys, "pos", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(len(keys))[i]
                if not value.is_valid:
                    continue
                x = np.frombuffer(value.as_buffer(), np.uint8)
                for at in range(0, len(x), BYTES_AT_ONCE):
                    part = x[at : at + BYTES_AT_ONCE].astype(np.int32)
                    own = [pa.repeat(batch.column(k)[i], len(part)) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part)], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields[: len(keys)], StructField("pos", IntegerType()), StructField("b", IntegerType())]))


def in_order(keys: list[str], at: str = "pos"):
    return Window.partitionBy(*keys).orderBy(at)


def with_predictions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the wrapping difference and the exclusive-or with the byte before; the first byte keeps its value."""
    before = F.lag("b", 1, 0).over(in_order(keys))
    return rows.withColumns({"delta": F.pmod(F.col("b") - before, F.lit(256)), "xored": F.col("b").bitwiseXOR(before)})


def with_inverses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of predictions with the bytes that prefix sums make of them again."""
    so_far = in_order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"from_delta": F.pmod(F.sum("delta").over(so_far), F.lit(256)).cast("int"), "from_xored": F.bit_xor("xored").over(so_far)})


def hash3(a: Column, b: Column, c: Column) -> Column:
    """The hash of three bytes that matching and scoring group places by."""
    return (a * FIRST).bitwiseXOR(b * SECOND).bitwiseXOR(c)


def trigrams(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, pos, h, t): hash and content of the three bytes from each place on."""
    w = in_order(keys)
    b, c = F.lead(value, 1).over(w), F.lead(value, 2).over(w)
    out = rows.select(*keys, "pos", hash3(F.col(value), b, c).alias("h"), (F.col(value) * 65536 + b * 256 + c).alias("t"))
    return out.where(F.col("t").isNotNull())


def scores(rows: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """(keys, into): places whose latest predecessor with the same 12-bit hash holds the same three bytes."""
    tri = trigrams(rows, keys, value).withColumn("slot", F.col("h").bitwiseAND(SLOTS - 1))
    before = F.lag("t").over(Window.partitionBy(*keys, "slot").orderBy("pos"))
    return tri.withColumn("same", before == F.col("t")).groupBy(*keys).agg(F.count_if("same").alias(into))


def entropy_bits(counts: DataFrame, within: list[str], count: str = "n") -> DataFrame:
    """(within, bits): Shannon entropy of counts, summed over all symbols."""
    total = F.sum(count).over(Window.partitionBy(*within)) if within else F.sum(count).over(Window.partitionBy(F.lit(0)))
    each = counts.withColumn("each", -F.col(count) * F.log2(F.col(count) / total))
    return each.groupBy(*within).agg(F.sum("each").alias("bits"))


def canonical_codes(lengths: DataFrame, within: list[str], longest: int = 24) -> DataFrame:
    """``lengths`` (within, symbol, length) with code: shorter codes first, then by symbol, as prefix sums of shares."""
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = w.orderBy("length", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    share = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(longest) - F.col("length"))
    start = F.coalesce(F.sum(share).over(before), F.lit(0).cast("long"))
    return lengths.withColumn("code", F.call_function("shiftright", start, F.lit(longest) - F.col("length")))


def candidate_counts(rows: DataFrame, keys: list[str], candidates: int = 16, window: int = 65_535) -> DataFrame:
    """(keys, pos, candidates, nearest): earlier places with the same hash that a match may start from, and the distance of the nearest."""
    same = Window.partitionBy(*keys, "h").orderBy("pos")
    tri = trigrams(rows, keys, "b")
    near = [F.when(F.col("pos") - F.lag("pos", k).over(same) <= window, 1).otherwise(0) for k in range(1, candidates + 1)]
    total = near[0]
    for x in near[1:]:
        total = total + x
    distance = F.col("pos") - F.lag("pos").over(same)
    return tri.select(*keys, "pos", total.alias("candidates"), F.when(distance <= window, distance).alias("nearest"))
