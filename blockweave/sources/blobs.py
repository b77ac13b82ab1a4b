"""Blobs from tables and files, and archives into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_memory(spark: SparkSession, items: list[bytes]) -> DataFrame:
    """(blob_id, data, n_bytes) of byte strings in hand."""
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(items)], "blob_id long, data binary")
    return with_size(df)


def from_text(df: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """(blob_id, data, n_bytes, more): the UTF-8 bytes of a text column; a null text is an empty blob."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return with_size(df.select(F.col(key).cast("long").alias("blob_id"), data.alias("data"), *more))


def from_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, blob_id, data, n_bytes) of files; blob_id is a hash of the path. Spark's scan passes over empty files."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(path).select("path", F.xxhash64("path").alias("blob_id"), F.col("content").alias("data"))
    return with_size(df)


def with_size(df: DataFrame, data: str = "data") -> DataFrame:
    return df.withColumn("n_bytes", F.octet_length(F.col(data)).cast("long"))


def concatenated(df: DataFrame, group: Column, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(blob_id, data, n_bytes): texts joined in order within groups, which must be of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    whole = df.groupBy(group.alias("blob_id")).agg(parts.alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    return with_size(whole.select("blob_id", joined.cast("binary").alias("data")))


def write_archives(archives: DataFrame, path: str) -> None:
    """Archives as Parquet; the commit protocol leaves nothing half written. A path that is being read is refused by Spark."""
    archives.write.mode("overwrite").parquet(path)
