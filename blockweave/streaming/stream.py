"""Stateless Structured Streaming: blobs in, archives out, and back.

A stream encodes every blob in fixed blocks of its own and never refers to earlier ones, so a
micro-batch needs nothing from the ones before it; archives with references are refused when a
stream is decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from blockweave import api
from blockweave.operators import frame
from blockweave.operators.codec import _archives, _map


def encode_stream(blobs: DataFrame, block_size: int = frame.DEFAULT_BLOCK) -> DataFrame:
    """(blob_id, archive) of a streaming or static DataFrame of blobs."""
    frame.check_block_size(block_size)

    def work(columns):
        yield from zip(columns["blob_id"], api.compress_fixed(columns["data"], block_size))

    return _map(blobs.where("data IS NOT NULL").select("blob_id", "data"), "data", work, "blob_id long, archive binary")


def decode_stream(archives: DataFrame, limit: int | None = None) -> DataFrame:
    """(blob_id, data, status); what was decoded before a refusal is kept, as a stream has passed it on already."""

    def work(ids, found):
        for blob_id, (data, status) in zip(ids, api.decompress_streams(found, limit)):
            yield blob_id, data, status

    return _archives(archives, work, "blob_id long, data binary, status string")


def blob_source(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_to_end(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now as Parquet, exactly once, and stops."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
