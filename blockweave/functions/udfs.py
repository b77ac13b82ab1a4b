"""The codec as SQL functions over binary columns, in Arrow batches.

``bw_compress(data)``, ``bw_decompress(archive)`` (null where an archive is refused),
``bw_status(archive)`` ("ok" or why it is refused) and ``bw_original_size(archive)``. Filters on
their results run them again; settle a result that is used more than once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StringType

from blockweave import api
from blockweave.operators.errors import CodecError


def _tried(call, otherwise):
    def one(x):
        if x is None:
            return None
        try:
            return call(bytes(x))
        except CodecError as e:
            return otherwise(e)

    return one


@pandas_udf(BinaryType())
def compress(data: pd.Series) -> pd.Series:
    return data.map(_tried(api.compress, lambda e: None))


@pandas_udf(BinaryType())
def decompress(archive: pd.Series) -> pd.Series:
    return archive.map(_tried(api.decompress, lambda e: None))


@pandas_udf(StringType())
def status(archive: pd.Series) -> pd.Series:
    return archive.map(_tried(lambda x: "ok" if api.check(x) >= 0 else None, lambda e: e.status))


@pandas_udf(LongType())
def original_size(archive: pd.Series) -> pd.Series:
    return archive.map(_tried(lambda x: api.info(x)["original_size"], lambda e: None)).astype("Int64")


def register(spark: SparkSession) -> list[str]:
    """Registers the functions with a session; returns their names."""
    found = {"bw_compress": compress, "bw_decompress": decompress, "bw_status": status, "bw_original_size": original_size}
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
