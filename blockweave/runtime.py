"""Session helpers shared by every operator: reading tables, cutting lineage, sizing shuffles."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark only (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, ``spark.checkpoint.dir``.

    Where the setting is absent only a local master may fall back to the machine's own
    temporary folder; a cluster without it is refused, because executors could not read
    each other's files. The folder goes when the driver's Python ends, or by ``clean``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    folder = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        _folders[folder] = path.getFileSystem(spark._jsc.hadoopConfiguration()), path
    return folder


#: folders of the applications of this process, with what deletes them
_folders: dict[str, tuple] = {}


def clean() -> None:
    """Deletes what was settled so far; DataFrames that read it are of no use afterwards."""
    while _folders:
        _, (store, path) = _folders.popitem()
        store.delete(path, True)


@atexit.register
def _clean_at_end() -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        clean()


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that survive the loss of an executor, and it lets a
    costly stage be read several times with column pruning instead of being run again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, keys: list[str], order: list[str], into: str = "nth") -> DataFrame:
    """``rows`` with their place, from 1, among those of equal keys (nulls are equal); ``order`` is total.

    Rows are dealt by ranges of keys and order, so one key with very many rows is spread over
    tasks; each range needs only the number of rows of its first key before it.
    """
    dealt = settle(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_own"))  # keys and ranges only
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.sum("_own").over(earlier)).where("_before > 0").drop("_own").alias("s")
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).alias("d")
    same = reduce(and_, [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_part")])
    found = placed.join(starts, same, "left")
    return found.select(*[F.col(f"d.{c}") for c in rows.columns], (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("long").alias(into))


#: Bytes of a table that may be broadcast.
BROADCAST = 48 << 20


def few_bytes(df: DataFrame, most: int = BROADCAST) -> bool:
    """Whether all values of ``df`` (settled, or cheap to read) take at most ``most`` bytes, counted."""

    def width(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(column) + 16
        if isinstance(kind, T.ArrayType):
            inner = len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1
            return F.size(column) * 8 * (inner + 2) + 16
        return F.lit(8)

    each = sum((F.coalesce(width(F.col(f.name), f.dataType), F.lit(8)) for f in df.schema), F.lit(32))
    return (df.agg(F.sum(each.cast("long"))).first()[0] or 0) <= most


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all cores if it comes from fewer files than there are.

    For work that costs far more than moving its rows: a file may be one row group, which no scan
    divides. A table of many files, as any large one is, stays as it is and is not shuffled. The files
    are counted in the JVM, which has them from planning the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df._jdf.inputFiles()) >= cores else df.repartition(3 * cores, *keys)
