"""Statistics of measured runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.runtime import settle


def quantiles(runs: DataFrame, by: list[str], measure: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column per share): exact quantiles of a measure, interpolated; nulls do not count.

    Equal values are counted first, with a map side. The counts are dealt by ranges, so a running
    sum needs the rows of one range and one number per group and range for those before it; a
    group of any size is spread over many tasks and never held by one.
    """
    counts = runs.where(F.col(measure).isNotNull()).groupBy(*by, measure).agg(F.count("*").alias("_n"))
    counts = settle(counts.repartitionByRange(*by, measure).withColumn("_part", F.spark_partition_id()), "counts")
    parts = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_own"))  # groups and ranges only
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_own").over(earlier), F.lit(0)), "n": F.sum("_own").over(Window.partitionBy(*by))})
    keys = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*by, "_part")]
    joined = counts.alias("c").join(parts.alias("p"), reduce(and_, keys)).select("c.*", "p._before", "p.n")
    inside = Window.partitionBy(*by, "_part").orderBy(measure).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.withColumn("_to", F.col("_before") + F.sum("_n").over(inside))
    own = (F.col("_to") - F.col("_n"), F.col("_to"))
    out = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        value = [F.max(F.when((own[0] <= place) & (place < own[1]), F.col(measure))).cast("double") for place in (low, high)]
        out += [value[0].alias(f"_low_{name}"), value[1].alias(f"_high_{name}")]
    found = placed.groupBy(*by, "n").agg(*out)
    rest = {name: F.lit(float(share)) * (F.col("n") - 1) - F.floor(F.lit(float(share)) * (F.col("n") - 1)) for name, share in shares.items()}
    return found.select(*by, "n", *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * r).alias(n) for n, r in rest.items()])


def summary(runs: DataFrame, by: list[str], measure: str) -> DataFrame:
    """(by, n, median, q1, q3, least, most, iqr) of a measure, with interpolated percentiles."""
    found = quantiles(runs, by, measure, {"median": 0.5, "q1": 0.25, "q3": 0.75, "least": 0.0, "most": 1.0})
    return found.withColumn("iqr", F.col("q3") - F.col("q1"))


def throughput(runs: DataFrame, n_bytes: str, seconds: str) -> DataFrame:
    """``runs`` with mib_per_second; null where no time passed."""
    return runs.withColumn("mib_per_second", F.when(F.col(seconds) > 0, F.col(n_bytes) / (1 << 20) / F.col(seconds)))
