"""K-d tree sharding: split at weighted medians along the widest metadata dimension.

The tree has one leaf per target amount of bytes. A level splits all its nodes together: each
node takes the dimension in which its rows spread widest, relative to the spread of the whole
table, and is cut where the bytes before the cut are nearest to its left leaves' share. Equal
values are ordered by a hash of the id, so a value that holds a third of all rows can be cut
through. The cut is exact. While nodes are few and large, histograms of a fixed number of buckets
narrow the range around it until one value is left, and only bucket sums reach the driver; once
there are over ``FEW`` nodes, each is small enough for a running sum over its sorted rows. Both
give the same cut, and the number of leaves has no limit: the driver holds one entry for each.

Text is read once, for its size and checksum; all passes after that read a narrow table. Whole
numbers, dates and timestamps (by the microsecond) count as they are, any other dimension by the
exact ranks of its distinct values, which a range partitioning numbers without one task that sees
all of them.

Defined results: a null text has no bytes; sizes count one more than the bytes, so empty texts
weigh too. A null in a dimension counts as its smallest value. Repeated rows are rows of their
own. With fewer rows than leaves some shards stay empty; an empty table gives no rows. Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockweave.runtime import settle

#: Histogram buckets of one round over all nodes together; the driver holds no more rows.
BUCKETS = 1 << 15
#: Rows of a shard are numbered in so many blocks.
SLOT_BLOCKS = 1024
#: Nodes of a level whose cuts are searched by histograms; more of them are cut by running sums.
FEW = 256


def coordinate(column: Column, kind: T.DataType) -> Column | None:
    """A metadata value as a whole number in its order; none if only its rank is one."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(column.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        number = F.unix_date(column).cast("long")
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        number = column.cast("long")
    else:
        return None
    return F.coalesce(number, F.lit(0).cast("long"))


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the values of ``column`` replaced by their ranks among the distinct ones; null has the smallest."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    values = settle(values.withColumn("at", F.monotonically_increasing_id()), "ranks")  # partition and place in it
    part = F.shiftright("at", 33)
    starts, before = [], 0
    for r in sorted(values.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts.append((r["part"], before))
        before += r["n"]
    table = rows.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranks = values.withColumn("part", part).join(F.broadcast(table), "part").select(column, rank.alias("rank"))
    return rows.join(ranks, column, "left").withColumn(column, F.coalesce("rank", F.lit(0).cast("long"))).drop("rank")


class _Node:
    """A node whose cut is being searched: leaves on both sides, and the range that still holds the cut."""

    def __init__(self, name: int, first: int, leaves: int, dimension: int, weight: int, low: int, high: int):
        self.name, self.first, self.leaves, self.dimension = name, first, leaves, dimension
        self.goal = weight * (leaves // 2) / leaves
        self.before, self.low, self.high = 0, low, high
        self.value: int | None = None  # once the value is known, low and high bound the tie's hash
        self.done = False

    def cut(self) -> tuple[int, int]:
        return (self.low, -1) if self.value is None else (self.value, self.low)

    def narrow(self, buckets: list[tuple[int, int, int]]) -> None:
        """buckets: (weight, least, greatest) in order."""
        for weight, least, greatest in buckets:
            if self.before + weight >= self.goal or (weight, least, greatest) == buckets[-1]:
                self.low, self.high = least, greatest
                break
            self.before += weight
        if self.low == self.high:
            if self.value is None:
                self.value, self.low, self.high = self.low, 0, (1 << 31) - 1
            else:
                if self.before + weight - self.goal > self.goal - self.before:
                    self.low -= 1  # nearer without the straddling row
                self.done = True


def kd_shards(rows: DataFrame, dimensions: list[str], weight: str, leaves: int | None = None, target_bytes: int | None = None, tie: str = "tie") -> DataFrame:
    """``rows`` with a column shard. ``dimensions`` and ``tie`` are long columns, tie from 0 to 2**31 - 1."""
    total, *_ = rows.agg(F.sum(weight)).first()
    if leaves is None:
        leaves = max(1, -(-(total or 0) // (target_bytes or 1)))
    placed = rows.withColumn("node", F.col(tie).bitwiseAND(F.lit(0)).cast("int"))  # not a constant, so that joins stay hash joins
    if not total or leaves == 1:
        return placed.withColumnRenamed("node", "shard")
    nodes = {0: (0, leaves)}  # name: first leaf, leaves
    spread: list[int] | None = None
    while any(n > 1 for _, n in nodes.values()):
        open_nodes = sorted(k for k, (_, n) in nodes.items() if n > 1)
        ends = [f(d).alias(f"{f.__name__}{i}") for i, d in enumerate(dimensions) for f in (F.min, F.max)]
        stats = placed.where(F.col("node").isin(open_nodes) if len(open_nodes) < 64 else F.lit(True)).groupBy("node").agg(F.sum(weight).alias("w"), *ends).collect()
        search = []
        for r in stats:
            if nodes[r["node"]][1] < 2:
                continue
            widths = [r[f"max{i}"] - r[f"min{i}"] for i in range(len(dimensions))]
            spread = spread or widths
            best = max(range(len(dimensions)), key=lambda i: (widths[i] / spread[i] if spread[i] else 0, -i))
            search.append(_Node(r["node"], *nodes[r["node"]], best, r["w"], r[f"min{best}"], r[f"max{best}"]))
        halves = {n.name: nodes[n.name][1] // 2 for n in search}
        if len(search) > FEW:
            placed = settle(_cut_by_sums(placed, dimensions, weight, tie, search, {k: nodes[k][0] + h for k, h in halves.items()}), "nodes")
            _halve(nodes)
            continue
        _find_cuts(placed, dimensions, weight, tie, search)
        cuts = {n.name: (n.dimension, *n.cut()) for n in search}
        shape = "node int, dimension int, cut_value long, cut_tie long"
        table = rows.sparkSession.createDataFrame([(k, *v) for k, v in cuts.items()], shape)
        value = F.element_at(F.array(*dimensions), F.col("dimension") + 1)
        right = (value > F.col("cut_value")) | (value == F.col("cut_value")) & (F.col(tie) > F.col("cut_tie"))
        # a node keeps its name on the left; the right side takes the number of its first leaf
        moved = rows.sparkSession.createDataFrame([(k, nodes[k][0] + h) for k, h in halves.items()], "node int, right_node int")
        placed = placed.join(F.broadcast(table.join(moved, "node")), "node", "left")
        placed = placed.withColumn("node", F.when(F.col("dimension").isNotNull() & right, F.col("right_node")).otherwise(F.col("node"))).drop("dimension", "cut_value", "cut_tie", "right_node")
        placed = settle(placed, "nodes")
        _halve(nodes)
    return placed.withColumnRenamed("node", "shard")


def _halve(nodes: dict[int, tuple[int, int]]) -> None:
    """Every node of several leaves keeps its left half; the right one is a node of its own."""
    for k, (first, n) in list(nodes.items()):
        if n > 1:
            h = n // 2
            nodes[k], nodes[first + h] = (first, h), (first + h, n - h)


def _cut_by_sums(placed: DataFrame, dimensions: list[str], weight: str, tie: str, search: list[_Node], right: dict[int, int]) -> DataFrame:
    """``placed`` with the rows behind the cut of each node in its right half."""
    rows = [(n.name, n.dimension, float(n.goal), right[n.name]) for n in search]
    table = placed.sparkSession.createDataFrame(rows, "node int, dimension int, goal double, right_node int")
    own = placed.join(F.broadcast(table), "node", "left")  # one small row per node
    own = own.withColumn("at", F.element_at(F.array(*dimensions), F.coalesce("dimension", F.lit(0)) + 1))
    so_far = Window.partitionBy("node").orderBy("at", tie).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns({"upto": F.sum(weight).over(so_far), "equal": F.sum(weight).over(Window.partitionBy("node", "at", tie))})
    before = F.col("upto") - F.col("equal")
    # the rows on which the goal falls go where they leave it nearer
    left = (F.col("upto") < F.col("goal")) | (before < F.col("goal")) & (F.col("upto") - F.col("goal") <= F.col("goal") - before)
    moved = F.when(F.col("right_node").isNotNull() & ~left, F.col("right_node")).otherwise(F.col("node"))
    return own.withColumn("node", moved).select(placed.columns)


def _find_cuts(placed: DataFrame, dimensions: list[str], weight: str, tie: str, search: list[_Node]) -> None:
    spark = placed.sparkSession
    while open_nodes := [n for n in search if not n.done]:
        each = max(2, BUCKETS // len(open_nodes))
        # a bucket's width, so that ``each`` of them cover the range
        ranges = [(n.name, n.dimension, n.value, n.low, n.high, (n.high - n.low) // each + 1) for n in open_nodes]
        table = spark.createDataFrame(ranges, "node int, dimension int, value long, low long, high long, width long")
        value = F.element_at(F.array(*dimensions), F.col("dimension") + 1)
        at = F.when(F.col("value").isNull(), value).otherwise(F.col(tie))
        inside = (F.col("value").isNull() | (value == F.col("value"))) & at.between(F.col("low"), F.col("high"))
        buckets = (
            placed.join(F.broadcast(table), "node")
            .where(inside)
            .groupBy("node", F.floor((at - F.col("low")) / F.col("width")).alias("bucket"))
            .agg(F.sum(weight).alias("w"), F.min(at).alias("least"), F.max(at).alias("greatest"))
            .collect()
        )
        found: dict[int, list] = {n.name: [] for n in open_nodes}
        for r in sorted(buckets, key=lambda r: (r["node"], r["bucket"])):
            found[r["node"]].append((r["w"], r["least"], r["greatest"]))
        for n in open_nodes:
            n.narrow(found[n.name])


def numbered(shards: DataFrame, order: list[str], leaves: int) -> DataFrame:
    """``shards`` with slot: a gapless number per shard, from counts of a fixed number of blocks."""
    shards = shards.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(SLOT_BLOCKS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = shards.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    if leaves * SLOT_BLOCKS <= 1 << 17:
        starts = F.broadcast(starts)
    inside = Window.partitionBy("shard", "block").orderBy(*order)
    ranked = shards.withColumn("at", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["shard", "block"]).withColumn("slot", F.col("from") + F.col("at")).drop("block", "at", "from")


def shard_documents(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; the sizes of shards are near equal."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    kinds = {f.name: f.dataType for f in docs.schema}
    own = [d for d in dimensions if d in kinds]
    numbers = {f"axis{i}": coordinate(F.col(d), kinds[d]) for i, d in enumerate(own)}
    unranked = [a for a, c in numbers.items() if c is None]
    axes = {a: F.col(d) if c is None else c for (a, c), d in zip(numbers.items(), own)}
    axes["axis_id"] = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    row = F.monotonically_increasing_id()
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *[c.alias(k) for k, c in axes.items()]
    )
    narrow = settle(narrow.withColumn("tie", F.xxhash64("doc_id", "row").bitwiseAND(F.lit((1 << 31) - 1))), "sizes")
    for axis in unranked:
        narrow = ranked(narrow, axis)
    narrow = settle(narrow, "axes") if unranked else narrow
    placed = kd_shards(narrow, list(axes), "size", leaves=shards)
    out = numbered(placed, ["tie", "doc_id", "row"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
