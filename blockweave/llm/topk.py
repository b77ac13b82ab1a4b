"""Exact top-k inner products by columnar branch-and-bound.

Vectors are held vertically (one row of the matrix per dimension). For a bounded block of
queries, each task walks its candidates in blocks: scores grow dimension block by dimension
block, and after each one a candidate survives only while its score so far plus the most that
the rest can add (Cauchy-Schwarz on the remaining mass of both sides) can still reach the
query's current k-th score. The survivors are compacted before the next dimension block.

Query blocks have a fixed number of rows, so what is broadcast has a fixed size; each block
is one pass over the candidates. Tasks give at most k rows per query, merged by a ranking.

Scores are exact. While the norms of both sides prove that every sum stays below 2**53, floating
point holds whole numbers as they are; beyond that it only prunes, with a slack for its rounding,
and survivors are scored in whole numbers, of any size if need be.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without an id. Only vectors of one length are compared. Ties go to the smaller
id; repeated ids are all candidates and only rows with the query's own id are left out. A query
row that is wholly repeated counts once; rows with one id and different vectors are queries of
their own. A component of 2**62 or more, or a score beyond 64 bits, is refused with an error.
Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.runtime import settle

SCALE = 64
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
DIMENSION_BLOCK = 16
HIT = "row long, query_id long, vec_id long, score long"
#: Below this a sum of products is the same in floating point, and in 64 bits.
FLOAT_EXACT, LONG_EXACT = 2.0**52, 2.0**62


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id and floor(scale * x) of every sound vector."""
    sound = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector_col, lambda x: x.cast("double") * F.lit(float(scale)))
    refused = F.raise_error(F.lit("a component is too large for whole numbers of 64 bits")).cast("long")
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < F.lit(LONG_EXACT), F.floor(x)).otherwise(refused))
    return vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).alias("vec_id"), whole.alias("v"))


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and the vertical matrix (dimension x row) of whole numbers of the rows with ``width`` components."""
    ids, vectors = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
    lengths = np.diff(vectors.offsets.to_numpy())
    right = lengths == width
    if not right.all():
        vectors, ids = vectors.filter(pa.array(right)), ids[right]
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return ids.astype(np.int64), np.ascontiguousarray(flat.reshape(len(ids), width).T)


def _rest(m: np.ndarray, step: int) -> np.ndarray:
    """Norm of what lies behind each dimension block; first of all, behind none."""
    squares = np.stack([(m[i : i + step] ** 2).sum(axis=0) for i in range(0, len(m), step)])
    return np.sqrt(np.vstack([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, m.shape[1]))]))


class TopK:
    """The best k so far of each query of a block, fed with blocks of candidates."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, k: int, step: int = DIMENSION_BLOCK):
        self.ids, self.whole, self.q, self.k, self.step = ids, columns, columns.astype(np.float64), k, step
        self.rest = _rest(self.q, step)
        self.norms = self.rest[0]
        self.floor = np.full(len(ids), -np.inf)
        self.scores: list[list[int]] = [[] for _ in range(len(ids))]
        self.names: list[list[int]] = [[] for _ in range(len(ids))]

    def feed(self, ids: np.ndarray, columns: np.ndarray, group: int = 64) -> None:
        floats, d = columns.astype(np.float64), self.step
        rest = _rest(floats, d)
        for at in range(0, len(self.ids), group):
            part = slice(at, at + group)
            q, floor = self.q[:, part], self.floor[part]
            who, what, whole = ids, floats, columns
            largest = float(self.norms[part].max() * rest[0].max())
            # what rounding may take from a bound or a sum
            slack = 0.25 + largest * (len(q) + 8) * 2.0**-52
            done = q[:d].T @ what[:d]
            bound = rest
            for b in range(1, len(rest)):
                alive = done + self.rest[b][part][:, None] * bound[b][None, :] + slack >= floor[:, None]
                some = alive.any(axis=0)
                if not some.all():
                    who, what, whole, done, bound, alive = who[some], what[:, some], whole[:, some], done[:, some], bound[:, some], alive[:, some]
                if b == len(rest) - 1 or not len(who):
                    break
                done = done + q[b * d : (b + 1) * d].T @ what[b * d : (b + 1) * d]
            if len(who):
                self._merge(at, who, self._exact(part, whole, done, alive, largest), alive)

    def _exact(self, part: slice, whole: np.ndarray, done: np.ndarray, alive: np.ndarray, largest: float) -> np.ndarray:
        """Scores as whole numbers; those of pairs that are not alive may be anything."""
        if largest < FLOAT_EXACT:
            return done.astype(np.int64)
        if largest < LONG_EXACT:
            return self.whole[:, part].T @ whole
        out = np.zeros(done.shape, object)
        for i, j in zip(*np.nonzero(alive)):
            out[i, j] = sum(a * b for a, b in zip(self.whole[:, part][:, i].tolist(), whole[:, j].tolist()))
        return out

    def _merge(self, at: int, who: np.ndarray, scores: np.ndarray, alive: np.ndarray) -> None:
        for i in range(len(scores)):
            j, k = at + i, self.k
            ok = np.flatnonzero(alive[i] & (who != self.ids[j]))
            if not len(ok):
                continue
            own, names = scores[i, ok], who[ok]
            if len(ok) > 4 * k and own.dtype == np.int64:  # all ties with the k-th stay for the exact order below
                near = own >= np.partition(own, len(own) - k)[len(own) - k]
                own, names = own[near], names[near]
            best = sorted(zip([-s for s in self.scores[j]] + [-s for s in own.tolist()], self.names[j] + names.tolist()))[:k]
            self.scores[j], self.names[j] = [-s for s, _ in best], [n for _, n in best]
            if len(best) == k:
                self.floor[j] = np.nextafter(float(self.scores[j][-1]), -np.inf)

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        """HIT rows; ``names`` tells query rows apart."""
        counts = [len(x) for x in self.names]
        flat = [x for own in self.scores for x in own]
        if any(not -(1 << 63) <= x < 1 << 63 for x in flat):
            raise OverflowError("a score is beyond 64 bits")
        columns = [np.repeat(names, counts), np.repeat(self.ids, counts), np.array([x for own in self.names for x in own], np.int64), np.array(flat, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``vectors``; both are (vec_id long, v array of whole numbers)."""
    spark = vectors.sparkSession
    vectors = settle(vectors, "vectors")
    numbered = settle(queries.dropDuplicates(["vec_id", "v"]).withColumn("row", F.monotonically_increasing_id()), "queries")
    # blocks of equal vector length and at most query_block rows: the counts are one row per length
    blocks = []
    for width, rows in sorted((r["w"], r["n"]) for r in numbered.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()):
        n = -(-rows // query_block) * 2 if rows > query_block else 1
        blocks += [(width, n, b) for b in range(n)]
    found = None
    for width, n, b in blocks:
        block = numbered.where((F.size("v") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b))
        table = block.toArrow()  # about query_block rows of one length
        if not table.num_rows:
            continue
        held = spark.sparkContext.broadcast(table.combine_chunks().to_batches()[0])

        def search(batches: Iterator[pa.RecordBatch], held=held, width=width) -> Iterator[pa.RecordBatch]:
            best = TopK(*_matrix(held.value, width), k)
            names = held.value.column("row").to_numpy()
            for batch in batches:
                for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                    ids, columns = _matrix(batch.slice(at, CANDIDATE_BLOCK), width)
                    if len(ids):
                        best.feed(ids, columns)
            yield best.rows(names)

        hits = vectors.mapInArrow(search, HIT)
        if len(blocks) > 1:  # one pass at a time, so that one block of queries is held at a time
            hits = settle(hits, "hits")
            held.unpersist()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], HIT)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
