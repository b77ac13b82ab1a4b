"""Near-duplicates by a multi-index Hamming join over MinHash signatures, confirmed on full sets.

1. Every text gives its set of 5-word shingles and a signature of ``SYMBOLS`` minima of 16 bits.
   Texts with equal sets collapse to one row, by an aggregate with a map side.
2. Two signatures are near if at most ``DISTANCE`` = 26 of the 45 symbols differ. Pigeonhole:
   in 9 chunks of 5 symbols, a near pair differs in at most 2 of some chunk, so each chunk
   enumerates the 10 ways to leave 2 symbols out and is indexed by the 3 others: 90 keys. All
   near pairs share a key. (A pair with a similarity of 0.75 is not near with a chance of 7e-7,
   one with 0.8 with 5e-9.)
3. Rows that are alone under a key go. The others meet by key, with their signatures, and a
   near pair counts under the first key it shares. What leaves a task is one row per key and
   set that takes part, with a link to its local root, never all pairs.
4. The candidates' components meet once more, with their whole texts; the sets of one that is
   too large for a task meet under the keys of step 3 instead. All near pairs that are not yet
   connected are compared exactly, each under the first key it shares, and a local union-find gives at most one link less than there
   are members.
5. Components of the links.

Whether two sets are linked depends on the two alone: on their distance and their similarity, not
on which of these paths compares them. Shingles are compared by two hashes of 64 bits each.

Sizes. A key is dealt over pairs of blocks of at most ``BLOCK`` rows and about ``SHINGLES``
shingles. Sets of a key with many rows meet by size first, since linked sets differ in size by a
quarter at most. A key with over ``HOT`` rows is mostly one text with small changes: one of its
sets becomes a pivot with which all others are compared exactly, in one linear pass. Sets linked
with the pivot are connected by that. Jaccard distance is a metric, so a set over twice the allowed
distance from the pivot links with none of them: only the few between are still paired with them,
the rest of the key goes on without them. Keys so frequent that a sketch of the whole index names
them skip even the window that counts the others. What neither sizes nor pivots part, many
different texts that share a long passage, is dealt over pairs of blocks.

Defined results: an empty or null text has an empty set and is linked with nothing; so is a
row without an id, whose component is null and which is kept. Repeated ids share what their
sets share. An empty table gives no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.components import components
from blockweave.llm.exact_dedup import frequent_digests
from blockweave.llm.shingles import min_hashes, mixed, shingle_sets, slices
from blockweave.runtime import few_bytes, settle

CHUNKS, CHUNK, ERRORS = 9, 5, 2
SYMBOLS = CHUNKS * CHUNK
#: Symbols in which near signatures differ at most: the most that pigeonhole guarantees.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Least similarity of linked sets in percent.
PERCENT = 75
#: Rows, and shingles of their sets, that meet in one task; larger keys are dealt over pairs of such blocks.
BLOCK, SHINGLES = 512, 1 << 19
#: Rows from which a key is met by pivots; rounds of them; a round's pivots have so many shingles in all, which are broadcast (16 bytes each).
HOT, ROUNDS, PIVOT_SHINGLES = 2 * BLOCK, 6, 1 << 20
#: Keys that are met by pivots in a round, at most; and keys that the sketch names.
HOT_KEYS = 4096
FREQUENT = 256
#: Rows of a group from which its signatures are compared symbol by symbol.
LARGE = 48
#: A set with over a HEAVY-th of all rows is named by broadcast.
HEAVY = 512

SUBSETS = [[c * CHUNK + i for i in kept] for c in range(CHUNKS) for kept in combinations(range(CHUNK), CHUNK - ERRORS)]
DIGEST = "doc_id long, n_shingles long, set_hash binary, signature binary"
Sets = list[tuple[np.ndarray, np.ndarray]]


def _sets(first: np.ndarray, second: np.ndarray, bounds: np.ndarray) -> Sets:
    at = bounds.tolist()
    return [(first[a:b], second[a:b]) for a, b in zip(at, at[1:])]


def _digests(sets: Sets) -> list[bytes | None]:
    """A digest of each set; none for an empty one."""
    return [hashlib.blake2b(a.tobytes() + b.tobytes(), digest_size=16).digest() if len(a) else None for a, b in sets]


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    # a minimum is small, so its high bits say little; the bits kept are those of a mix of it
    return (mixed(min_hashes(hashes, bounds, SYMBOLS)) >> np.uint64(48)).astype("<u2")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """DIGEST of every row; set_hash and signature are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in slices(batch.column(1)):
                first, second, bounds = shingle_sets(data, offsets)
                digests = _digests(_sets(first, second, bounds))
                signs = [s.tobytes() if d else None for s, d in zip(_signatures(first, bounds), digests)]
                columns = [batch.column(0).slice(at, rows), pa.array(np.diff(bounds)), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, DIGEST)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), SYMBOLS)


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The 90 keys of each signature: which subset, and its three symbols."""
    columns = []
    for number, kept in enumerate(SUBSETS):
        key = np.full(len(symbols), number, np.uint64)
        for i in kept:
            key = (key << np.uint64(16)) | symbols[:, i].astype(np.uint64)
        columns.append(mixed(key).view(np.int64))
    return np.stack(columns, axis=1)


def index(reps: DataFrame) -> DataFrame:
    """(key, rep, n_shingles) rows of ``reps`` (rep long, n_shingles long, signature binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_symbols(batch.column(2)))
                own = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), keys.shape[1]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *map(pa.array, own)], names=["key", "rep", "n_shingles"])

    return reps.select("rep", "n_shingles", "signature").mapInArrow(run, "key long, rep long, n_shingles long")


def _in_groups(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` on runs of whole groups of a sorted stream, with the end of each row's group; a group may span batches."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate([[0], _marks(table), [table.num_rows]])
        sizes = np.diff(bounds)
        ends = np.repeat(bounds[1:], sizes)
        if (sizes > 1).any() and (out := work(table, ends)) is not None:
            yield from out.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = _marks(pa.Table.from_batches(held[-2:]))
        if not len(last):
            continue
        table = pa.Table.from_batches(held)
        cut = int(_marks(table)[-1])
        yield from done(table.slice(0, cut))
        held = [b for b in table.slice(cut).combine_chunks().to_batches() if b.num_rows]
    if held:
        yield from done(pa.Table.from_batches(held))


def _marks(table: pa.Table) -> np.ndarray:
    """Rows at which a new group begins, but for the first."""
    marks = np.zeros(table.num_rows - 1, bool)
    for k in GROUP:
        values = table.column(k).to_numpy()
        marks |= values[1:] != values[:-1]
    return np.flatnonzero(marks) + 1


#: What meets in a task. ``key`` names the key of the index, ``part`` tells sets of different sizes and sides apart.
GROUP = ["key", "part", "low", "high"]
#: The part of groups whose key names a whole component of candidates; beyond all bands.
WHOLE = 1 << 30


def _blocks(size: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(size) / BLOCK), F.ceil(F.col(shingles) / SHINGLES)).cast("int")


def _band(more: int = 0) -> Column:
    """Sets in bands that are not neighbours differ in size by more than linked ones do."""
    return (F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / PERCENT) * (1 - 1e-9)) + more).cast("int")


def sized(rows: DataFrame) -> DataFrame:
    """``rows`` (key, rep, n_shingles) with size and shingles of their key."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"))
    return rows.join(sizes, "key").select("key", "rep", "n_shingles", "size", "shingles")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (key, rep, n_shingles, size, shingles) as rows (rep, GROUP, block) of bounded groups in which all pairs of a key meet that may be linked.

    A key that is too large for a task is dealt by size into bands, and each band over pairs of
    blocks, so that a task holds two blocks at most. A set goes to the groups of its own band and
    of the next; pairs of one band count in its own group only.
    """
    rows = rows.withColumn("blocks", _blocks("size", "shingles")).drop("size", "shingles")
    zero = F.lit(0)
    small = rows.where("blocks = 1").select("rep", "key", zero.alias("part"), zero.alias("low"), zero.alias("high"), zero.alias("block"))
    banded = rows.where("blocks > 1").select("rep", "key", "n_shingles", F.explode(F.array(_band(), _band(1))).alias("part"), _band().alias("band"))
    # two sides in a group: the band of the group itself, and the one below it
    banded = banded.withColumn("side", (F.col("part") != F.col("band")).cast("int"))
    counts = banded.groupBy("key", "part").agg(F.count_if(F.col("side") == 0).alias("own"), F.sum("n_shingles").alias("shingles"), F.count("*").alias("size"))
    counts = counts.where("own > 0").select("key", "part", _blocks("size", "shingles").alias("blocks"))
    return small.unionByName(_across(banded.join(counts, ["key", "part"])))


def _across(rows: DataFrame) -> DataFrame:
    """Rows (rep, key, part, side, blocks) of groups with two sides, dealt over pairs of blocks: pairs within side 0, and between both sides."""
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # blocks of side 0 are even, those of side 1 odd; a pair of blocks needs one of side 0
    rows = rows.withColumn("block", mine * 2 + F.col("side"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") * 2 - 1)))
    rows = rows.where("block % 2 = 0 OR other % 2 = 0")
    pair = {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    # a block of side 1 meets others only, so its group with itself does not exist; one of side 0 meets itself, too
    return rows.withColumns(pair).select("rep", *GROUP, "block")


class _Forest:
    """Union-find over the rows of a batch."""

    def __init__(self, size: int):
        self.root = list(range(size))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        """The root of every row."""
        root = np.array(self.root)
        while ((further := root[root]) != root).any():
            root = further
        return root


def _pairs(symbols: np.ndarray, block: np.ndarray, apart: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near rows (i, j) of one group, by their distance j - i within a group that is large, and in all others.

    ``ends`` is where each row's group ends. Rows of a group that is ``apart`` pair only across
    its blocks.
    """
    bounds = np.concatenate([[0], np.unique(ends)])
    large = np.diff(bounds) >= LARGE
    for start, end in zip(bounds[:-1][large].tolist(), bounds[1:][large].tolist()):
        # symbol by symbol, so that neighbouring rows lie side by side
        own, side = np.ascontiguousarray(symbols[start:end].T), block[start:end]
        for step in range(1, end - start):
            near = (own[:, :-step] == own[:, step:]).view(np.uint8).sum(axis=0, dtype=np.uint8) >= SYMBOLS - DISTANCE
            if apart[start]:
                near &= side[:-step] != side[step:]
            i = np.flatnonzero(near) + start
            if len(i):
                yield i, i + step
    at = np.flatnonzero(~np.repeat(large, np.diff(bounds)))
    for step in range(1, LARGE):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        i = at[~apart[at] | (block[at] != block[at + step])]
        near = (symbols[i] == symbols[i + step]).sum(axis=1) >= SYMBOLS - DISTANCE
        if near.any():
            yield i[near], i[near] + step


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ``pairs``, some thousands at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for pair in pairs:
        held.append(pair)
        count += len(pair[0])
        if count >= 4096:
            yield tuple(map(np.concatenate, zip(*held)))
            held, count = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _meeting(rows: pa.Table, ends: np.ndarray) -> pa.Table | None:
    """The rows of whole groups that belong to a near pair, each with the root of what it is connected with."""
    rows = rows.combine_chunks()
    forest, takes_part = _Forest(rows.num_rows), np.zeros(rows.num_rows, bool)
    columns = {c: rows.column(c).to_numpy() for c in (*GROUP, "block", "rep")}
    symbols = _symbols(rows.column("signature").chunk(0))
    first, root = _first_keys(symbols, columns["key"]), forest.roots()
    for i, j in _gathered(_pairs(symbols, columns["block"], columns["low"] != columns["high"], ends)):
        own = first(i, j)
        i, j = i[own], j[own]
        takes_part[i] = takes_part[j] = True
        apart = root[i] != root[j]
        if apart.any():
            for a, b in zip(i[apart].tolist(), j[apart].tolist()):
                forest.join(a, b)
            root = forest.roots()
    own = np.flatnonzero(takes_part)
    if not len(own):
        return None
    return pa.table({**{c: v[own] for c, v in columns.items()}, "root": columns["rep"][root[own]]})


def _first_keys(symbols: np.ndarray, key: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells of pairs of rows whether the key under which they meet is the first they share, the one under which a pair counts."""
    keys = _keys(symbols)
    number = (keys == key[:, None]).argmax(axis=1)
    return lambda i, j: (keys[i] == keys[j]).argmax(axis=1) == number[i]


def _shared(mine: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two sets."""
    if len(mine[0]) < len(theirs[0]):
        mine, theirs = theirs, mine
    at = np.minimum(mine[0].searchsorted(theirs[0]), len(mine[0]) - 1)
    return int(((mine[0][at] == theirs[0]) & (mine[1][at] == theirs[1])).sum())


def similar(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= PERCENT * (a + b - shared)


def _linked(rows: pa.Table, ends: np.ndarray) -> pa.Table | None:
    """Links that span what similar sets connect within each group."""
    # a set meets in several groups, mostly in the same task: its text is cut into shingles once
    encoded = rows.column("text").dictionary_encode().unify_dictionaries()
    place = np.concatenate([c.indices.to_numpy() for c in encoded.chunks]).tolist()
    known: Sets = []
    for _, _, data, offsets in slices(encoded.chunk(0).dictionary):
        known += _sets(*shingle_sets(data, offsets))
    digests = _digests(known)
    columns = {c: rows.column(c).to_numpy() for c in (*GROUP, "block", "rep")}
    # an id may stand in several rows: the one with the set that is meant counts
    meant = np.array([digests[k] == digest for k, digest in zip(place, rows.column("set_hash").to_pylist())])
    sets = [known[k] for k in place]
    sizes = np.array([len(first) for first, _ in sets])
    symbols, whole = _symbols(rows.column("signature")), columns["part"] == WHOLE
    first, forest, found = _first_keys(symbols, columns["key"]), _Forest(rows.num_rows), []
    root = forest.roots()
    for i, j in _gathered(_pairs(symbols, columns["block"], columns["low"] != columns["high"], ends)):
        open_ = meant[i] & meant[j] & (root[i] != root[j])
        open_ &= 100 * np.minimum(sizes[i], sizes[j]) >= PERCENT * np.maximum(sizes[i], sizes[j])
        i, j = i[open_], j[open_]
        counts = whole[i] | first(i, j)
        before = len(found)
        for a, b in zip(i[counts].tolist(), j[counts].tolist()):
            if forest.find(a) != forest.find(b) and similar(_shared(sets[a], sets[b]), len(sets[a][0]), len(sets[b][0])):
                forest.join(a, b)
                found.append((a, b))
        if len(found) > before:
            root = forest.roots()
    if not found:
        return None
    at = np.array(found)
    return pa.table({"u": columns["rep"][at[:, 0]], "v": columns["rep"][at[:, 1]]})


def _together(rows: DataFrame) -> DataFrame:
    # a number of tasks, so that few bytes with much work are not put into few tasks
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *GROUP).sortWithinPartitions(*GROUP, "rep")


#: From a pivot: what is linked with it, what may link with that, and what cannot.
LINKED, BETWEEN, BEYOND = 0, 1, 2


def _distances(texts: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(rep, pivot, kind, distance) of ``texts`` (text, rep, set_hash, pivots)."""
    held = texts.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, float]] = []
            reps, wanted, hashes = (batch.column(c).to_pylist() for c in ("rep", "pivots", "set_hash"))
            for at, _, data, offsets in slices(batch.column("text")):
                sets = _sets(*shingle_sets(data, offsets))
                for k, (own, digest) in enumerate(zip(sets, _digests(sets)), at):
                    if digest != hashes[k]:
                        continue
                    for pivot in wanted[k]:
                        other = held.value[pivot]
                        shared, sizes = _shared(own, other), (len(own[0]), len(other[0]))
                        distance = 1 - shared / (sum(sizes) - shared)
                        kind = LINKED if similar(shared, *sizes) else BETWEEN if distance <= 2 * (1 - PERCENT / 100) + 1e-9 else BEYOND
                        out.append((reps[k], pivot, kind, distance))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["rep", "pivot", "kind", "distance"])

    return texts.mapInArrow(run, "rep long, pivot long, kind int, distance double")


def _by_pivots(docs: DataFrame, reps: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Rows (key, rep, n_shingles) of hot keys that are still to be paired; rows of groups with two sides; and links.

    Every round compares the rows of each key with one of its sets, the first in an order that is
    the same for all keys, so that keys have few different pivots. A key goes on while it has over HOT
    rows and loses a tenth of them in a round.
    """
    rows = settle(rows.select("key", "rep", "n_shingles"), "hot-rows")
    done: list[DataFrame] = []
    crossing: list[DataFrame] = []
    links: list[DataFrame] = []
    for number in range(ROUNDS):
        order = F.struct(F.xxhash64("rep", F.lit(number)).alias("h"), "rep", "n_shingles")
        pivots = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(order).alias("pivot")).where(F.col("size") > HOT)
        chosen: list[tuple[int, int, int]] = []
        total: dict[int, int] = {}
        for r in pivots.orderBy(F.col("size").desc(), "key").limit(HOT_KEYS).collect():
            more = 0 if r["pivot"]["rep"] in total else r["pivot"]["n_shingles"]
            if sum(total.values()) + more <= PIVOT_SHINGLES:
                total[r["pivot"]["rep"]] = r["pivot"]["n_shingles"]
                chosen.append((r["key"], r["pivot"]["rep"], r["size"]))
        if not chosen:
            break
        own = rows.sparkSession.createDataFrame(chosen, "key long, pivot long, before long")
        done.append(rows.join(F.broadcast(own), "key", "left_anti"))
        rows = rows.join(F.broadcast(own), "key")
        names = F.broadcast(rows.sparkSession.createDataFrame([(p,) for p in total], "rep long"))
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in _texts(docs, reps.join(names, "rep").select("rep", "doc_id", "set_hash")).toLocalIterator():  # few texts, with PIVOT_SHINGLES shingles in all
            data = np.frombuffer(r["text"].encode(), np.uint8)
            found = _sets(*shingle_sets(data, np.array([0, len(data)])))
            if _digests(found) == [bytes(r["set_hash"])]:
                sets[r["rep"]] = found[0]
        wanted = rows.groupBy("rep").agg(F.collect_set("pivot").alias("pivots"))
        wanted = wanted.join(reps.select("rep", "doc_id", "set_hash"), "rep")
        known = settle(_distances(_texts(docs, wanted), sets).dropDuplicates(["rep", "pivot"]), "distances")  # a row may be repeated
        links.append(known.where((F.col("kind") == LINKED) & (F.col("rep") != F.col("pivot"))).select(F.col("rep").alias("u"), F.col("pivot").alias("v")))
        rows = settle(rows.join(known, ["rep", "pivot"]), "hot-rows")
        # a linked set may link with a set between only if it is far enough from the pivot
        nearest = rows.where(F.col("kind") == BETWEEN).groupBy("key").agg(F.min("distance").alias("nearest"))
        border = rows.where(F.col("kind") <= BETWEEN).join(nearest, "key")
        border = border.where((F.col("kind") == BETWEEN) | (F.col("distance") + (1 - PERCENT / 100) + 1e-9 >= F.col("nearest")))
        crossing.append(border.select("rep", "key", "n_shingles", F.lit(-1 - number).alias("part"), (F.col("kind") == LINKED).cast("int").alias("side")))
        left = rows.groupBy("key").agg(F.count_if(F.col("kind") != LINKED).alias("size"), F.first("before").alias("before"))
        go_on = F.broadcast(settle(left.where(F.col("size") * 10 < F.col("before") * 9).select("key"), "hot-keys"))  # at most HOT_KEYS rows
        rows = rows.where(F.col("kind") != LINKED).select("key", "rep", "n_shingles")
        done.append(rows.join(go_on, "key", "left_anti"))
        rows = rows.join(go_on, "key", "left_semi")
    return _union([*done, rows]), crossing, links


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("key", "rep", "n_shingles")
    for p in parts[1:]:
        out = out.unionByName(p.select("key", "rep", "n_shingles"))
    return out


def _crossing(parts: list[DataFrame]) -> DataFrame:
    """Groups with two sides of which only pairs between the sides are wanted, dealt over pairs of blocks, one of each side."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy("key", "part", "side").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"))
    counts = counts.select("key", "part", "side", _blocks("size", "shingles").alias("blocks"))
    rows = rows.join(counts, ["key", "part", "side"])
    other = counts.select("key", "part", (1 - F.col("side")).alias("side"), F.col("blocks").alias("others"))
    rows = rows.join(other, ["key", "part", "side"])  # a side alone has no pairs
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int") * 2 + F.col("side"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("other", F.col("k") * 2 + 1 - F.col("side"))
    return rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select("rep", *GROUP, "block")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id and more) with the texts of its rows; all texts are read once more."""
    wanted = settle(wanted, "wanted")
    few = few_bytes(wanted)
    return docs.join(F.broadcast(wanted) if few else wanted, "doc_id").drop("doc_id")


def links(docs: DataFrame, reps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v) links between ``reps`` (rep, doc_id, n_shingles, set_hash, signature): sparse, with the same components as all links."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = index(reps)
    frequent = F.broadcast(settle(frequent_digests(keyed, "key", FREQUENT, 8 * FREQUENT), "frequent-keys"))  # at most FREQUENT rows
    own = Window.partitionBy("key")
    counted = keyed.join(frequent, "key", "left_anti").withColumns({"size": F.count("*").over(own), "shingles": F.sum("n_shingles").over(own)})
    paired = settle(counted.where("size > 1"), "shared-keys")
    hot = settle(keyed.join(frequent, "key", "left_semi").unionByName(paired.where(F.col("size") > HOT).select("key", "rep", "n_shingles")), "hot-rows")
    groups = dealt(paired.where(F.col("size") <= HOT))
    found: list[DataFrame] = []
    if not hot.isEmpty():
        rest, crossing, found = _by_pivots(texts, reps, hot)
        groups = groups.unionByName(dealt(sized(settle(rest, "hot-rest")).where("size > 1")))
        if crossing:
            groups = groups.unionByName(_crossing(crossing))
    near = _together(groups.join(reps.select("rep", "signature"), "rep"))
    shape = "key long, part int, low int, high int, block int, rep long, root long"
    meeting = settle(near.mapInArrow(lambda batches: _in_groups(batches, _meeting), shape), "meetings")
    named = settle(components(meeting.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep"), "candidates")
    named = named.join(reps.select("rep", "n_shingles"), "rep")
    sizes = named.groupBy("component").agg(((F.count("*") <= BLOCK) & (F.sum("n_shingles") <= SHINGLES)).alias("whole"))
    named = named.join(sizes, "component")
    zero = F.lit(0)
    small = named.where("whole").select("rep", F.col("component").alias("key"), F.lit(WHOLE).alias("part"), *[zero.alias(c) for c in ("low", "high", "block")])
    large = meeting.join(named.where(~F.col("whole")).select("rep"), "rep", "left_semi").select("rep", *GROUP, "block")
    wanted = small.unionByName(large).groupBy("rep").agg(F.collect_list(F.struct(*GROUP, "block")).alias("groups"))
    full = _texts(texts, wanted.join(reps.select("rep", "doc_id", "set_hash", "signature"), "rep"))
    full = _together(full.select("rep", F.explode("groups").alias("g"), "set_hash", "signature", "text").select("g.*", "rep", "set_hash", "signature", "text"))
    out = full.mapInArrow(lambda batches: _in_groups(batches, _linked), "u long, v long")
    for more in found:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = settle(signatures(docs, id_col, text_col), "signatures")
    whole = rows.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    reps = whole.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), F.count("*").alias("copies"))
    reps = settle(reps.withColumn("rep", F.monotonically_increasing_id()), "sets")  # a name of its own for each set
    named = components(links(docs, reps, id_col, text_col))
    members = reps.select("rep", "doc_id", "set_hash").join(named, F.col("rep") == F.col("node"))
    members = settle(members.select("set_hash", "component", "doc_id"), "members")
    firsts = members.groupBy("component").agg(F.min("doc_id").alias("first"))
    of_set = reps.select("set_hash", "doc_id", "copies").join(members.join(firsts, "component").select("set_hash", "first"), "set_hash", "left")
    of_set = of_set.select("set_hash", F.coalesce("first", "doc_id").alias("component_id"), (F.col("copies") * HEAVY > rows.count()).alias("heavy"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    # fewer than HEAVY sets can each have over a HEAVY-th of the rows: those are told where they lie
    heavy = F.broadcast(of_set.where("heavy").select("set_hash", F.col("component_id").alias("common")))
    out = settle(out.join(heavy, "set_hash", "left"), "told")
    rest = out.where("common IS NULL").drop("common").join(of_set.where(~F.col("heavy")).drop("heavy"), "set_hash", "left")
    told = out.where("common IS NOT NULL").withColumnRenamed("common", "component_id").unionByName(rest)
    component = F.coalesce("component_id", "doc_id")
    return told.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of its component."""
    gone = settle(near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")), "near-copies")
    return docs.join(F.broadcast(gone) if few_bytes(gone) else gone, docs[id_col] == gone["_gone"], "left_anti")
