"""Plans: where a blob is cut into blocks, and which blocks repeat earlier ones.

Three layouts are known. A blob whose whole content is one unit repeated is cut by that
period, so its copies become references. Else it is cut by content: a Gear hash looks at the
last bytes only, so equal content gets equal cuts wherever it stands, also after an insertion.
If that saves less than a hundredth, fixed blocks are taken.
"""

from __future__ import annotations

import hashlib
from mmap import mmap
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.operators.errors import refuse

#: Sizes of the layouts; each is a parameter of what uses it.
BLOCK = 256 * 1024
LEAST_PLANNED = 128 * 1024
CHUNK_LEAST, CHUNK_MOST, CHUNK_BITS = 64 * 1024, 512 * 1024, 18
MOST_COPIES, LEAST_PERIOD = 64, 64 * 1024
#: Fixed values of the format: the sizes that a block may have.
LEAST_BLOCK, MOST_BLOCK = 4096, 16 * 1024 * 1024
#: A block this short is never a reference, whose payload takes four bytes.
REFERENCE_BYTES = 4


class Range(NamedTuple):
    """A block's place in its blob, and the earlier block that it repeats."""

    start: int
    end: int
    target: int | None = None


class Sizes(NamedTuple):
    """The thresholds of the planner."""

    block: int = BLOCK
    least_planned: int = LEAST_PLANNED
    chunk_least: int = CHUNK_LEAST
    chunk_most: int = CHUNK_MOST
    chunk_bits: int = CHUNK_BITS
    least_period: int = LEAST_PERIOD

    def checked(self) -> Sizes:
        """These sizes, if blocks of them fit an archive."""
        if not LEAST_BLOCK <= self.block <= MOST_BLOCK or not 0 < self.chunk_least <= self.chunk_most <= MOST_BLOCK:
            raise refuse("InvalidBlockSize", str(self))
        if not 0 < self.chunk_bits < 64 or self.least_period < 1 or self.least_planned < 0:
            raise ValueError(f"sizes out of range: {self}")
        return self


# -- as DataFrame operations -------------------------------------------------------------


def fixed_ranges(blobs: DataFrame, size: int, length: str = "n_bytes") -> DataFrame:
    """``blobs`` with block_index, start, end: one row per fixed block; an empty blob has none."""
    last = F.floor((F.col(length) - 1) / F.lit(size)).cast("int")
    cut = blobs.where(F.col(length) > 0).withColumn("block_index", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("block_index").cast("long") * size
    return cut.withColumns({"start": start, "end": F.least(start + size, F.col(length).cast("long"))})


def slices(ranges: DataFrame, data: str = "data") -> DataFrame:
    """``ranges`` with the bytes of each block instead of the blob's."""
    piece = F.substring(F.col(data), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return ranges.withColumn("block", piece).drop(data)


def periods(blobs: DataFrame, data: str = "data", length: str = "n_bytes", most_copies: int = MOST_COPIES, least_period: int = LEAST_PERIOD) -> DataFrame:
    """``blobs`` with period: the smallest unit, of ``least_period`` bytes at least, that two to ``most_copies`` copies of make up the blob; null if none does."""

    def fits(copies):
        unit = (F.col(length) / copies).cast("int")
        whole = (F.col(length) % copies == 0) & (unit >= least_period)
        same = F.substring(F.col(data), unit + 1, F.col(length).cast("int")) == F.substring(F.col(data), F.lit(1), F.col(length).cast("int") - unit)
        return F.when(whole, same).otherwise(F.lit(False))

    counts = F.sequence(F.lit(most_copies), F.lit(2), F.lit(-1))
    # in falling order of copies the first hit is the smallest period
    first = F.try_element_at(F.filter(counts, fits), F.lit(1))
    return blobs.withColumn("period", (F.col(length) / first).cast("long"))


def references(blocks: DataFrame, within: list[str], order: list[str], block: str = "block") -> DataFrame:
    """``blocks`` with target: the block_index of the first equal block; null for that one itself.

    Blocks meet by digest, which keeps their bytes out of the shuffle key. The first of each is found
    by an aggregate with a map side, so one that is very common shrinks before it is shuffled.
    """
    keyed = blocks.withColumn("_digest", F.sha2(F.col(block), 256))
    firsts = keyed.groupBy(*within, "_digest").agg(F.min_by("block_index", F.struct(*order)).alias("_first"))
    longer = F.octet_length(F.col(block)) > REFERENCE_BYTES
    target = F.when(longer & (F.col("_first") != F.col("block_index")), F.col("_first"))
    return keyed.join(firsts, [*within, "_digest"]).withColumn("target", target).select(*blocks.columns, "target")


def offsets(blocks: DataFrame, within: list[str], size: str = "original") -> DataFrame:
    """``blocks`` with offset: bytes of the blob before each block."""
    before = Window.partitionBy(*within).orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))


# -- for one blob --------------------------------------------------------------------------


def _gear(seed: int = 20240517) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_GEAR = _gear()


#: Bytes whose hashes are made at once, and those before them that they reach back to.
STRETCH, REACH = 1 << 20, 63


def cut_candidates(data: np.ndarray, bits: int, stretch: int = STRETCH) -> np.ndarray:
    """Places behind which a chunk may end: the high ``bits`` of a hash of the last 64 bytes are zero.

    The hash is the sum of Gear values, each shifted by its distance; doubling adds it up with
    six array operations, a stretch at a time.
    """
    found = []
    for at in range(0, len(data), stretch):
        begin = max(0, at - REACH)
        ends = _candidates(data[begin : at + stretch], bits) + begin
        found.append(ends[ends > at])
    return np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)


def _candidates(data: np.ndarray, bits: int) -> np.ndarray:
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16, 32):
        later = h.copy()
        later[step:] += h[:-step] << np.uint64(step) if step < len(h) else 0
        h = later
    return np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1


def content_ranges(data: bytes, sizes: Sizes = Sizes()) -> list[Range]:
    """Chunks cut by content, between the least and the most size."""
    places, n = cut_candidates(np.frombuffer(data, np.uint8), sizes.chunk_bits), len(data)
    out, start = [], 0
    while start < n:
        i = int(np.searchsorted(places, start + sizes.chunk_least))
        end = min(int(places[i]) if i < len(places) else n, start + sizes.chunk_most, n)
        out.append(Range(start, end))
        start = end
    return out


def cut(length: int, size: int, start: int = 0) -> list[Range]:
    return [Range(at, min(at + size, start + length)) for at in range(start, start + length, size)]


def period_of(data: bytes, least_period: int = LEAST_PERIOD, most_copies: int = MOST_COPIES) -> int | None:
    n = len(data)
    with memoryview(data) as view:
        for copies in range(most_copies, 1, -1):
            unit, rest = divmod(n, copies)
            starts = range(0, n - unit, STRETCH)
            if not rest and unit >= least_period and all(view[a : min(a + STRETCH, n - unit)] == view[a + unit : min(a + STRETCH, n - unit) + unit] for a in starts):
                return unit
    return None


def with_references(data: bytes | mmap, ranges: list[Range]) -> list[Range]:
    """Each range with the first earlier one that holds the same bytes."""
    first: dict[tuple[int, bytes], int] = {}
    out: list[Range] = []
    for i, r in enumerate(ranges):
        known = i
        if r.end - r.start > REFERENCE_BYTES:
            piece = data[r.start : r.end]
            known = first.setdefault((len(piece), hashlib.blake2b(piece, digest_size=16).digest()), i)
            if known != i and data[ranges[known].start : ranges[known].end] != piece:
                known = i
        out.append(r._replace(target=known if known != i else None))
    return out


def plan(data: bytes | mmap, sizes: Sizes = Sizes()) -> list[Range]:
    """The ranges of a blob in the layout that suits it."""
    if len(data) < sizes.least_planned:
        return cut(len(data), sizes.block)
    period = period_of(data, sizes.least_period)
    if period:
        ranges = [r for at in range(0, len(data), period) for r in cut(period, sizes.block, at)]
    else:
        ranges = content_ranges(data, sizes)
    planned = with_references(data, ranges)
    saved = sum(r.end - r.start for r in planned if r.target is not None)
    return planned if saved >= len(data) // 100 else with_references(data, cut(len(data), sizes.block))
