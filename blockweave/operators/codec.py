"""The codec over DataFrames of blobs.

A blob is planned, its blocks are dealt over tasks and encoded apart, and an archive is put
together from blocks that arrive in order. Decoding takes archives apart into block rows;
everything that only asks about an archive is answered in one pass over it.

``blobs`` are (blob_id long, data binary), ``archives`` (blob_id long, archive binary). A null
blob stays null. Archives that are refused give a row with a status, or an error with ``strict``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.operators import block as kernel
from blockweave.operators import frame, tokens
from blockweave.operators.block import REFERENCE, Block
from blockweave.operators.errors import CodecError
from blockweave.plans import ranges as plans
from blockweave.plans.ranges import Sizes
from blockweave.runtime import settle

BLOCKS = (
    "blob_id long, block_index int, method int, predictor int, original long, packed long, checksum long, ref_target int, root int, payload binary, "
    "version int, legacy_level int, block_size long, status string, error string"
)
#: Rows, and about how many bytes of them, that are worked on at once.
ROWS, BYTES = 1024, 1 << 22


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded size; a longer value is a part of its own."""
    at, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > at and (i - at == ROWS or size + n > BYTES):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _map(df: DataFrame, column: str, work: Callable[[dict[str, list]], Iterator[tuple]], shape: str) -> DataFrame:
    """``df`` through ``work``, which takes the columns of some rows as lists and gives rows; ``column`` is the large one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, column):
                rows = list(work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target, strict=True)], schema=target)

    return df.mapInArrow(run, shape)


PLAN = "blob_id long, block_index int, start long, end long, ref_target int, checksum long, block binary"


def plan(blobs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """PLAN rows, one per block with its checksum; references carry no bytes. A blob without bytes is one row with a null block_index."""

    def work(columns: dict[str, list]) -> Iterator[tuple]:
        for blob_id, data in zip(columns["blob_id"], columns["data"]):
            sums: list[int] = []
            for i, x in enumerate(plans.plan(data, sizes)):
                piece = data[x.start : x.end] if x.target is None else None
                sums.append(sums[x.target] if piece is None else zlib.crc32(piece))
                yield blob_id, i, x.start, x.end, x.target, sums[-1], piece
            if not data:
                yield blob_id, None, 0, 0, None, None, None

    return _map(blobs.where("data IS NOT NULL").select("blob_id", "data"), "data", work, PLAN)


ENCODED = "blob_id long, block_index int, method int, predictor int, original long, checksum long, payload binary"


def encode_blocks(planned: DataFrame, smallest: bool = False) -> DataFrame:
    """ENCODED rows of a plan; those of a blob are dealt over tasks, which moves each byte once."""

    def work(columns: dict[str, list]) -> Iterator[tuple]:
        names = ("blob_id", "block_index", "start", "end", "ref_target", "checksum", "block")
        encoded = iter(kernel.encode_all([x for x in columns["block"] if x is not None], smallest))
        for blob_id, i, start, end, target, checksum, piece in zip(*map(columns.__getitem__, names)):
            if i is None:
                yield blob_id, None, None, None, 0, None, None
            elif target is not None:
                yield blob_id, i, REFERENCE, 0, end - start, checksum, target.to_bytes(4, "little")
            else:
                b = next(encoded)
                yield blob_id, i, b.method, b.predictor, b.original, b.checksum, b.payload

    return _map(planned.repartition("blob_id", "block_index"), "block", work, ENCODED)


def _little(value: Column) -> Column:
    """A whole number as four bytes, the lowest first."""
    digits = F.lpad(F.hex(value), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))


def _in_order(value: str, order: str) -> Column:
    return F.coalesce(F.expr(f"listagg({value}, X'') WITHIN GROUP (ORDER BY {order})"), F.lit(b""))


def assemble(blocks: DataFrame) -> DataFrame:
    """Archives of ENCODED rows; an empty blob is a header and an end mark."""
    byte = [F.unhex(F.lpad(F.hex(c), 2, "0")) for c in ("method", "predictor")]
    whole = F.concat(*byte, *[_little(c) for c in (F.col("original"), F.octet_length("payload").cast("long"), F.col("checksum"))], F.col("payload"))
    rows = blocks.select("blob_id", "block_index", "original", (F.col("method") == REFERENCE).alias("reference"), whole.alias("bytes"))
    out = rows.groupBy("blob_id").agg(F.max("original").alias("largest"), F.max("reference").alias("references"), _in_order("bytes", "block_index").alias("body"))
    start, size = frame.header(frame.LEAST_BLOCK), _little(F.greatest(F.col("largest"), F.lit(frame.LEAST_BLOCK).cast("long")))
    flag = F.when(F.col("references"), F.lit(bytes([start[5] | frame.HAS_REFERENCES]))).otherwise(F.lit(start[5:6]))
    return out.select("blob_id", F.concat(F.lit(start[:5]), flag, F.lit(start[6:8]), size, "body", F.lit(frame.end_mark())).alias("archive"))


#: Bytes from which the blocks of a blob or an archive are dealt over tasks; fewer are worked on where they lie, which moves none.
DEAL = 8 << 20


def compress(blobs: DataFrame, sizes: Sizes = Sizes(), smallest: bool = False, deal: int = DEAL) -> DataFrame:
    """Archives of ``blobs``; ids are unique and not null. However blocks are dealt, the archives are the same."""
    size = F.octet_length("data")
    large = assemble(encode_blocks(plan(blobs.where(size >= deal), sizes), smallest))
    return compress_small(blobs.where(size < deal), sizes, smallest).unionByName(large)


def compress_small(blobs: DataFrame, sizes: Sizes = Sizes(), smallest: bool = False) -> DataFrame:
    """Archives of blobs that need no dealing of blocks: no shuffle, one pass. Gives the same archives as ``compress``."""
    from blockweave import api

    def work(columns: dict[str, list]) -> Iterator[tuple]:
        yield from zip(columns["blob_id"], api.compress_all(columns["data"], sizes, smallest))

    return _map(blobs.where("data IS NOT NULL").select("blob_id", "data"), "data", work, "blob_id long, archive binary")


def _each_archive(archives: DataFrame, work: Callable[[int, bytes], Iterator[tuple]], shape: str) -> DataFrame:
    """The rows that ``work`` makes of each archive, in one pass without a shuffle."""

    def run(ids: list[int], found: list[bytes]) -> Iterator[tuple]:
        for blob_id, archive in zip(ids, found):
            yield from work(blob_id, archive)

    return _archives(archives, run, shape)


def _archives(archives: DataFrame, work: Callable[[list[int], list[bytes]], Iterator[tuple]], shape: str) -> DataFrame:
    """The rows that ``work`` makes of some archives at once."""
    own = archives.where("archive IS NOT NULL").select("blob_id", "archive")
    return _map(own, "archive", lambda columns: work(columns["blob_id"], columns["archive"]), shape)


def read_blocks(archives: DataFrame, limit: int | None = None, trailing: bool = False) -> DataFrame:
    """BLOCKS rows of archives; root is the block whose bytes a block has. A refused archive is one row with its status and no block; so is one without blocks, with status ok."""

    def work(blob_id: int, archive: bytes) -> Iterator[tuple]:
        nothing = (None,) * 9
        try:
            head, found, _ = frame.parse(archive, limit, trailing)
        except CodecError as e:
            yield blob_id, *nothing, None, None, None, e.status, str(e)
            return
        own = (head.version, head.legacy_level, head.block_size, "ok", None)
        if not found:
            yield blob_id, *nothing, *own
        roots: list[int] = []
        for i, b in enumerate(found):
            target = frame.target_of(b)
            roots.append(i if target is None else roots[target])
            yield blob_id, i, b.method, b.predictor, b.original, len(b.payload), b.checksum, target, roots[-1], b.payload, *own

    return _each_archive(archives, work, BLOCKS)


DECODED = "blob_id long, block_index int, block binary, status string"


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """DECODED rows of all blocks of ``blocks``.

    Blocks are dealt over tasks together with the references that lead to them, so that each is
    decoded once and references need no join. The row of an archive without blocks passes with its status.
    """
    own = ["blob_id", "root", "block_index", "method", "predictor", "original", "checksum", "payload", "status"]
    dealt = blocks.select(own).repartition("blob_id", "root").sortWithinPartitions("blob_id", "root", "block_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data, status = None, None, ""  # a block stands before what refers to it, perhaps in an earlier batch

        def work(columns: dict[str, list]) -> Iterator[tuple]:
            nonlocal last, data, status
            found = kernel.expand_all(Block(*fields[:5]) for _, root, i, *fields in zip(*map(columns.__getitem__, own)) if i == root and i is not None)
            for blob_id, root, i, known in zip(*map(columns.__getitem__, [*own[:3], "status"])):
                if i is None:
                    last, data, status = None, None, known
                elif i == root:
                    last, read = (blob_id, root), next(found)
                    data, status = (None, read.status) if isinstance(read, CodecError) else (read.data, "ok")
                elif last != (blob_id, root):  # the rows of its target are not at hand
                    last, data, status = None, None, "InvalidMatch"
                yield blob_id, i, data, status

        for batch in batches:
            for part in _slices(batch, "payload"):
                rows = list(work({n: part.column(k).to_pylist() for k, n in enumerate(own)}))
                for at in range(0, len(rows), 64):  # references to a large block are many bytes
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), (pa.int64(), pa.int32(), pa.binary(), pa.string()))], names=["blob_id", "block_index", "block", "status"])

    return dealt.mapInArrow(run, DECODED)


def resolved(blocks: DataFrame) -> DataFrame:
    """(blob_id, block_index, ref_target) of references in any table of blocks, each led to a block that is none, by pointer jumping."""
    links = settle(blocks.where(F.col("method") == REFERENCE).select("blob_id", "block_index", "ref_target"), "links")
    while True:
        onward = links.select("blob_id", F.col("block_index").alias("ref_target"), F.col("ref_target").alias("next"))
        jumped = settle(links.join(onward, ["blob_id", "ref_target"], "left"), "links")
        if jumped.where("next IS NOT NULL").isEmpty():
            return links
        links = jumped.select("blob_id", "block_index", F.coalesce("next", "ref_target").alias("ref_target"))


def decompress(archives: DataFrame, limit: int | None = frame.DEFAULT_LIMIT, strict: bool = False) -> DataFrame:
    """(blob_id, data, status, error) of every archive; data is null where it is refused. Each archive is decoded in one pass."""

    from blockweave import api

    def work(ids: list[int], found: list[bytes]) -> Iterator[tuple]:
        for blob_id, data in zip(ids, api.decompress_all(found, limit)):
            bad = data if isinstance(data, CodecError) else None
            if bad is not None and strict:
                raise bad
            yield (blob_id, data, "ok", None) if bad is None else (blob_id, None, bad.status, str(bad))

    return _archives(archives, work, "blob_id long, data binary, status string, error string")


def decompress_parallel(archives: DataFrame, limit: int | None = frame.DEFAULT_LIMIT, deal: int = DEAL) -> DataFrame:
    """(blob_id, data, status) as of ``decompress``, with the blocks of archives of ``deal`` bytes or more dealt over tasks."""
    size = F.octet_length("archive")
    large = decode_blocks(read_blocks(archives.where(size >= deal), limit)).groupBy("blob_id").agg(
        _in_order("block", "block_index").alias("data"),
        F.min(F.when(F.col("status") != "ok", F.struct("block_index", "status"))).alias("bad"),
    )
    large = large.select("blob_id", F.when(F.col("bad").isNull(), F.col("data")).alias("data"), F.coalesce("bad.status", F.lit("ok")).alias("status"))
    return decompress(archives.where(size < deal), limit).drop("error").unionByName(large)


def check(archives: DataFrame, limit: int | None = frame.DEFAULT_LIMIT) -> DataFrame:
    """(blob_id, status, error, original): whether each archive decodes; what it holds stays in the worker, a block at a time."""
    from blockweave import api

    def work(ids: list[int], found: list[bytes]) -> Iterator[tuple]:
        for blob_id, size in zip(ids, api.check_all(found, limit)):
            yield (blob_id, size.status, str(size), None) if isinstance(size, CodecError) else (blob_id, "ok", None, size)

    return _archives(archives, work, "blob_id long, status string, error string, original long")


INFO = "blob_id long, version int, legacy_level int, block_size long, original_size long, blocks long, status string, frame_size long, checksum boolean"


def frame_info(archives: DataFrame) -> DataFrame:
    """INFO, one row per archive from its headers alone: payloads are not decoded."""

    def work(blob_id: int, archive: bytes) -> Iterator[tuple]:
        try:
            head, found, _ = frame.parse(archive)
            yield blob_id, head.version, head.legacy_level, head.block_size, sum(b.original for b in found), len(found), "ok", len(archive), True
        except CodecError as e:
            yield blob_id, None, None, None, 0, 0, e.status, len(archive), False

    return _each_archive(archives, work, INFO)


COMMANDS = ("literal_commands", "match_commands", "literal_bytes", "matched_bytes", "distance_total")
COUNTERS = "blob_id long, block_index int, " + ", ".join(f"{c} long" for c in COMMANDS) + ", status string"


def command_counts(blocks: DataFrame) -> DataFrame:
    """COUNTERS of the commands of each block that is no reference; the block is decoded to check it."""
    own = ["blob_id", "block_index", "method", "predictor", "original", "checksum", "payload"]

    def work(columns: dict[str, list]) -> Iterator[tuple]:
        found = kernel.expand_all(Block(*fields) for fields in zip(*map(columns.__getitem__, own[2:])))
        for blob_id, i, read in zip(columns["blob_id"], columns["block_index"], found):
            yield (blob_id, i, None, None, None, None, None, read.status) if isinstance(read, CodecError) else (blob_id, i, *read[1:], "ok")

    return _map(blocks.where(F.col("method") != REFERENCE).select(own), "payload", work, COUNTERS)


def stream_sizes(blocks: DataFrame) -> DataFrame:
    """(blob_id, block_index, tags, literals, lengths, distances): bytes of the four streams of split blocks, decoded."""

    def work(columns: dict[str, list]) -> Iterator[tuple]:
        found = tokens.unpack_all(columns["payload"], columns["original"])
        for blob_id, i, original, payload, streams in zip(*map(columns.__getitem__, ("blob_id", "block_index", "original", "payload")), found):
            yield blob_id, i, *map(len, tokens.unpack_split(payload, original) if streams is None else streams)

    own = blocks.where(F.col("method") == kernel.SPLIT).select("blob_id", "block_index", "original", "payload")
    return _map(own, "payload", work, "blob_id long, block_index int, tags long, literals long, lengths long, distances long")


ANALYSIS = ", ".join(
    ["blob_id long", *[f"{c} long" for c in ("original_size", "payload_size", "blocks")], *[f"{n}_blocks long" for n in kernel.METHOD_NAMES.values()],
     *[f"{n}_predictor long" for n in kernel.PREDICTOR_NAMES.values()], "referenced_bytes long", *[f"{c} long" for c in COMMANDS], "frame_size long", "status string"]
)


def analyze(archives: DataFrame) -> DataFrame:
    """ANALYSIS, one row of counters per archive: blocks by method and predictor, bytes and commands; every block is decoded once."""

    from blockweave import api

    def work(ids: list[int], found: list[bytes]) -> Iterator[tuple]:
        for blob_id, counters in zip(ids, api.analyze_all(found)):
            yield blob_id, *counters.values()

    return _archives(archives, work, ANALYSIS)


def derived(analysis: DataFrame) -> DataFrame:
    """``analysis`` with shares in thousandths and averages; a denominator of zero counts as one."""

    def share(part: str):
        return F.floor(F.col(part) * 1000 / F.greatest(F.col("original_size"), F.lit(1))).cast("long")

    matches = F.greatest(F.col("match_commands"), F.lit(1))
    return analysis.withColumns(
        {
            "referenced_permille": share("referenced_bytes"),
            "literal_permille": share("literal_bytes"),
            "matched_permille": share("matched_bytes"),
            "average_match": F.col("matched_bytes") / matches,
            "average_distance": F.col("distance_total") / matches,
            "ratio_percent": F.when(F.col("original_size") == 0, 0.0).otherwise(F.col("frame_size") * 100 / F.greatest(F.col("original_size"), F.lit(1))),
        }
    )
