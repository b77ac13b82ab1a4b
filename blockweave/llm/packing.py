"""Best-fit packing of token sequences.

Bounded-space online best-fit: a task holds a fixed number of open bins. A bitset has one bit
per amount of free space, set while an open bin has just that much, so the bin that an item
fits most tightly is the lowest set bit at or above the item's length. When all bins are open
and none fits, the fullest one closes to make room.

Only lengths travel: (id, piece, length) rows are dealt over tasks by a hash of the id, in a
number of tasks that follows their count. A task places them one by one, in runs of a bounded
number of items, each in falling order of length: long items open bins, until more are wanted
than may be open and the fullest close; short ones fill the gaps, and what a run leaves open
serves the next. The order is total, so a task that is run again packs the same way. Pieces that
fill a bin alone skip the packing.

Defined results: a null text is empty and becomes the separator alone. Rows with the same id
are packed one by one, as often as they occur; a null id is an id like another. An empty table gives no rows.
Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.shingles import Runs, folding, slices
from blockweave.runtime import settle

CAPACITY = 2048
SEPARATOR = 0
#: Bins that a task holds open.
OPEN_BINS = 4096
#: Items come in runs of about this many, long ones first.
ITEMS_PER_RUN = 8192
#: Items that a packing task gets; each further task costs a few bins that stay half empty.
ITEMS_PER_TASK = 480_000
#: Entries of the tokenizer's memo in a Python worker.
MEMO = 1_000_000

PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", bin long, offset long"


class BestFit:
    """Bounded-space best-fit over items that come one at a time."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next item."""
        above = self.free_bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            at = self._take(free)
        else:
            if self.open == self.open_bins:  # the fullest closes
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.open -= 1
            free, at = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.free_bits |= 1 << left
        else:
            self.open -= 1
        return at, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        at = bins.pop()
        if not bins:
            self.free_bits ^= 1 << free
        return at


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``pieces`` (PIECE columns, length at most ``capacity``) with sequence_id and offset."""
    pieces = settle(pieces, "pieces")
    small = F.col("length") < capacity
    tasks = max(1, -(-pieces.where(small).count() // items_per_task))
    runs = max(1, -(-items_per_task // ITEMS_PER_RUN))
    dealt = pieces.where(small).withColumn("deal", F.xxhash64("doc_id", "row", "piece")).repartition(tasks, "deal")
    mixed = dealt.sortWithinPartitions(F.pmod(F.shiftright("deal", 20), F.lit(runs)), F.col("length").desc(), "deal", "doc_id", "row", "piece").drop("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        for batch in batches:
            placed = np.array([bins.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed[:, 0]), pa.array(placed[:, 1])], names=[*batch.schema.names, "bin", "offset"])

    # even numbers for the tasks' bins (task and bin side by side), odd ones for full pieces
    placed = mixed.mapInArrow(run, PLACED).withColumn("sequence_id", (F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("bin")) * 2)
    full = pieces.where(~small).withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(out).unionByName(full.select(out))


class _Tokenizer:
    """Ids of many texts at once, with a memo of what recurs.

    The vocabulary drops white space, lowers letters and splits a text into runs of letters,
    single digits and runs of other signs before anything is merged. Runs of ASCII classes are
    found and hashed with array operations, so only a run not met before costs Python work; the
    bytes of every run are compared with those of the one its hash stands for. Bytes of other characters count as letters; a text in which such a run holds anything but
    letters, or an apostrophe stands before a letter, or a run is not the one that its hash stands
    for, is taken apart at blanks and line ends only, and its chunks are encoded as they are. A
    text that holds a special token's string is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: special tokens that the library finds in a text before anything else
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        sizes = range(self.tokenizer.get_vocab_size(with_added_tokens=False))
        self.ends = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in sizes])
        code = np.arange(256)
        self.kinds = np.full(256, 3, np.uint8)
        self.kinds[(code >= 128) | ((code | 32) >= 97) & ((code | 32) <= 122)] = 1
        self.kinds[(code >= 48) & (code <= 57)] = 2
        self.kinds[[0x20, *range(0x09, 0x0E)]] = 0
        self.chunks: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        #: hashes of the runs known, in order, and the place of each
        self.hashes, self.places = np.empty(0, np.uint64), np.empty(0, np.int32)
        #: ids of all runs known, and where each begins; the first run is the mark of an odd one
        self.ids, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.known = np.zeros(1 << 16, np.int64), 1
        #: bytes of all runs known, and where each begins
        self.letters, self.spelt = np.zeros(1 << 16, np.uint8), 0
        self.spells = np.zeros(1 << 16, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        runs = Runs(data, offsets, self.kinds[data], folding()[0])
        unique, first, inverse = np.unique(runs.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) > MEMO:
            self._forget()
        at, known = self._find(unique)
        if not known.all():
            self._learn(data, runs, unique, first, np.flatnonzero(~known).tolist())
            at, _ = self._find(unique)
        place = self.places[at][inverse] if len(unique) else np.empty(0, np.int64)
        begin = self.starts[place]
        sizes = self.starts[place + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(begin - (ends - sizes), sizes)].astype("<u4")
        odd = (place == 0) | ~self._spelt_alike(runs, place)
        quote = (runs.ends - runs.starts == 1) & (data[runs.starts] == ord("'"))
        odd[:-1] |= quote[:-1] & (runs.starts[1:] == runs.ends[:-1]) & (self.kinds[data[runs.starts[1:]]] == 1)
        odd_before = np.concatenate([[0], np.cumsum(odd)])
        strange = odd_before[runs.before[1:]] > odd_before[runs.before[:-1]]
        bounds = np.concatenate([[0], ends])[runs.before].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(strange).tolist():
            out[i] = self._by_chunks(data[offsets[i] : offsets[i + 1]].tobytes().decode())
        for i in sorted(self._with_special(data, offsets)):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _spelt_alike(self, runs: Runs, place: np.ndarray) -> np.ndarray:
        """Which runs have the bytes of the known run at their place."""
        begin = self.spells[place]
        same = runs.sizes == self.spells[place + 1] - begin
        sizes = np.where(same, runs.sizes, 0)
        total = np.cumsum(sizes)
        step = np.arange(int(total[-1]) if len(total) else 0)
        from_run, from_known = (step + np.repeat(x - (total - sizes), sizes) for x in (runs.at, begin))
        wrong = np.concatenate([[0], np.cumsum(runs.folded[from_run] != self.letters[from_known])])
        return same & (wrong[total] == wrong[total - sizes])

    def _with_special(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        """Texts that hold a special token's string."""
        raw, found = data.tobytes(), set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[i + 1]:
                    found.add(i)
                at = raw.find(token, at + 1)
        return found

    def _find(self, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes stand among the known ones, and which do."""
        if not len(self.hashes):
            return np.zeros(len(unique), np.int64), np.zeros(len(unique), bool)
        at = np.minimum(np.searchsorted(self.hashes, unique), len(self.hashes) - 1)
        return at, self.hashes[at] == unique

    def _learn(self, data: np.ndarray, runs: Runs, unique: np.ndarray, first: np.ndarray, new: list[int]) -> None:
        hashes, at = unique[new].tolist(), first[new]
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(runs.starts[at].tolist(), runs.ends[at].tolist())]
        spelling = {h: runs.folded[a : a + n].tobytes() for h, a, n in zip(hashes, runs.at[at].tolist(), runs.sizes[at].tolist())}
        letters, others, odd = [], [], []
        for h, t in zip(hashes, texts):
            if t.isascii():
                (letters if t.isalpha() else others).append((h, t))
            elif t.isalpha() and t.lower().isalpha():  # lowering can part a mark from its letter
                letters.append((h, t))
            else:
                odd.append(h)
        self._keep(odd, np.zeros(len(odd), np.int32))
        if letters:
            # each run of letters gives just one token that ends a word, its last
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(t for _, t in letters)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(letters):
                self._add([h for h, _ in letters], ids, stops, spelling)
            else:
                others += letters
        if others:
            parts = [e.ids for e in self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)]
            self._add([h for h, _ in others], np.array([i for p in parts for i in p], np.uint32), np.cumsum([len(p) for p in parts]), spelling)

    def _add(self, hashes: list[int], ids: np.ndarray, stops: np.ndarray, spelling: dict[int, bytes]) -> None:
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        while self.known + len(hashes) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
            self.spells = np.concatenate([self.spells, np.zeros(len(self.spells), np.int64)])
        self.starts[self.known + 1 : self.known + 1 + len(hashes)] = self.filled + stops
        letters = np.frombuffer(b"".join([spelling[h] for h in hashes]), np.uint8)
        while self.spelt + len(letters) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(len(self.letters), np.uint8)])
        self.letters[self.spelt : self.spelt + len(letters)] = letters
        self.spells[self.known + 1 : self.known + 1 + len(hashes)] = self.spelt + np.cumsum([len(spelling[h]) for h in hashes])
        self.spelt += len(letters)
        self._keep(hashes, np.arange(self.known, self.known + len(hashes), dtype=np.int32))
        self.filled += len(ids)
        self.known += len(hashes)

    def _keep(self, hashes: list[int], places: np.ndarray) -> None:
        new = np.array(hashes, np.uint64)
        order = np.argsort(new)
        at = np.searchsorted(self.hashes, new[order])
        self.hashes = np.insert(self.hashes, at, new[order])
        self.places = np.insert(self.places, at, places[order])

    def _by_chunks(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        if len(self.chunks) > MEMO // 4:
            self.chunks.clear()
        new = list({c for c in chunks if c not in self.chunks})
        if new:
            encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.chunks.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(new, encoded, strict=True))
        return b"".join(map(self.chunks.__getitem__, chunks))


_tokenizers: dict[str, _Tokenizer] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECE rows of every text: its ids and the separator, cut after each ``capacity`` ids."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(name) or _tokenizers.setdefault(name, _Tokenizer(SparkFiles.get(name)))
        for batch in batches:
            for at, n, data, offsets in slices(batch.column(2)):
                rows: list[tuple] = []
                for doc_id, row, ids in zip(batch.column(0).slice(at, n).to_pylist(), batch.column(1).slice(at, n).to_pylist(), tokenizer.encode(data, offsets), strict=True):
                    ids += SEPARATOR.to_bytes(4, "little")
                    for i in range(0, len(ids), 4 * capacity):
                        cut = ids[i : i + 4 * capacity]
                        rows.append((doc_id, row, i // (4 * capacity), i // 4, len(cut) // 4, zlib.crc32(cut)))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.monotonically_increasing_id().alias("row"), F.col(text_col)).mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row per piece."""
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity, **options)
