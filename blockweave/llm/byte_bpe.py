"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string there is exactly one token that can end its encoding: the
token t reaching back to j such that t may follow the token that ends the prefix of length j.
Two tokens may stand side by side if merging their joined bytes by rank gives the two back.
``PrefixTable`` stores that last token per prefix. The encoding of any prefix is read off by
walking back, bytes are appended exactly by extending the table, and after an edit only the
prefixes near it are redone, until the table repeats what it held before.

A text is split by the published pattern first; each match is encoded on its own, and a match
that is itself a token stays whole. Matches recur, so their encodings are kept in a bounded
memo per Python worker.

Defined results: a null text counts as empty and gives no ids. Lone surrogates cannot occur in
Spark strings. Memory is bounded by the longest text, not by the number of rows. Rows are encoded
one by one, repeated or not; a null id is an id like another. An empty table gives no rows. Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space of the published pattern's \s, and the pattern over it.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Entries of a memo; a full one is emptied, so that a worker's memory stays bounded.
MEMO = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, their inverse, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        reach: dict[bytes, int] = {}
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            if len(token) > 1:
                reach[token[-2:]] = max(len(token), reach.get(token[-2:], 0))
        self.reach = reach  # longest token by its last two bytes
        self.longest = max(map(len, ranks), default=0)
        self.sizes = list(map(len, self.bytes_of))
        #: tokens by their bytes, one level per byte; the rank stands under None
        self.tree: dict = {}
        for token, rank in ranks.items():
            node = self.tree
            for byte in token:
                node = node.setdefault(byte, {})
            node[None] = rank
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Rank-ordered merging, for the few bytes of two joined tokens."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            best, at = min((rank(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``right`` can stand after ``left``; -1 is the start of the bytes.

        Merges that never cross the border also leave each side whole, so a token after
        another one needs no check of its own.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            sides = [self.bytes_of[x] for x in (left, right) if x >= 0]
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(b"".join(sides)) == sides
        return known


def last_tokens(v: Vocabulary, data: bytes) -> list[int]:
    """Last token of every prefix, found forwards: what may begin at a place is offered to the place where it ends."""
    n, pair = len(data), v.pairs.get
    last: list[int | None] = [None] * (n + 1)
    last[0] = -1
    for start in range(n):
        before, node = last[start], v.tree
        if before is None:
            break
        key = before << 32
        for end in range(start + 1, n + 1):
            node = node.get(data[end - 1])
            if node is None:
                break
            token = node.get(None)
            if token is not None and last[end] is None:
                fits = pair(key | token)
                if fits or fits is None and v.may_follow(before, token):
                    last[end] = token
    if None in last:
        raise ValueError(f"no token ends at byte {last.index(None)}: the vocabulary lacks single bytes")
    return last[1:]


class PrefixTable:
    """last[i] is the token that ends the encoding of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        self.last = last_tokens(vocabulary, data)

    def _last_tokens(self, begin: int) -> Iterator[int]:
        """Last tokens of the prefixes longer than ``begin``; each is stored before the next is asked for."""
        v, data, last = self.vocabulary, self.data, self.last
        rank, reach, pair = v.ranks.get, v.reach.get, v.pairs.get
        for end in range(begin + 1, len(data) + 1):
            for start in range(max(0, end - reach(data[end - 2 : end], 1)) if end > 1 else 0, end):
                token = rank(data[start:end])
                if token is not None:
                    before = last[start - 1] if start else -1
                    fits = pair(before << 32 | token)
                    if fits or fits is None and v.may_follow(before, token):
                        yield token
                        break
            else:
                raise ValueError(f"no token ends at byte {end}: the vocabulary lacks single bytes")

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        for token in self._last_tokens(begin):
            self.last.append(token)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start..stop; returns how many prefixes were computed anew."""
        old_last, old_len = self.last, len(self.data)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old_last[:start]
        shift, same, settled = len(self.data) - old_len, 0, start + len(new)
        for end, token in enumerate(self._last_tokens(start), start + 1):
            self.last.append(token)
            # a later prefix depends on at most ``longest`` bytes and last tokens before it
            same = same + 1 if end > settled and old_last[end - 1 - shift] == token else 0
            if same >= self.vocabulary.longest:
                self.last += old_last[end - shift :]
                return end - start
        return len(self.data) - start

    def ids(self, length: int | None = None) -> list[int]:
        """Encoding of the first ``length`` bytes (all, if none)."""
        at, out, sizes = len(self.data) if length is None else length, [], self.vocabulary.sizes
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= sizes[token]
        return out[::-1]


class Encoder:
    """Texts to ids and back, with memos of what recurs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.matches = _Memo(self._match)
        self.units = _Memo(self._unit)

    def _match(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        return (whole,) if whole is not None else tuple(PrefixTable(self.vocabulary, data).ids())

    def _unit(self, unit: str) -> tuple[int, ...] | None:
        """Ids of one blank and what follows it up to the next; None if white space meets its ends."""
        if not unit or unit[0].isspace() or unit[-1].isspace():
            return None
        return tuple(chain.from_iterable(map(self.matches.__getitem__, self.split(" " + unit))))

    def ids(self, text: str) -> list[int]:
        # A blank between two other characters always opens a match, so the text can be taken
        # apart there; any other white space sends the whole text through the pattern.
        head, *units = text.split(" ")
        if head and not head[-1].isspace():
            found = list(map(self.units.__getitem__, units))
            if None not in found:
                return [*chain.from_iterable(map(self.matches.__getitem__, self.split(head))), *chain.from_iterable(found)]
        return list(chain.from_iterable(map(self.matches.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self.make(key)
        if len(key) <= 32:
            self[key] = value
        return value


_encoders: dict[str, Encoder] = {}


def shipped(spark, path: str) -> str:
    """Send a vocabulary file along with the job; returns its name for ``encoder_of``."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encoder_of(name: str) -> Encoder:
    """The worker's encoder for a shipped vocabulary, made once per Python process."""
    if name not in _encoders:
        _encoders[name] = Encoder(read_ranks(SparkFiles.get(name)))
    return _encoders[name]


def encode_table(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its ids, one row per input row."""
    name = shipped(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(name).ids
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids alone."""
    name = shipped(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name)
        decimals = [b"%d" % i for i in range(len(encoder.vocabulary.bytes_of))]
        for batch in batches:
            counts, written, decoded = [], [], []
            for text in batch.column(1):
                ids = encoder.ids(text.as_py() or "")
                counts.append(len(ids))
                written.append(hashlib.sha256(b" ".join(map(decimals.__getitem__, ids))).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
