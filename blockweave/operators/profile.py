"""Measurements of whole blobs by kernels, in one pass each and without a row per byte.

Small blobs are measured together in groups, so that the cost per blob is small; long ones a
stretch at a time, so that memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.operators import predict
from blockweave.operators.codec import _slices
from blockweave.operators.matching import CANDIDATES, WINDOW, Group, hash3

#: A blob up to this many bytes is measured together with others; a longer one in stretches of as many.
STRETCH = 1 << 18
#: Weights of the checksums of predictions, by place.
PERIOD = 1021


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of blobs that are measured together."""
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if i > at and size + n > STRETCH:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def _measured(blobs: DataFrame, names: list[str], work: Callable[[Group], list[np.ndarray]]) -> DataFrame:
    """(blob_id, n_bytes, names) of every blob, from ``work`` on groups of them; a null blob counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "data"):
                items = [np.frombuffer(x or b"", np.uint8) for x in part.column("data").to_pylist()]
                sizes, found = [len(x) for x in items], []
                for a, b in _groups(sizes):
                    found.append(work(Group.of(items[a:b])))
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([part.column("blob_id"), pa.array(sizes, pa.int64()), *map(pa.array, columns)], names=["blob_id", "n_bytes", *names])

    return blobs.select("blob_id", "data").mapInArrow(run, ", ".join(["blob_id long", "n_bytes long", *[f"{n} long" for n in names]]))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _places(group: Group) -> np.ndarray:
    """Every byte's place in its blob."""
    return np.arange(len(group.data)) - np.repeat(group.bounds[:-1], np.diff(group.bounds))


def predictions(blobs: DataFrame, predictor: int, into: str) -> DataFrame:
    """(blob_id, n_bytes, into): the predicted bytes, each times its place modulo PERIOD plus 1, summed."""

    def work(group: Group) -> list[np.ndarray]:
        changed = predict.transformed(group, np.full(len(group.bounds) - 1, predictor))
        return [_sums(changed.data * (_places(group) % PERIOD + 1), group.bounds)]

    return _measured(blobs, [into], work)


def inverses(blobs: DataFrame, predictor: int) -> DataFrame:
    """(blob_id, n_bytes, mismatches): bytes that differ after predicting and restoring each blob."""

    def work(group: Group) -> list[np.ndarray]:
        changed = predict.transformed(group, np.full(len(group.bounds) - 1, predictor)).data
        back = [predict.inverse(changed[a:b], predictor) for a, b in zip(group.bounds[:-1].tolist(), group.bounds[1:].tolist())]
        return [_sums(np.concatenate([*back, np.empty(0, np.uint8)]) != group.data, group.bounds)]

    return _measured(blobs, ["mismatches"], work)


def scores(blobs: DataFrame) -> DataFrame:
    """(blob_id, n_bytes, plain_score, delta_score, xor_score) over whole blobs."""
    predictors = (predict.NONE, predict.DELTA, predict.XOR)

    def work(group: Group) -> list[np.ndarray]:
        if len(group.data) <= STRETCH:
            return [predict.scores(group, p) for p in predictors]
        return [np.array([predict.score(group.data, p, STRETCH)]) for p in predictors]

    return _measured(blobs, ["plain_score", "delta_score", "xor_score"], work)


def candidates(blobs: DataFrame) -> DataFrame:
    """(blob_id, n_bytes, candidates, places, nearest_sum): earlier places that matches may start from, and how near the nearest are."""

    def work(group: Group) -> list[np.ndarray]:
        if len(group.data) <= STRETCH + WINDOW:
            return list(_candidates(group, 0))
        # what is farther back than the window counts for nothing, so a stretch needs only that much before it
        n, total = len(group.data), np.zeros((3, 1), np.int64)
        for at in range(0, n, STRETCH):
            begin, end = max(0, at - WINDOW), min(n, at + STRETCH + 2)
            total += _candidates(Group(group.data[begin:end], np.array([0, end - begin])), at - begin)
        return list(total)

    return _measured(blobs, ["candidates", "places", "nearest_sum"], work)


def _candidates(group: Group, skip: int) -> np.ndarray:
    """Per blob: candidates, places with any, and the sum of the nearest distances; for places from ``skip`` on."""
    blobs, n = len(group.bounds) - 1, len(group.data)
    out = np.zeros((3, blobs), np.int64)
    ends = group.bounds[1:][np.diff(group.bounds) > 0]
    inside = np.ones(n, bool)  # with three bytes left in the blob
    inside[ends - 1] = inside[ends - 2] = False
    places = np.flatnonzero(inside)
    if len(places) < 2:
        return out
    x = group.data.astype(np.uint16)
    h = hash3(x[:-2], x[1:-1], x[2:])[places]
    order = np.argsort(h, kind="stable")
    at, owner = places[order], group.owners()[places[order]]
    same = owner.astype(np.int64) << 16 | h[order]
    for k in range(1, min(CANDIDATES, len(at) - 1) + 1):
        here = np.flatnonzero(same[k:] == same[:-k]) + k
        distance = at[here] - at[here - k]
        near = (distance <= WINDOW) & (at[here] >= skip)
        of = owner[here[near]]
        out[0] += np.bincount(of, minlength=blobs)
        if k == 1:
            out[1] += np.bincount(of, minlength=blobs)
            out[2] += np.bincount(of, distance[near], minlength=blobs).astype(np.int64)
    return out


def histogram(blobs: DataFrame, key: str) -> DataFrame:
    """(key, symbol, n): how often each byte occurs per value of a text column; counted in the workers first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str | None, np.ndarray] = {}
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = counts.setdefault(name, np.zeros(256, np.int64))
                if data.is_valid:
                    own += np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256)
            for name, own in counts.items():
                symbols = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(symbols), pa.string()), pa.array(symbols.astype(np.int32)), pa.array(own[symbols])], names=[key, "symbol", "n"])

    counted = blobs.select(F.col(key).cast("string").alias(key), "data").mapInArrow(run, f"{key} string, symbol int, n long")
    return counted.groupBy(key, "symbol").agg(F.sum("n").alias("n"))
