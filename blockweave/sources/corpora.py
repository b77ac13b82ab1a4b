"""Seeded synthetic corpora that exercise the planner: repeats, noise, near copies and shifts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Sizes of the corpora at scale 1.
LINES, NOISE, BASE, MARKERS, TAIL = 20_000, 2_000_000, 512_000, 32_768, 1_000_000


def _noise(seed: int, size: int) -> bytes:
    return np.random.default_rng(seed).integers(0, 256, size, dtype=np.uint8).tobytes()


def _edited(base: bytes, edits: int, seed: int) -> bytes:
    x = np.frombuffer(base, np.uint8).copy()
    at = np.random.default_rng(seed).integers(0, max(1, len(x)), edits)
    x[at] ^= 0x5A
    return x.tobytes()


def corpus(name: str, scale: float = 1.0, seed: int = 1) -> bytes:
    """The bytes of one corpus; the same name, scale and seed give the same bytes."""

    def n(size: int) -> int:
        return max(1, int(size * scale))

    match name:
        case "repeated-text":
            return b"The same line of text comes again and again.\n" * n(LINES)
        case "random":
            return _noise(seed, n(NOISE))
        case "near-duplicates":
            base = _noise(seed, n(BASE))
            return b"".join(_edited(base, edits, seed + edits) for edits in (0, 1, 16, 256, 4096))
        case "shifted-repeats":
            base = _noise(seed, n(BASE))
            return base + b"".join(_noise(seed + shift, shift) + base for shift in (1, 15, 255, 4095))
        case "prefix-random":
            return b"MARK" * n(MARKERS) + _noise(seed, n(TAIL))
        case "random-prefix":
            return _noise(seed, n(TAIL)) + b"MARK" * n(MARKERS)
    raise ValueError(f"unknown corpus {name}")


NAMES = ("repeated-text", "random", "near-duplicates", "shifted-repeats", "prefix-random", "random-prefix")


def corpora(spark: SparkSession, scale: float = 1.0, seed: int = 1) -> DataFrame:
    """(blob_id, name, data, n_bytes) of all corpora; each is made where its row is."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                data = corpus(NAMES[i], scale, seed)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([NAMES[i]]), pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], names=["blob_id", "name", "data", "n_bytes"])

    return spark.range(len(NAMES)).repartition(len(NAMES), "id").mapInArrow(run, "blob_id long, name string, data binary, n_bytes long")
