"""Shuffles of numpy records: many small records travel as one binary cell per task batch and target part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import input_bytes

SCHEMA = "part int, data binary"


def parts_for(df: DataFrame, blowup: float, target: int = 24 << 20) -> tuple[int, int]:
    """(partitions, parts): as many partitions as keep blowup x input in runs of about target bytes; parts are finer."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(input_bytes(df) * blowup) // target + 1)
    return n, 8 * n


def _murmur(x: int) -> int:
    """Spark's hash of an int."""
    m = 0xFFFFFFFF
    k = x * 0xCC9E2D51 & m
    k = (k << 15 | k >> 17) & m
    h = 42 ^ (k * 0x1B873593 & m)
    h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def spread(partitions: int) -> np.ndarray:
    """For each partition a number that repartition(partitions, ...) sends there, so parts fill partitions evenly."""
    out: dict[int, int] = {}
    x = 0
    while len(out) < partitions:
        out.setdefault(_murmur(x) % partitions, x)
        x += 1
    return np.array([out[k] for k in range(partitions)], np.int32)


def pack(part: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each part that occurs, with its records' bytes."""
    if not len(records):
        return
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    bounds = np.concatenate([[0], cuts, [len(part)]])
    size = records.dtype.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(records.tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]], pa.int32()), data], ["part", "data"])


def unpack(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(part of each record, records) of a whole partition."""
    parts, records = [], []
    for b in batches:
        for p, d in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(d.as_buffer(), dtype)
            parts.append(np.full(len(x), p, np.int32))
            records.append(x)
    if not records:
        return np.zeros(0, np.int32), np.zeros(0, dtype)
    return np.concatenate(parts), np.concatenate(records)


def exchange(df: DataFrame, partitions: int) -> DataFrame:
    """Rows of one part meet in one partition."""
    return df.repartition(partitions, "part")
