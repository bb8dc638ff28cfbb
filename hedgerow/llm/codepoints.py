"""Batches of texts as one array of code points with the bounds of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import runs_of

#: Bytes of text handled at once; single longer texts are handled alone and whole.
CHUNK = 1 << 20
LIMIT = 0x110000


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, texts, code points joined by newlines, starts, ends); null texts count as empty."""
    texts = pc.fill_null(texts, "")
    for i, j in runs_of((pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1).tolist(), most):
        own = texts.slice(i, j - i).to_pylist()
        size = np.fromiter(map(len, own), dtype=np.int64, count=j - i)
        starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
        points = np.frombuffer(("\n".join(own) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield i, j, own, points, starts, starts + size


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for each span; empty spans give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[ends] - total[starts]
