"""Tables of fixed size that all tasks fill and the executors merge: counts and bit filters.

They hold no keys, only cells; their size is a parameter and does not grow with
the data, so the merged table may be broadcast. A full filter lets rows pass
that a later exact join drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm.shingles import mixed
from tracemill.llm.staging import released

SLICES = 64
NO_ID = -(1 << 63)  # stands for a null id


def sliced(table: np.ndarray) -> pa.RecordBatch:
    """A task's table as rows, one per slice."""
    parts = [x.tobytes() for x in np.split(table, SLICES)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], names=["slice", "cells"])


def merged(slices: DataFrame, kind: str, join: np.ufunc, size: int) -> np.ndarray:
    """The table of ``size`` cells from the slices of all tasks; zeros if there are none."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for cells in batch.column(1).to_pylist():
                part = np.frombuffer(cells, kind)
                out = part.copy() if out is None else join(out, part, out=out)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["slice", "cells"])

    rows = slices.groupBy("slice").applyInArrow(released(merge), "slice int, cells binary").collect()  # SLICES rows
    if not rows:
        return np.zeros(size, kind)
    return np.concatenate([np.frombuffer(r["cells"], kind) for r in sorted(rows, key=lambda r: r["slice"])])


def saturated(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Sums of counts that stay at the largest value of their type."""
    np.add(a, np.minimum(b, np.iinfo(a.dtype).max - a), out=out)
    return out


def hashed(*columns: np.ndarray) -> np.ndarray:
    """One hash for the rows of some long columns."""
    out = mixed(columns[0].view(np.uint64))
    for c in columns[1:]:
        out = mixed(out + c.astype(np.uint64) + np.uint64(1))
    return out


def set_bits(bits: np.ndarray, hashes: np.ndarray) -> None:
    cell = hashes % np.uint64(len(bits) * 8)
    np.bitwise_or.at(bits, (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8))


def has_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes % np.uint64(len(bits) * 8)
    return ((bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def bit_filter(rows: DataFrame, columns: list[list[str]], n_bits: int) -> np.ndarray:
    """A bit for every row and each list of long columns; null values count as ``NO_ID``."""
    names = sorted({c for cs in columns for c in cs})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            got = {c: batch.column(i).fill_null(NO_ID).to_numpy() for i, c in enumerate(names)}
            for cs in columns:
                set_bits(bits, hashed(*(got[c] for c in cs)))
        yield sliced(bits)

    return merged(rows.select(*names).mapInArrow(released(mark), "slice int, cells binary"), "u1", np.bitwise_or, n_bits // 8)
