"""What both operators on vectors share: valid rows, and tiles of packed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.staging import released


def is_finite(vector: Column) -> Column:
    """True for vectors that are not null or empty and hold no null, NaN or infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column) -> Column:
    """Doubles whose squares neither vanish nor overflow: vectors of extreme size are divided by a power of two, which is exact."""
    top = F.array_max(F.transform(vector, F.abs))
    power = F.pow(F.lit(2.0), F.floor(F.log2(top)).cast("double"))
    return F.when((top < 1e-100) | (top > 1e100), F.transform(vector, lambda x: x / power)).otherwise(vector)


def packed(rows: DataFrame, keys: list[str], longs: list[str], vector: str) -> DataFrame:
    """One row per key: the ``longs`` columns and the ``vector`` (of floats or doubles) of all its rows as little-endian bytes; keys must bound their rows."""
    kinds = dict(rows.dtypes)
    width = "<f4" if kinds[vector] == "array<float>" else "<f8"

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list[bytes]] = {c: [] for c in [*longs, vector]}
        for b in batches:
            for c in longs:
                cols[c].append(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            flat = b.column(b.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False)
            cols[vector].append(flat.astype(width).tobytes())
        out = [pa.array([k.as_py()], k.type) for k in key] + [pa.array([b"".join(v)], pa.binary()) for v in cols.values()]
        yield pa.RecordBatch.from_arrays(out, names=[*keys, *cols])

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} binary" for c in [*longs, vector]])
    return rows.select(*keys, *longs, vector).groupBy(*keys).applyInArrow(released(pack), schema)


def unpack(ids: bytes, data: bytes, kind: str = "<f8") -> tuple[np.ndarray, np.ndarray]:
    """The ids and the vectors, as doubles, of a packed row; ``kind`` is the type they were packed as."""
    n = len(ids) // 8
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).reshape(n, -1).astype("<f8", copy=False)
