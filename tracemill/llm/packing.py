"""Packing of token streams into fixed-length sequences along a space-filling curve.

Each document becomes a hashed vector of its token counts, a fixed random
projection takes that to a few dimensions, and the documents are range-sorted by
the Hilbert key of the projected point, so that neighbours on the curve hold
similar tokens. The sorted documents form one stream, cut every ``length`` ids;
what remains at its end is cut into powers of two. So nothing is padded.

Only (row, key, count) is sorted; the ids move once, to meet their offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.bpe import byte_symbols
from tracemill.llm.staging import released, small_batches, stage

# equal to the byte-level pre-tokenizer's pattern; possessive, so that it never backtracks
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class ByteLevelEncoder:
    """Ids of a byte-level vocabulary file; strings of its special tokens become their ids, as the file's library does it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = {s: b for b, s in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.core = tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.size = max([*ranks.values(), *special.values()]) + 1

    def encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())


@cache
def _encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows) with ``bits`` bits a dimension."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations of each level
        low = q - 1
        for i in range(dims):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turn, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Projector:
    """Token ids -> hashed count vector -> unit length -> ``dims`` integers."""

    def __init__(self, vocab_size: int, buckets: int, dims: int, bits: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.bucket = ((np.arange(vocab_size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
        self.axes = self.rng.standard_normal((buckets, dims))
        self.axes -= self.axes.mean(0)
        self.buckets, self.bits = buckets, bits

    def point(self, ids: np.ndarray) -> np.ndarray:
        counts = np.bincount(self.bucket[ids], minlength=self.buckets).astype(float)
        at = (counts / max(np.sqrt(counts @ counts), 1e-12)) @ self.axes
        top = (1 << self.bits) - 1
        return np.clip((at + 4.0) / 8.0 * top, 0, top).astype(np.int64)


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, buckets: int, dims: int, bits: int, seed: int) -> DataFrame:
    """doc_id, n, curve_key and ids (little-endian, 16 bits where the vocabulary allows) of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        size = max(enc.size, end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        project = Projector(size, buckets, dims, bits, seed)
        for batch in batches:
            rows, counts, points = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.append(enc.encode(text), end_id) if text else np.array([end_id])
                rows.append(ids.astype(kind).tobytes())
                counts.append(len(ids))
                points.append(project.point(ids))
            if rows:
                keys = hilbert_keys(np.array(points), bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), pa.array(rows, pa.binary())],
                    names=["doc_id", "n", "curve_key", "ids"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(released(encode), "doc_id long, n long, curve_key long, ids binary")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets of the rows of one sorted partition within it."""
    part = TaskContext.get().partitionId()
    at = 0
    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False)
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ends - n, pa.int64()), batch.column(1), pa.array(np.full(len(n), part, np.int32))],
            names=["row_id", "local_start", "n", "part"],
        )
        at = int(ends[-1]) if len(n) else at


def tail_cuts(total: int, length: int) -> list[int]:
    """Where the sequences after the last full one start: a power of two each."""
    at = total // length * length
    cuts = []
    for b in reversed(range(length.bit_length())):
        if (total - at) >> b & 1:
            cuts.append(at)
            at += 1 << b
    return cuts


def pieces_of(start: int, n: int, total: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset in it) of the pieces of a document that begins at ``start`` of the stream."""
    full = total // length
    cuts = tail_cuts(total, length)
    out = []
    at, end = start, start + n
    while at < end:
        if at < full * length:
            seq, begin = divmod(at, length)[0], at // length * length
            stop = begin + length
        else:
            k = max(i for i, c in enumerate(cuts) if c <= at)
            seq, begin = full + k, cuts[k]
            stop = cuts[k + 1] if k + 1 < len(cuts) else total
        stop = min(stop, end)
        out.append((at - start, stop - at, seq, at - begin))
        at = stop
    return out


def pack(
    docs: DataFrame,
    path: str,
    length: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1024,
    dims: int = 4,
    bits: int = 12,
    seed: int = 7,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    A document's ids end with ``end_id``. Null and empty texts are that one id.
    Repeated rows are packed each, under the same doc_id. Ties on the curve are
    ordered by row. An empty table gives no pieces. Input columns other than the
    two named ones are ignored. Within a sequence the pieces lie gapless from 0;
    every sequence holds ``length`` ids, but for at most log2(length) last ones
    that hold a power of two each.
    """
    small_batches(docs.sparkSession)
    tokens = stage(
        tokenised(docs, path, end_id, id_col, text_col, buckets, dims, bits, seed).withColumn("row_id", F.monotonically_increasing_id()),
        "pack-tokens",
    )
    order = tokens.select("row_id", "n", "curve_key").repartitionByRange("curve_key", "row_id").sortWithinPartitions("curve_key", "row_id").select("row_id", "n")
    offsets = stage(order.mapInArrow(released(_running), "row_id long, local_start long, n long, part int"), "pack-offsets")
    # one row for each partition of the sort, so it may be broadcast whatever the size of the corpus
    sums = offsets.groupBy("part").agg(F.sum("n").alias("in_part")).collect()
    base, at = [], 0
    for part, n in sorted((r["part"], r["in_part"]) for r in sums):
        base.append((part, at))
        at += n
    total = at
    bases = docs.sparkSession.createDataFrame(base, "part int, base long")
    starts = offsets.join(F.broadcast(bases), "part").select("row_id", (F.col("local_start") + F.col("base")).alias("stream_start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            held = 0
            for doc_id, n, raw, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                for s, m, seq, off in pieces_of(start, n, total, length):
                    for c, v in zip(cols, (doc_id, s, m, wide[4 * s : 4 * (s + m)], n, seq, off)):
                        c.append(v)
                held += len(wide)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
                    cols, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return (
        tokens.select("row_id", "doc_id", "n", "ids")
        .join(starts, "row_id")
        .select("doc_id", "n", "ids", "stream_start")
        .mapInArrow(released(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    )
