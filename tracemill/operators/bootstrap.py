"""Poisson bootstrap of the AUROC: every row counts Poisson(1) times in each replicate, without rows for the draws.

A row's count in replicate r is read off (a_r * x + c_r * y + b_r) mod P for two
hashes x and y of its key: any two keys are independent within a replicate, rows
of one key share their counts, and every engine can repeat the numbers. Counts never become rows.
Rows whose score is common in their batch are folded at once into counts by
score, a number a replicate; these and the remaining rows meet in ranges of the
scores, and a range leaves three numbers a replicate: weights, positives and
rank sums, which add up over ranges in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.picks import draw
from tracemill.operators import scan
from tracemill.operators.metrics import ratio

#: a prime below 2^31, so that products of residues fit 64 bits
PRIME = (1 << 31) - 1
_CHUNK = 2048


def thresholds() -> list[int]:
    """Residues from which on a row counts once, twice and so on: the distribution function of Poisson(1) times PRIME, rounded down."""
    out, term, total = [], np.exp(-1.0), 0.0
    for k in range(1, 11):
        total += term
        out.append(int(total * PRIME))
        term /= k
    return out


def factors(replicates: int, salt: str) -> np.ndarray:
    """a_r, c_r and b_r of each replicate, by md5 as :func:`tracemill.functions.picks.draw` has it."""
    number = lambda *s: int(hashlib.md5("|".join(map(str, s)).encode()).hexdigest()[:8], 16) % PRIME
    return np.array([[number(salt, letter, r) for r in range(replicates)] for letter in "acb"], np.int64)


def weights(xy: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """(rows, replicates): how often each row of hashes (x, y) counts."""
    a, c, b = factor
    return np.searchsorted(thresholds(), (xy[:, :1] * a + xy[:, 1:] * c + b) % PRIME, "right").astype(np.int64)


def _sums(xy: np.ndarray, label: np.ndarray, begin: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all and of positive rows by replicate, for runs of rows that begin at ``begin``."""
    w = weights(xy, factor)
    return np.add.reduceat(w, begin), np.add.reduceat(w * label[:, None], begin)


def _hashes(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in ("x", "y")], 1)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows or a little more, whatever size they come in, so that common scores meet."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _packed(counts: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(counts.astype("<i8").tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(packed, 8 * n, asbytes=True), "<i8")


def _fold(factor: np.ndarray, common: int):
    """Scores with ``common`` rows of a batch or more become one row of counts, the others stay."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            group = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            score, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("score", "label"))
            label, xy = label.astype(np.int64), _hashes(batch)
            order = np.lexsort((score, group))
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(score[order]) != 0) | (np.diff(group[order]) != 0)]))
            size = np.diff(np.append(begin, len(order)))
            rest = order[np.repeat(size < common, size)]
            first, counts = [], ([None] * len(rest), [None] * len(rest))
            for at, n in zip(begin[size >= common], size[size >= common]):
                mine = order[at : at + n]
                parts = [_sums(xy[c], label[c], np.array([0]), factor) for c in np.array_split(mine, -(-n // _CHUNK))]
                first.append(mine[0])
                for k in (0, 1):
                    counts[k].append(_packed(sum(p[k][0] for p in parts)))
            rows = pa.array(np.concatenate([rest, np.array(first, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), *(pa.array(c, pa.binary()) for c in counts)], [*batch.schema.names, "n", "p"])

    return fold


def _rank(factor: np.ndarray):  # of factors only their number counts where all rows are folded
    """Weights, positives and rank sums of one range, by replicate."""

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        zero = np.zeros(factor.shape[1])
        total, positives, ranks, held_n, held_p, last = zero, zero, zero, zero, zero, None  # held: of the last score so far, which may go on
        folded = table.column("n").is_valid().to_numpy()
        score, label, xy = table.column("score").to_numpy(), table.column("label").to_numpy().astype(np.int64), _hashes(table)
        order = np.lexsort((folded, score))
        at = 0
        while at < len(order):
            rows = order[at : at + _CHUNK]
            if folded[rows[0]]:
                rows = rows[:1]
                scores = score[rows]
                n, p = (_unpacked(table.column(c)[int(rows[0])].as_py(), factor.shape[1])[None, :] for c in ("n", "p"))
            else:
                rows = rows[: int(folded[rows].argmax()) or None] if folded[rows].any() else rows
                begin = np.flatnonzero(np.concatenate([[True], np.diff(score[rows]) != 0]))
                scores = score[rows][begin]
                n, p = _sums(xy[rows], label[rows], begin, factor)
            at += len(rows)
            if scores[0] == last:
                held_n, held_p, n, p = held_n + n[0], held_p + p[0], n[1:], p[1:]
            if len(n):
                n, p = np.concatenate([[held_n], n]), np.concatenate([[held_p], p])
                ends = total + np.cumsum(n, 0)
                ranks = ranks + (p[:-1] * (ends[:-1] - (n[:-1] - 1) / 2.0)).sum(0)
                total, positives = ends[-2], positives + p[:-1].sum(0)
                held_n, held_p, last = n[-1], p[-1], scores[-1]
        ranks = ranks + held_p * (total + (held_n + 1) / 2.0)
        found = {"total": total + held_n, "positives": positives + held_p, "ranks": ranks}
        return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "zone": pa.array([key[1].as_py()], pa.int32())} | {k: pa.array([v], pa.list_(pa.float64())) for k, v in found.items()})

    return rank


def poisson_auc(
    rows: DataFrame, key: str, replicates: int = 1000, by: str | None = None, score: str = "score", label: str = "label", salt: str = "poisson", ranges: int | None = None, common: int = 64
) -> DataFrame:
    """(by, replicate, value): the AUROC of each replicate, 0 where a class is missing.

    Rows with equal ``key`` (the two scores of a pair, say) count equally often.
    Labels are 0 or 1; rows without a score are left out. A range of the scores
    is one task and holds 50 bytes a row of it; a score that holds many rows is
    spread before, as counts.
    """
    hashes = [F.pmod(draw(F.lit(salt), F.lit(c), F.col(key)), F.lit(PRIME)).alias(c) for c in "xy"]
    group = F.col(by).cast("string") if by else F.lit("")
    slim = rows.where(F.col(score).isNotNull()).select(group.alias("g"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label"), *hashes)
    slim = slim.withColumn("zone", scan.range_of(slim, [F.col("g"), F.col("score")], ranges or scan.default_ranges(rows)).cast("int"))
    factor = factors(replicates, salt)
    slim = slim.select("g", "zone", "score", "label", "x", "y")
    folded = slim.mapInArrow(_fold(factor, common), "g string, zone int, score double, label int, x long, y long, n binary, p binary")
    return _values(folded, factor, by)


def _values(folded: DataFrame, factor: np.ndarray, by: str | None) -> DataFrame:
    """(by, replicate, value) of rows and counts dealt to ranges (``zone``) of the scores."""
    sums = folded.groupBy("g", "zone").applyInArrow(_rank(factor), "g string, zone int, total array<double>, positives array<double>, ranks array<double>")
    each = sums.select("g", "zone", F.posexplode(F.arrays_zip("total", "positives", "ranks")).alias("replicate", "v")).select("g", "zone", "replicate", "v.*")
    before = F.coalesce(F.sum("total").over(Window.partitionBy("g", "replicate").orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = each.withColumn("ranks", F.col("ranks") + F.col("positives") * before)
    found = ranked.groupBy("g", "replicate").agg(F.sum("total").alias("n"), F.sum("positives").alias("p"), F.sum("ranks").alias("ranks"))
    value = ratio(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * (F.col("n") - F.col("p")))
    return found.select(*([F.col("g").alias(by)] if by else []), F.col("replicate").cast("long").alias("replicate"), value.alias("value"))


# --- draws with replacement ---
#: pairs whose counts travel together, and draws that one task makes at once
_ZONE, _SLICE, _STEP = 1 << 13, 1 << 22, 1 << 14
_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)


def draws(prefix: str, begin: int, end: int) -> np.ndarray:
    """:func:`tracemill.functions.picks.draw` of ``prefix`` followed by each number from ``begin`` to ``end`` - 1: the first 32 bits of the MD5 of many short texts at once."""
    out, head = [], prefix.encode()
    while begin < end:
        digits = len(str(begin))
        stop = min(end, 10**digits, begin + _STEP)
        numbers = np.arange(begin, stop)
        text = bytearray(head + bytes(digits) + b"\x80")
        text += bytes(-(len(text) + 8) % 64) + (8 * (len(head) + digits)).to_bytes(8, "little")
        words = [np.full(1, w, np.uint32) for w in np.frombuffer(bytes(text), "<u4")]
        for k in range(digits):
            at = len(head) + k
            digit = (numbers // 10 ** (digits - 1 - k) % 10 + 48).astype(np.uint32)
            words[at // 4] = words[at // 4] | digit << np.uint32(8 * (at % 4))
        state = [np.full(1, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        for block in range(0, len(words), 16):
            a, b, c, d = state
            for i in range(64):
                turn, k = divmod(i, 16)
                mix = d ^ (b & (c ^ d)) if turn == 0 else c ^ (d & (b ^ c)) if turn == 1 else b ^ c ^ d if turn == 2 else c ^ (b | ~d)
                total = a + mix + (_SINES[i] + words[block + (k, 5 * k + 1, 3 * k + 5, 7 * k)[turn] % 16])
                left = _TURNS[turn, i % 4]
                a, d, c, b = d, c, b, b + (total << left | total >> (np.uint32(32) - left))
            state = [x + y for x, y in zip(state, (a, b, c, d))]
        out.append(np.broadcast_to(state[0], len(numbers)).byteswap().astype(np.int64))
        begin = stop
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _draw(salt: str):
    def draw_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often a slice of the draws of a replicate takes each row, by zones of the rows' numbers."""
        codec = pa.Codec("zstd")
        for batch in batches:
            for g, n, replicate, begin in zip(*(c.to_pylist() for c in batch.columns)):
                prefix = "|".join([salt, *([g[1:]] if g else []), str(replicate), ""])
                taken = np.sort(draws(prefix, begin, min(begin + _SLICE, n)) % n)
                cuts = np.searchsorted(taken, np.arange(0, n + _ZONE, _ZONE))
                zones = np.flatnonzero(np.diff(cuts))
                for some in np.array_split(zones, -(-len(zones) // 256)):
                    counts = [codec.compress(np.bincount(taken[cuts[z] : cuts[z + 1]] - z * _ZONE, minlength=_ZONE).astype("<u4").tobytes(), asbytes=True) for z in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * len(some), pa.string()), pa.array(some.astype(np.int64)), pa.array([replicate] * len(some), pa.int32()), pa.array(counts, pa.binary())], names=["g", "part", "replicate", "counts"]
                    )

    return draw_


def _meet(replicates: int):
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of a zone with how often each replicate takes them, folded by score."""
        codec, taken = pa.Codec("zstd"), np.zeros((replicates, _ZONE), np.uint32)
        for r, packed in zip(left.column("replicate").to_pylist(), left.column("counts")):
            taken[r] += np.frombuffer(codec.decompress(packed.as_py(), 4 * _ZONE, asbytes=True), "<u4")
        taken = np.ascontiguousarray(taken.T)
        score, label, at = (right.column(c).to_numpy() for c in ("score", "label", "at"))
        order = np.argsort(score, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(score[order]) != 0]))[: len(order)]
        out_n, out_p = [], []
        for run in np.split(order, begin[1:]) if len(order) else []:
            n = p = 0
            for a in range(0, len(run), _CHUNK):
                rows = run[a : a + _CHUNK]
                n = n + taken[at[rows]].sum(0, dtype=np.int64)
                p = p + taken[at[rows[label[rows] == 1]]].sum(0, dtype=np.int64)
            out_n.append(_packed(n))
            out_p.append(_packed(p))
        g = right.column("g")[0].as_py() if len(order) else None
        return pa.table({"g": pa.array([g] * len(begin), pa.string()), "score": pa.array(score[order][begin], pa.float64()), "n": pa.array(out_n, pa.binary()), "p": pa.array(out_p, pa.binary())})

    return meet


def _drawn(rows: DataFrame, ordinal: str, replicates: int, by: str | None, score: str, label: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """The rows as (g, k, score, label), and (g, score, n, p): how often each replicate takes the rows of a score in a zone of their numbers, packed."""
    spark = rows.sparkSession
    group = F.concat(F.lit("="), F.col(by).cast("string")) if by else F.lit("")
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    slim = rows.select(group.alias("g"), F.col(ordinal).cast("long").alias("k"), F.when(F.isnan(value), F.lit(float("inf"))).otherwise(value).alias("score"), F.col(label).cast("int").alias("label")).where("g is not null")
    sizes = slim.groupBy("g").agg((F.max("k") + 1).alias("n"))
    every = sizes.select("g", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    every = every.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_SLICE).cast("long"))).alias("begin"))
    tasks = max(scan.default_ranges(rows), 4 * spark.sparkContext.defaultParallelism)
    counts = every.repartition(tasks, "g", "replicate", "begin").mapInArrow(_draw(salt), "g string, part long, replicate int, counts binary")
    placed = slim.select("g", F.floor(F.col("k") / _ZONE).cast("long").alias("part"), F.pmod("k", F.lit(_ZONE)).alias("at"), "score", "label")
    met = counts.groupBy("g", "part").cogroup(placed.groupBy("g", "part")).applyInArrow(_meet(replicates), "g string, score double, n binary, p binary")
    return slim, met


def drawn_auc(rows: DataFrame, ordinal: str, replicates: int = 1000, by: str | None = None, score: str = "score", label: str = "label", salt: str = "bootstrap") -> DataFrame:
    """(by, replicate, value): the AUROC of each replicate of as many draws, with replacement, as there are numbers; 0 where a class is missing.

    ``ordinal`` numbers what is drawn from 0, within each group; rows of one
    number (the two scores of a pair) are drawn together. Draws never become rows: a task
    counts those of a slice of a replicate, counts travel by zones of the numbers,
    where rows of equal score become one of counts, and these meet in ranges of
    the scores. Null scores rank with negative infinity, NaN with positive.
    """
    slim, met = _drawn(rows, ordinal, replicates, by, score, label, salt)
    zone = scan.range_of(slim, [F.col("g"), F.col("score")], scan.default_ranges(rows)).cast("int")
    folded = met.select("g", zone.alias("zone"), "score", F.lit(0).alias("label"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "n", "p")
    out = _values(folded, np.zeros((3, replicates), np.int64), by)
    return out.withColumn(by, F.substring(by, 2, 1 << 30).cast(dict(rows.dtypes)[by])) if by else out


def drawn_by_score(rows: DataFrame, ordinal: str, replicates: int, score: str, label: str, salt: str) -> DataFrame:
    """(replicate, score, label, times): how often each replicate draws rows of a score and label, in parts that add up; see :func:`drawn_auc`."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                n, p = (_unpacked(x, replicates) for x in packed)
                for value, times in ((1, p), (0, n - p)):
                    r = np.flatnonzero(times)
                    yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(np.full(len(r), s, np.float64)), pa.array(np.full(len(r), value, np.int32)), pa.array(times[r])], names=["replicate", score, label, "times"])

    met = _drawn(rows, ordinal, replicates, None, score, label, salt)[1]
    return met.select("score", "n", "p").mapInArrow(spread, f"replicate long, {score} double, {label} int, times long")
