"""Huge JSON files and JSON lines read by many tasks, in a stable order.

A JSON file has no line to split at, but Spark's text source splits at any
string, here at ``}``: each split then is a run of bytes that begins after a
brace. What a byte means depends on all before it, namely on whether a string is
open and on how deep the brackets are. Both follow from sums: a first pass over
the splits of large files leaves their quotes' parity and their change of depth
for either beginning, one row a split, and adding these up in order gives the
state in which each split begins. A second pass counts the elements that end in
each split, which numbers them; the last one cuts them out. Elements across
splits leave pieces, the only rows that are shuffled. Files of one split take
the last pass only. Everything goes through Spark's readers, so that any store
will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_escaped = re.compile(rb"\\.", re.S).sub
_OPEN, _CLOSE = (np.isin(np.arange(256), list(s)) for s in (b"[{", b"]}"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of all lines of text files, numbered from 1 in each file, blank ones too; no task reads a whole file."""
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start")]
    rows = spark.read.text(path).select(meta[0].alias("path"), meta[1].alias("__block"), F.monotonically_increasing_id().alias("__at"), "value")
    # ids rise by one within a split, whose first one and size make one row
    blocks = rows.groupBy("path", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    return rows.join(blocks, ["path", "__block"]).select("path", (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("line"), "value")


@dataclass(frozen=True)
class _State:
    """Where a split begins: in a string, at a depth, in the list (or after its end), and how many elements ended before."""

    in_string: bool = False
    depth: int = 0
    opened: bool = False
    closed: bool = False
    ended: int = 0


class _Scanner:
    """Marks the elements of the list or dictionary at ``field`` (of the top level if None) in consecutive bytes."""

    def __init__(self, state: _State, field: str | None):
        self.state = state
        self.level = 1 if field is None else 2
        self.name = None if field is None else re.compile(rb'"' + re.escape(field.encode()) + rb'"\s*:\s*(?=[\[{])')

    @staticmethod
    def marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each byte: quotes so far, and +1 or -1 for brackets."""
        raw = np.frombuffer(_escaped(b"__", data) if b"\\" in data else data, np.uint8)
        return np.cumsum(raw == 34), _OPEN[raw].astype(np.int64) - _CLOSE[raw]

    def names(self, data: bytes, quotes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, quotes before it) of the opening brackets after the field's name."""
        for m in self.name.finditer(data):
            yield m.end(), int(quotes[m.start()]) - 1

    def feed(self, data: bytes) -> tuple[list[tuple[int, int, bool]], _State]:
        """(begin, end, ended) of parts of elements in ``data``, and the state after it."""
        s = self.state
        quotes, step = self.marks(data)
        step = np.where((quotes + s.in_string) % 2 == 0, step, 0)
        depth = s.depth + np.cumsum(step)
        parts, begin, opened, closed, ended = [], 0, s.opened, s.closed, s.ended
        if not opened:
            if self.name is None:
                place = int(step.argmax()) if (step > 0).any() else None
            else:
                at = ((p for p, q in self.names(data, quotes) if (q + s.in_string) % 2 == 0 and depth[p] == 2))
                place = next(at, None)
            if place is not None:
                opened, begin = True, place + 1
        if opened and not closed:
            out = np.flatnonzero((step[begin:] < 0) & (depth[begin:] < self.level))
            last = begin + int(out[0]) if len(out) else len(data)
            closed = bool(len(out))
            raw = np.frombuffer(data, np.uint8)[begin:last]
            commas = begin + np.flatnonzero((raw == 44) & (depth[begin:last] == self.level) & ((quotes[begin:last] + s.in_string) % 2 == 0))
            for end in [*commas.tolist(), last]:
                parts.append((begin, end, end < last or closed))
                begin = end + 1
            ended += len(commas) + closed
        after = int(quotes[-1]) if len(quotes) else 0
        self.state = _State((s.in_string + after) % 2 == 1, int(depth[-1]) if len(depth) else s.depth, opened, closed, ended)
        return parts, self.state


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(path, block, bytes) of consecutive rows of one split."""
    for batch in batches:
        paths, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values = batch.column(2).to_pylist()
        at = 0
        while at < len(values):
            end = at
            while end < len(values) and (blocks[end], paths[end]) == (blocks[at], paths[at]):
                end += 1
            yield paths[at], blocks[at], b"}".join(values[at:end]) + b"}"
            at = end


def _summarise(field: str | None):
    """One row a split: parity of quotes, changes of depth for both beginnings, and where the field's name may stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        scanner = _Scanner(_State(), field)
        for path, block, data in _runs(batches):
            row = found.setdefault((path, block), [0, 0, 0, []])
            quotes, step = scanner.marks(data)
            inside = (quotes + row[0]) % 2 == 1
            if field is not None:
                depth = [row[1 + k] + np.cumsum(np.where(inside == bool(k), step, 0)) for k in (0, 1)]
                for p, q in scanner.names(data, quotes):
                    k = (q + row[0]) % 2  # the beginning for which it stands outside strings
                    row[3].append(2 * int(depth[k][p]) + k)
            for k in (0, 1):
                row[1 + k] += int(step[inside == bool(k)].sum())
            row[0] = (row[0] + int(quotes[-1])) % 2
        names = ("path", "block", "parity", "outside", "within")
        columns = {n: [[*key, *row][i] for key, row in found.items()] for i, n in enumerate(names)}
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns.values(), types)), pa.array([r[3] for r in found.values()], pa.list_(pa.int64()))], [*names, "named"])

    return run


def _elements(states: dict[tuple[str, int], _State], field: str | None, only_count: bool):
    """Parts of elements (or, for each split, how many ended and whether the list did)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scanner, held = None, None, []
        counts: list[tuple] = []

        def rest() -> list[tuple]:
            s = scanner.state if scanner else None
            if s and only_count:
                counts.append((*key, s.ended, s.closed))
            if s and held and not only_count:
                return [(*key, s.ended, False, b"".join(held))]
            return []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            path, block, pos, ended, text = zip(*rows)
            text = pa.array(text, pa.binary()).cast(pa.string(), safe=False)
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(block, pa.int64()), pa.array(pos, pa.int64()), pa.array(ended), text], ["path", "block", "pos", "whole", "raw"])

        for path, block, data in _runs(batches):
            rows = []
            if (path, block) != key:
                rows += rest()
                key, held = (path, block), []
                begun = states.get(key, _State())
                scanner, whole = _Scanner(begun, field), not begun.opened
            number = scanner.state.ended
            parts, _ = scanner.feed(data)
            if only_count:
                continue
            for begin, end, ended in parts:
                held.append(data[begin:end])
                if ended:
                    rows.append((*key, number, whole, b"".join(held)))
                    held, whole, number = [], True, number + 1
            if rows:
                yield table(rows)
        last = rest()
        if only_count and counts:
            path, block, ended, closed = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(block, pa.int64()), pa.array(ended, pa.int64()), pa.array(closed)], ["path", "block", "ended", "closed"])
        elif last:
            yield table(last)

    return run


def _states(split: DataFrame, field: str | None) -> dict[tuple[str, int], _State]:
    """The state in which each split of the files of several splits begins; a row a split comes to the driver, twice."""
    level = 1 if field is None else 2
    summaries = split.mapInArrow(_summarise(field), "path string, block long, parity int, outside long, within long, named array<long>").collect()
    states: dict[tuple[str, int], _State] = {}
    state, path = _State(), None
    for r in sorted(summaries, key=lambda r: (r["path"], r["block"])):
        if r["path"] != path:
            state, path = _State(), r["path"]
        states[path, r["block"]] = state
        k = int(state.in_string)
        found = any(n % 2 == k and state.depth + n // 2 == level for n in r["named"]) if field is not None else True
        state = _State((state.in_string + r["parity"]) % 2 == 1, state.depth + (r["within"] if k else r["outside"]), state.opened or found)
    counts = split.mapInArrow(_elements(states, field, True), "path string, block long, ended long, closed boolean").collect()
    ended, closed, path = 0, False, None
    for r in sorted(counts, key=lambda r: (r["path"], r["block"])):
        if r["path"] != path:
            ended, closed, path = 0, False, r["path"]
        key = path, r["block"]
        states[key] = replace(states[key], closed=closed, ended=ended)
        if not closed:
            ended, closed = ended + r["ended"], r["closed"]
    return states


def read_elements(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """(path, pos, raw) of the elements of the list or dictionary that is a JSON file's top level, or its ``field``.

    ``pos`` numbers them from 0 in the order of each file, whatever the splits;
    ``raw`` is an element's own text, for dictionaries ``"key": value``. Files
    must be JSON in UTF-8; of a file without the field nothing is read. An element
    must fit a row.
    """
    meta = {c: F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_block_length", "file_size")}
    rows = spark.read.option("lineSep", "}").text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value"), (meta["file_block_length"] < meta["file_size"]).alias("split"))
    states = _states(rows.where("split").drop("split"), field)
    parts = rows.drop("split").mapInArrow(_elements(states, field, False), "path string, block long, pos long, whole boolean, raw string")
    pieces = parts.where("not whole").groupBy("path", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "raw"))).alias("pieces"))
    joined = pieces.select("path", "pos", F.array_join(F.transform("pieces", lambda p: p["raw"]), "").alias("raw"))
    found = parts.where("whole").select("path", "pos", "raw").unionByName(joined)
    return found.select("path", "pos", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw")).where("raw <> ''")


def read_records(spark: SparkSession, path: str, field: str | None = None, keyed: bool = False) -> DataFrame:
    """(path, payload, pos, key, raw, record) as :func:`tracemill.sources.adapters.records` gives them, with a null payload; ``keyed`` for dictionaries."""
    rows = read_elements(spark, path, field)
    if keyed:
        entry = F.get(F.map_entries(F.from_json(F.concat(F.lit("{"), "raw", F.lit("}")), "map<string,string>")), F.lit(0))
        rows = rows.withColumn("entry", entry).select("path", "pos", F.col("entry.key").alias("key"), F.col("entry.value").alias("raw"))
    else:
        rows = rows.withColumn("key", F.lit(None).cast("string"))
    return rows.select("path", F.lit(None).cast("variant").alias("payload"), "pos", "key", "raw", F.try_parse_json("raw").alias("record"))
