"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.staging import drop_stage, stage

#: edges that a task contracts at once
_ROOM = 1 << 16


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest node beside it."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    return both.join(least, "hi").where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return least.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct()


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    """The edges with each run of ``_ROOM`` replaced by the stars of its components: fewer edges than nodes of the run, however many tie the same nodes."""

    def stars(hi: list[np.ndarray], lo: list[np.ndarray]) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([*hi, *lo]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.link(at[: len(at) // 2], at[len(at) // 2 :])
        moved = forest.label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[forest.label[moved]])], names=["hi", "lo"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo, size = [], [], 0
        for batch in batches:
            hi.append(batch.column(0).to_numpy())
            lo.append(batch.column(1).to_numpy())
            size += batch.num_rows
            if size >= _ROOM:
                yield stars(hi, lo)
                hi, lo, size = [], [], 0
        if size:
            yield stars(hi, lo)

    return edges.select("hi", "lo").coalesce(max(2, -(-n // _ROOM))).mapInArrow(contract, "hi long, lo long").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node of each component, for every node with an edge to another.

    Loops, repeated edges and rows with nulls are ignored. Runs of edges are
    contracted first, so that a group whose texts meet many times brings a star
    and not all its edges into the joins. Each round is staged, so that the
    lineage stays short; nodes of any degree are joined by the shuffle, none is
    gathered. Raises if ``max_rounds`` (doubling at least the
    reach each) do not suffice.
    """
    hi, lo = F.greatest(src, dst).cast("long"), F.least(src, dst).cast("long")
    state = stage(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(hi.alias("hi"), lo.alias("lo")).where("hi > lo").distinct(), "edges"
    )
    mark = lambda: state.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    given, state = state, stage(_contracted(state, state.count()), "contracted")
    drop_stage(given)
    before = mark()
    for _ in range(max_rounds):
        new = stage(_small_star(_large_star(state)), "stars")
        drop_stage(state)
        state = new
        now = mark()
        if now == before or not now[0]:
            ends = state.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            return ends.unionByName(state.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


class Forest:
    """Components of a few thousand numbered nodes in one task; each label is the smallest number of its component."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.label[a], self.label[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.label, np.maximum(ra, rb), np.minimum(ra, rb))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def least(self, names: np.ndarray) -> np.ndarray:
        """For each node, the smallest of ``names`` in its component."""
        out = names.copy()
        np.minimum.at(out, self.label, names)
        return out[self.label]
