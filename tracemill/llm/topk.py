"""Exact top-k inner products of integer vectors by block-at-a-time pruning.

Documents lie in tiles of bounded size, each tile in small range blocks of rows
that were halved along their widest components. A block's summed term maxima bound what any of its rows
can score for a query (a term is a component; a negative query weight takes the
block's minimum). Each query visits the blocks of a tile by falling bound,
scores a block's rows through its forward index, and stops when the bounds fall
below its kth score. Tiles meet shards of queries by a shuffled key; the best k
of each tile are merged by a last window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.staging import released, stage
from tracemill.llm.vectors import is_finite, packed, unpack


def block_order(docs: np.ndarray, block: int = 64) -> np.ndarray:
    """Rows halved again and again along their widest component, so that neighbours share narrow ranges."""
    out, todo = [], [np.arange(len(docs))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        values = docs[rows][:, docs[rows].var(0).argmax()]
        half = len(rows) // block // 2 * block or block  # whole blocks on the left
        order = np.argpartition(values, half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out) if out else np.zeros(0, int)


#: scores beyond are given as this, or as its negative: both can be negated
MOST = (1 << 63) - 1


class Products:
    """Exact inner products of whole numbers: as doubles while no sum can reach 2^53, as 64-bit integers below 2^63, else as Python's, clamped to :data:`MOST`."""

    def __init__(self, queries: np.ndarray, docs: np.ndarray):
        most = int(np.abs(queries).max(initial=0)) * int(np.abs(docs).max(initial=0)) * docs.shape[1]
        self.large = most > MOST
        self.kind = np.float64 if most < 1 << 53 else object if self.large else np.int64

    def cast(self, values: np.ndarray) -> np.ndarray:
        return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape) if self.large else values.astype(self.kind)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a @ b.T
        return np.clip(out, -MOST, MOST).astype(np.int64) if self.large else out


def tile_top(queries: np.ndarray, query_uid: np.ndarray, docs: np.ndarray, doc_uid: np.ndarray, doc_id: np.ndarray, k: int, block: int = 64, work: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query the rows of its k best documents (-1: none) and their scores; ties go to the smaller id.

    Vectors are doubles that hold whole numbers. ``work`` gets how many (query,
    block) pairs there were, as ``all``, and how many were scored, as ``scored``.
    """
    order = block_order(docs, block)
    product = Products(queries, docs)
    queries, docs = product.cast(queries), product.cast(docs)
    blocks = [order[s : s + block] for s in range(0, len(docs), block)]
    high = np.stack([docs[b].max(0) for b in blocks])
    low = np.stack([docs[b].min(0) for b in blocks])
    zero = queries * 0
    bounds = product(np.concatenate([np.maximum(queries, zero), np.minimum(queries, zero)], 1), np.concatenate([high, low], 1))
    visit = np.argsort(-bounds, axis=1, kind="stable")
    best = np.zeros((len(queries), k), bounds.dtype)
    where = np.full((len(queries), k), -1)
    for turn in range(len(blocks)):
        at = visit[:, turn]
        live = np.flatnonzero((where[:, -1] < 0) | (bounds[np.arange(len(queries)), at] >= best[:, -1]))
        if work is not None:
            work["all"], work["scored"] = bounds.size, work.get("scored", 0) + len(live)
        if not len(live):
            break
        for b in np.unique(at[live]):
            q = live[at[live] == b]
            rows = blocks[b]
            scores = product(queries[q], docs[rows])
            others = query_uid[q][:, None] != doc_uid[rows]
            some = (others & ((scores >= best[q, -1:]) | (where[q, -1:] < 0))).any(1)
            q, scores, others = q[some], scores[some], others[some]
            if not len(q):
                continue
            all_scores = np.concatenate([best[q], scores], 1)
            all_rows = np.concatenate([where[q], np.where(others, rows, -1)], 1)
            empty = all_rows < 0
            top = np.lexsort((doc_id[all_rows], -all_scores, empty), axis=1)[:, :k]
            best[q] = np.take_along_axis(all_scores, top, 1)
            where[q] = np.take_along_axis(all_rows, top, 1)
    return where, best


def _whole(values: np.ndarray) -> np.ndarray:
    """Floors; what scaling took beyond the doubles is the largest one."""
    return np.clip(np.floor(values), -np.finfo(float).max, np.finfo(float).max)


def _score(k: int):
    def score(key: tuple, table: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_uid": [], "query_id": [], "vec_id": [], "score": []}
        if table.num_rows == 2:
            cols = {c: table.column(c).to_pylist() for c in ("is_query", "uid", "vec_id", "v")}
            q, d = (cols["is_query"].index(x) for x in (True, False))
            (q_uid, q_v), (d_uid, d_v) = (unpack(cols["uid"][i], cols["v"][i]) for i in (q, d))
            q_id, d_id = (np.frombuffer(cols["vec_id"][i], "<i8") for i in (q, d))
            where, best = tile_top(_whole(q_v), q_uid, _whole(d_v), d_uid, d_id, k)
            i, j = np.nonzero(where >= 0)
            found = {"query_uid": q_uid[i], "query_id": q_id[i], "vec_id": d_id[where[i, j]], "score": best[i, j].astype(np.int64)}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    return score


def top_k(
    vectors: DataFrame,
    k: int = 10,
    query_every: int = 100,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile_rows: int = 8192,
    shard_rows: int = 2048,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows of each query, all rows if fewer.

    Components x become floor(scale * x), of any size; what passes the doubles
    counts as the largest one. Queries are the rows whose id is divisible by
    ``query_every``; every other row is a candidate. Ties go to the smaller id.
    Scores are exact; those beyond 2^63 - 1, or below its negative, are given as
    it and tie there. Vectors that are null, empty or hold null or non-finite
    components, and rows without an id, take no part; vectors of unlike lengths
    do not meet. Rows that repeat an id are candidates, and queries, each. An
    empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(is_finite(F.col("v")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("v", F.transform("v", lambda x: x * float(scale))).withColumn("size", F.size("v"))
    rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "topk")
    is_query = F.col("vec_id") % query_every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    tiles, shards = (max(1, -(-x // y)) for x, y in ((n, tile_rows), (n_queries, shard_rows)))

    docs = packed(rows.withColumn("tile", F.pmod(F.xxhash64("uid"), F.lit(tiles))), ["size", "tile"], ["uid", "vec_id"], "v")
    asked = packed(rows.where(is_query).withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))), ["size", "shard"], ["uid", "vec_id"], "v")
    docs = docs.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("is_query", F.lit(False))
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))).withColumn("is_query", F.lit(True))
    found = docs.unionByName(asked).groupBy("size", "tile", "shard").applyInArrow(released(_score(k)), "query_uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
