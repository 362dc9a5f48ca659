"""All pairs of vectors with a cosine at or above a threshold, by PCA-ordered tiles.

Equal vectors become one with a weight. The rest are cut into cells by halving
along the principal components in turn, cells into tiles of bounded size. Before
anything is shuffled, the boxes that bound two cells on the leading components
tell whether a link between them is possible; only tiles of such cells meet.
Within two tiles the leading components are
accumulated first; what the others can add is bounded by the norms of the
suffixes, and the work stops where no cosine can reach the threshold. Pairs
that stay possible are judged by the cosine of the vectors as they were given.

A comparison returns link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.components import Forest, connected_components
from tracemill.llm.staging import released, stage
from tracemill.llm.vectors import is_finite, packed, scaled, unpack

SLACK = 1e-9  # above the rounding of rotated sums


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """An orthonormal basis (columns) by falling variance."""
    return np.linalg.eigh(sample.T @ sample / max(len(sample), 1))[1][:, ::-1]


def tile_links(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray, threshold: float, lead: int = 16, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``a`` and ``b`` (of ``a`` alone, once each, if None) with cosine >= threshold, some rows at a time."""
    same = b is None
    b = a if same else b
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    ra, rb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    cuts = [*range(lead, a.shape[1], lead)]

    def rest(r: np.ndarray, cut: int) -> np.ndarray:
        return np.sqrt((r[:, cut:] ** 2).sum(1))

    rest_b = [rest(rb, c) for c in cuts]
    for s in range(0, len(a), rows):
        part = ra[s : s + rows]
        total, begin = np.zeros((len(part), len(b))), 0
        alive = None
        for cut, tail in zip(cuts, rest_b):
            total += part[:, begin:cut] @ rb[:, begin:cut].T
            begin = cut
            alive = total + rest(part, cut)[:, None] * tail >= threshold - SLACK
            if same:
                alive &= np.arange(len(b)) > np.arange(s, s + len(part))[:, None]
            if np.count_nonzero(alive) <= 0.05 * alive.size:
                break
        else:
            total += part[:, begin:] @ rb[:, begin:].T
            alive = total >= threshold - SLACK
            if same:
                alive &= np.arange(len(b)) > np.arange(s, s + len(part))[:, None]
        i, j = np.nonzero(alive)
        i += s
        for c in range(0, len(i), 200_000):
            x, y = i[c : c + 200_000], j[c : c + 200_000]
            ok = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            yield x[ok], y[ok]


def halvings(places: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree of cuts of sample rows (columns: leading components): (component, cut, child below, child at or above).

    A child below 0 is the cell ``-1 - child``. Nodes are cut at the median of
    one component after the other, until there are ``cells`` cells.
    """
    nodes: list[tuple[int, float, int, int]] = []
    done = 0

    def grow(rows: np.ndarray, share: int, level: int) -> int:
        nonlocal done
        if share <= 1:
            done += 1
            return -done
        at, axis = len(nodes), level % places.shape[1]
        nodes.append((0, 0.0, 0, 0))
        values = places[rows, axis]
        cut = float(np.quantile(values, (share // 2) / share)) if len(rows) else 0.0
        nodes[at] = (axis, cut, grow(rows[values < cut], share // 2, level + 1), grow(rows[values >= cut], share - share // 2, level + 1))
        return at

    grow(np.arange(len(places)), cells, 0)
    return nodes


def cells_of(places: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of each row, from 0."""
    at = np.zeros(len(places), np.int64) if nodes else np.full(len(places), -1)
    while (at >= 0).any():
        for k in np.unique(at[at >= 0]).tolist():
            axis, cut, below, above = nodes[k]
            rows = np.flatnonzero(at == k)
            at[rows] = np.where(places[rows, axis] < cut, below, above)
    return -1 - at


def near_cells(low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
    """Whether the boxes (rows of bounds) of two cells come within ``reach``."""
    out = np.zeros((len(low), len(low)))
    for k in range(low.shape[1]):
        gap = np.maximum(np.maximum(low[:, None, k] - high[None, :, k], low[None, :, k] - high[:, None, k]), 0)
        out += gap * gap
    return out <= reach * reach


def _compare(axes: np.ndarray, threshold: float, kind: str):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, weights, data, swap = (table.column(c).to_pylist() for c in ("uid", "n", "v", "second"))
        tiles = [(*unpack(ids[k], data[k], kind), np.frombuffer(weights[k], "<i8")) for k in sorted(range(len(ids)), key=lambda k: swap[k])]
        first, second = tiles[0], tiles[-1]
        same = len(tiles) == 1
        own_axes = axes if first[1].shape[1] == len(axes) else np.eye(first[1].shape[1])
        shift = 0 if same else len(first[0])
        uid = first[0] if same else np.concatenate([first[0], second[0]])
        weight = first[2] if same else np.concatenate([first[2], second[2]])
        links, forest = np.zeros(len(uid)), Forest(len(uid))
        for i, j in tile_links(first[1], None if same else second[1], own_axes, threshold):
            j = j + shift
            links += np.bincount(i, weight[j], len(uid)) + np.bincount(j, weight[i], len(uid))
            forest.link(i, j)
        hit = links > 0
        return pa.table({"uid": uid[hit], "links": links[hit].astype(np.int64), "root": uid[forest.label[hit]]})

    return compare


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile_rows: int = 16_384,
    max_cells: int = 2048,
    leading: int = 8,
    sample_rows: int = 20_000,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Cosines are computed in double precision. Vectors that are null, empty, all
    zero or hold null or non-finite components link with nothing; those of
    unlike lengths do not link. Each row counts as a vector, repeated ones too.
    A component is named by its smallest vec_id; rows with a null id get a null
    one when they link with no other id. The axes are fitted on ``sample_rows``
    rows at most (the first by a hash); they order the work and never change the
    result. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    # floats stay floats until they are compared, which halves what is shuffled
    short = dict(vectors.dtypes)[vector_col] == "array<float>"
    v = F.col(vector_col) if short else scaled(F.col(vector_col).cast("array<double>"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(vector_col).alias("given"))
    usable = is_finite(F.col("given")) & F.exists("given", lambda x: x != 0)
    reps = rows.where(usable).groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    reps = stage(reps.withColumn("uid", F.monotonically_increasing_id()), "vectors")

    total = reps.count()
    sample = reps.orderBy(F.xxhash64("uid")).limit(sample_rows).select("v").toArrow().column(0).combine_chunks()
    widths = np.diff(sample.offsets.to_numpy()) if len(sample) else np.zeros(0, int)
    width = int(np.bincount(widths).argmax()) if len(widths) else 1
    fitted = sample.flatten().to_numpy()[np.repeat(widths == width, widths)].reshape(-1, width).astype(float) if len(widths) else np.ones((1, 1))
    fitted = fitted / np.sqrt((fitted**2).sum(1, keepdims=True))
    axes = principal_axes(fitted)
    front = axes[:, :leading]
    # two unit vectors that differ by more than reach have a smaller cosine, whatever the components
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    n_cells = int(max(1, min(max_cells, -(-total // tile_rows))))
    nodes = halvings(fitted @ front, n_cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            cell, lead = np.zeros(len(sizes), np.int64), np.zeros((len(sizes), front.shape[1]))
            own = sizes == width
            if own.any():
                unit = lists.flatten().to_numpy()[np.repeat(own, sizes)].reshape(-1, width).astype(float)
                lead[own] = (unit / np.sqrt((unit * unit).sum(1, keepdims=True))) @ front
                cell[own] = cells_of(lead[own], nodes)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * front.shape[1], pa.int32()), pa.array(lead.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(cell.astype(np.int32)), flat, lists], names=["uid", "n", "size", "cell", "lead", "v"])

    kind = "float" if short else "double"
    placed = reps.select("uid", "n", "v").mapInArrow(released(place), f"uid long, n long, size int, cell int, lead array<double>, v array<{kind}>")
    placed = stage(placed, "placed")
    # at most max_cells rows for each vector length
    bounds = [f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(front.shape[1]) for name, f in (("low", F.min), ("high", F.max))]
    counts = placed.groupBy("size", "cell").agg(F.count("*").alias("c"), *bounds).orderBy("size", "cell").collect()
    table = []
    for size in sorted({r["size"] for r in counts}):
        of_size = [r for r in counts if r["size"] == size]
        low, high = (np.array([[r[f"{name}{k}"] for k in range(front.shape[1])] for r in of_size]) for name in ("low", "high"))
        near = near_cells(low, high, reach)
        for i, r in enumerate(of_size):
            met = np.flatnonzero(near[i])
            others = [(of_size[j]["cell"], -(-of_size[j]["c"] // tile_rows)) for j in met.tolist()]
            table.append((size, r["cell"], -(-r["c"] // tile_rows), others))
    cells = F.broadcast(spark.createDataFrame(table, "size int, cell int, tiles long, others array<struct<cell int, tiles long>>"))
    tiled = placed.join(cells.drop("others"), ["size", "cell"]).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")))
    tiles = stage(packed(tiled, ["size", "cell", "tile"], ["uid", "n"], "v"), "tiles")

    def partners(second: bool) -> DataFrame:
        out = tiles.join(cells.select("size", "cell", "others"), ["size", "cell"]).withColumn("o", F.explode("others")).drop("others")
        out = out.withColumn("other_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o.tiles") - 1))).withColumn("other", F.col("o.cell"))
        mine, theirs = ("cell", "tile"), ("other", "other_tile")
        left, right = (theirs, mine) if second else (mine, theirs)
        out = out.select(
            "size", F.col(left[0]).alias("c1"), F.col(left[1]).alias("t1"), F.col(right[0]).alias("c2"), F.col(right[1]).alias("t2"),
            F.lit(second).alias("second"), "uid", "n", "v",
        )
        ordered = "c1 < c2 or (c1 = c2 and t1 < t2)"
        return out.where(ordered if second else f"{ordered} or (c1 = c2 and t1 = t2)")

    found = partners(False).unionByName(partners(True)).groupBy("size", "c1", "t1", "c2", "t2")
    found = stage(found.applyInArrow(released(_compare(axes, threshold, "<f4" if short else "<f8")), "uid long, links long, root long"), "links")

    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("uid").alias("src"), F.col("root").alias("dst")))
    names = parts.join(reps.select(F.col("uid").alias("node"), "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = parts.join(names, "component").select(F.col("node").alias("uid"), "component_id")
    judged = reps.join(links, "uid", "left").join(named, "uid", "left")
    judged = judged.select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = rows.where(usable).join(judged, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
