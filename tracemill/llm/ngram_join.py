"""Similarity join of documents by the Jaccard index of their word n-grams.

Candidates come from a MinHash LSH forest. Every tree is a trie of signatures:
the path of a text is ``longest`` MinHash labels of eight bits, and the tries lie
as rows in the order of tree and path, where a node is a run of rows with a
common prefix. A text starts with its whole path in every tree; its matched
prefixes are shortened one label at a time, where the next node holds the fewest
texts first, until a pair at the threshold shares one of them with the target
recall. Texts of dense parts so keep long prefixes in crowded tries and take
short ones in others; lonely texts end at one depth everywhere.

How many texts a node holds is read from a table of fixed size that all texts
fill (nodes share cells); only classes of sizes count, so that whether a single
partner lies under a node does not decide whether it is opened. The recall holds
for any choice of depths.

Texts with equal words in order are one text with a weight. Documents tied by
shared prefixes form blocks, cut into tiles of bounded rows and shingles; two
tiles of a block are compared by products of their shingle incidence matrices,
so that a group of thousands of near copies costs products, not rows of pairs.
Texts travel compressed, and become shingles where they are compared; the tiles
of a large block travel in runs of a few, since each goes to all the others.
Every pair of a block is verified on the whole shingle sets, and every one that
passes is a link. Only link counts and a spanning forest leave a comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.components import Forest, connected_components
from tracemill.llm.shingles import mixed, shingle_hashes
from tracemill.llm.sketches import NO_ID, bit_filter, has_bits, hashed, merged, saturated, sliced
from tracemill.llm.staging import released, small_batches, spare_names, stage


@dataclass(frozen=True)
class JoinParams:
    width: int = 5
    threshold: float = 0.8
    trees: int = 48
    #: labels of a path, and the shortest prefix that may match
    longest: int = 8
    shortest: int = 2
    #: chance that a pair just at the threshold becomes a candidate; one in a million may be lost there
    recall: float = 0.999999
    #: cells of the table of node sizes; nodes of up to ``sparse`` texts are one class of size
    node_cells: int = 1 << 20
    sparse: int = 64
    #: rows of the tries that one task sorts, texts and shingles of a tile
    trie_rows: int = 1 << 20
    tile_rows: int = 512
    tile_shingles: int = 1 << 20
    #: tiles of one block that travel together, at most, and runs of them up to which each is a tile alone
    tiles_of_run: int = 4
    tile_runs: int = 8
    filter_bits: int = 1 << 26
    seed: int = 11


class Signer:
    """MinHash labels by multiply-shift of mixed shingle hashes."""

    def __init__(self, p: JoinParams):
        rng = np.random.default_rng(p.seed)
        self.p, size = p, p.trees * p.longest
        self.factors = rng.integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
        self.shifts = rng.integers(0, 1 << 63, size, dtype=np.uint64)

    def paths(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The path of each text (rows) in each tree, its first label in the highest byte; texts without shingles get zeros."""
        out = np.zeros((len(counts), self.p.trees), np.uint64)
        some = counts > 0
        if not some.any():
            return out
        begin = (np.cumsum(counts) - counts)[some]
        step = 1 << 16  # values at a time, in cache
        cuts = np.flatnonzero(np.diff(np.concatenate([[-1], begin // step])))
        for a, b in zip(cuts, [*cuts[1:], len(begin)]):
            lo, hi = begin[a], begin[b] if b < len(begin) else len(values)
            rows = np.flatnonzero(some)[a:b]
            for k in range(len(self.factors)):
                least = np.minimum.reduceat(values[lo:hi] * self.factors[k] + self.shifts[k], begin[a:b] - lo)
                tree, level = divmod(k, self.p.longest)
                out[rows, tree] |= (mixed(least) >> np.uint64(56)) << np.uint64(56 - 8 * level)
        return out


def prefix(paths: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """The first ``depth`` (at least 1) labels of paths, the others zero."""
    shift = (64 - 8 * np.asarray(depth)).astype(np.uint64)
    return paths >> shift << shift


def node_cells(paths: np.ndarray, depth: int, cells: int) -> np.ndarray:
    """Where the table counts the nodes of that depth, for rows of paths (a column for each tree)."""
    tags = mixed((np.arange(paths.shape[1]) * 16 + depth + 1).astype(np.uint64))
    return (mixed(prefix(paths, depth) + tags) % np.uint64(cells)).astype(np.int64)


def chosen_depths(paths: np.ndarray, sizes: np.ndarray, p: JoinParams) -> np.ndarray:
    """The depth of each text (rows) in each tree; ``sizes`` is the table of node sizes.

    Starts at the longest and shortens, in the tree whose next node is of the
    smallest class of sizes (the longest prefix among those), until the chance to
    miss a pair at the threshold is within the target.
    """
    n, depths = len(paths), range(p.shortest, p.longest + 1)
    load = max(1.0, float(np.median(sizes)))  # what other nodes bring into every cell
    crowd = np.stack([np.log2(np.maximum((sizes[node_cells(paths, d, len(sizes))] - load) / p.sparse, 1)).astype(np.int64) for d in depths], 2)
    miss = np.log1p(-(p.threshold ** np.arange(1, p.longest + 1)))
    goal = np.log1p(-p.recall)
    depth = np.full(paths.shape, p.longest)
    # of the next node: class of size, then how short the prefix is already
    cost = crowd[:, :, -2] * 64 if p.longest > p.shortest else np.zeros(paths.shape, np.int64)
    total = np.full(n, p.trees * miss[-1])
    live = np.arange(n)
    for _ in range(p.trees * (p.longest - p.shortest)):
        live = live[total[live] > goal]
        if not len(live):
            break
        tree = cost[live].argmin(1)
        d = depth[live, tree] - 1
        depth[live, tree] = d
        total[live] += miss[d - 1] - miss[d]
        ended = d == p.shortest
        cost[live, tree] = np.where(ended, 1 << 40, crowd[live, tree, np.maximum(d - 1 - p.shortest, 0)] * 64 + p.longest - d)
    return depth


def trie_ties(tree: np.ndarray, path: np.ndarray, uid: np.ndarray, depth: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """(text, another) that tie the texts of each node some text matches; rows lie in the order of tree and path.

    A text matches all texts under its prefix. Nodes at either end may go on in
    other tasks' rows, with a text there that matches them, so they always tie.
    """
    forest = Forest(len(uid))
    for d in range(p.shortest, p.longest + 1):
        at = prefix(path, d)
        start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (tree[1:] != tree[:-1])]))
        matched = np.minimum.reduceat(depth, start) <= d
        matched[[0, -1]] = True
        size = np.diff(np.append(start, len(uid)))
        first = np.repeat(start, size)
        rows = np.flatnonzero(np.repeat(matched, size) & (first != np.arange(len(uid))))
        forest.link(rows, first[rows])
    least = forest.least(uid)  # a group that is one component in many tries is tied to the same text in all
    moved = np.flatnonzero(least != uid)
    pairs = np.unique(np.stack([uid[moved], least[moved]]), axis=1)
    return pairs[0], pairs[1]


def _signatures(docs: DataFrame, p: JoinParams) -> DataFrame:
    """doc_id, key, n_shingles, words (digest of the words in order) and the paths of all trees as bytes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(p)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                values, counts, whole = shingle_hashes([t or "" for t in part.column(2).to_pylist()], p.width)
                paths = [x.tobytes() for x in signer.paths(values, counts).astype("<u8")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts.astype(np.int64)), pa.array(whole.view(np.int64)), pa.array(paths, pa.binary())],
                    names=["doc_id", "key", "n_shingles", "words", "paths"],
                )

    return docs.mapInArrow(released(sign), "doc_id long, key long, n_shingles long, words long, paths binary")


def _unpacked(column: pa.Array, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, trees)


def forest_edges(reps: DataFrame, n_reps: int, p: JoinParams) -> DataFrame:
    """(src, dst) that tie the texts (uid, paths) of every node that one of them matches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(p.node_cells, np.int64)
        for batch in batches:
            paths = _unpacked(batch.column(0), p.trees)
            for d in range(p.shortest, p.longest + 1):
                np.add.at(table, node_cells(paths, d, p.node_cells).reshape(-1), 1)
        yield sliced(np.minimum(table, (1 << 32) - 1).astype("<u4"))

    sizes = merged(reps.select("paths").mapInArrow(released(count), "slice int, cells binary"), "<u4", saturated, p.node_cells)
    sizes = reps.sparkSession.sparkContext.broadcast(sizes)  # fixed size

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, paths = batch.column(0).to_numpy(), _unpacked(batch.column(1), p.trees)
            depth = chosen_depths(paths, sizes.value, p)
            tree = np.tile(np.arange(p.trees, dtype=np.int32), len(uid))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree), pa.array(paths.reshape(-1).view(np.int64)), pa.array(np.repeat(uid, p.trees)), pa.array(depth.reshape(-1).astype(np.int32))],
                names=["tree", "path", "uid", "depth"],
            )

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        part = TaskContext.get().partitionId()
        src = dst = np.zeros(0, np.int64)
        ends = []
        if got:
            tree, path, uid, depth = (np.concatenate(c) for c in zip(*got))
            path = path.view(np.uint64)
            src, dst = trie_ties(tree, path, uid, depth, p)
            stems = prefix(path[[0, -1]], p.shortest).view(np.int64)
            ends = [(part, False, int(tree[0]), int(stems[0]), int(uid[0])), (part, True, int(tree[-1]), int(stems[1]), int(uid[-1]))]
        n, m = len(src), len(ends)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(src), pa.array([e[4] for e in ends], pa.int64())]),
                pa.concat_arrays([pa.array(dst), pa.nulls(m, pa.int64())]),
                *(pa.concat_arrays([none, pa.array([int(e[k]) for e in ends], pa.int64())]) for k in range(4)),
            ],
            names=["src", "dst", "part", "is_last", "tree", "stem"],
        )

    rows = reps.select("uid", "paths").mapInArrow(released(open_), "tree int, path long, uid long, depth int")
    # by the text too, so that a path that many texts have is split among tasks
    parts = max(1, -(-n_reps * p.trees // p.trie_rows), min(n_reps * p.trees // 1000, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    order = ["tree", "path", "uid"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stage(dealt.mapInArrow(released(tie), "src long, dst long, part long, is_last long, tree long, stem long"), "trie-ties")
    # a node may go on from the last row of a task to the first of the next that has rows: two rows for each task
    ends = found.where("dst is null")
    after = F.lead(F.struct("is_last", "tree", "stem", F.col("src").alias("uid"))).over(Window.orderBy("part", "is_last"))
    borders = ends.withColumn("after", after).where("is_last = 1 and tree = after.tree and stem = after.stem")
    return found.where("dst is not null").select("src", "dst").unionByName(borders.select("src", F.col("after.uid").alias("dst")))


def _packed(docs: DataFrame, wanted) -> DataFrame:
    """doc_id, key, size and compressed bytes of the texts of the rows that the filter lets pass: less than a third of their shingles' hashes."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codec = wanted.value, pa.Codec("zstd")
        for batch in batches:
            batch = batch.filter(pa.array(has_bits(bits, hashed(batch.column(0).to_numpy(), batch.column(1).to_numpy()))))
            raw = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            packed = [codec.compress(r, asbytes=True) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(r) for r in raw], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "key", "bytes", "packed"])

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "key", "text")
    return rows.mapInArrow(released(pick), "doc_id long, key long, bytes long, packed binary").dropDuplicates(["doc_id", "key"])


def _sets(packed: list[bytes], sizes: list[int], width: int) -> list[np.ndarray]:
    """The sorted shingle sets of some compressed texts."""
    codec, out = pa.Codec("zstd"), []
    for a in range(0, len(packed), 64):
        texts = [codec.decompress(t, n, asbytes=True).decode() for t, n in zip(packed[a : a + 64], sizes[a : a + 64])]
        values, counts, _ = shingle_hashes(texts, width)
        out += [np.unique(v) for v in np.split(values, np.cumsum(counts)[:-1])]
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray], room: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``.

    Shingles with equal holders are one column with a weight; products run over
    column blocks of ``room`` cells, so memory is bounded by the tiles' rows.
    """
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
    sizes = np.diff(np.append(start, len(flat)))
    tags = mixed(np.arange(1, len(a) + len(b) + 1).astype(np.uint64))
    alike = np.add.reduceat(tags[owner], start) if len(flat) else np.zeros(0, np.uint64)
    _, first, weight = np.unique(alike[sizes > 1], return_index=True, return_counts=True)
    held = np.flatnonzero(sizes > 1)[first]
    out = np.zeros((len(a), len(b)))
    block = max(1, room // (len(a) + len(b)))
    for c in range(0, len(held), block):
        cols = held[c : c + block]
        n = sizes[cols]
        at = np.repeat(start[cols] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        hit = np.zeros((len(a) + len(b), len(cols)), np.float32)
        hit[owner[at], np.repeat(np.arange(len(cols)), n)] = 1
        left = hit[: len(a)]
        out += (left * weight[c : c + block].astype(np.float32)) @ hit[len(a) :].T
    return out


def _compare(p: JoinParams):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        """Links within the small blocks that share a group, or between two runs of tiles (one with itself) of a large block."""
        block, uid, n, tile, second = (table.column(c).to_numpy() for c in ("component", "uid", "n", "tile", "second"))
        sets = _sets(table.column("packed").to_pylist(), table.column("bytes").to_pylist(), p.width)
        size = np.array([len(s) for s in sets])
        same = key[1].as_py() == key[2].as_py()
        links, forest = np.zeros(len(uid)), Forest(len(uid))
        order = np.lexsort((tile, block))
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            left = rows if same else rows[~second[rows]]
            right = rows if same else rows[second[rows]]
            lefts, rights = (np.split(side, np.flatnonzero(np.diff(tile[side])) + 1) for side in (left, right))
            for x, a in enumerate(lefts):
                for b in rights[x if same else 0 :]:
                    if not len(a) or not len(b):
                        continue
                    shared = overlaps([sets[i] for i in a], [sets[i] for i in b])
                    fits = shared >= p.threshold * (size[a][:, None] + size[b] - shared) - 1e-9
                    if a[0] == b[0]:
                        fits &= np.arange(len(b)) > np.arange(len(a))[:, None]
                    i, j = np.nonzero(fits)
                    i, j = a[i], b[j]
                    links += np.bincount(i, n[j], len(uid)) + np.bincount(j, n[i], len(uid))
                    forest.link(i, j)
        hit = links > 0
        return pa.table({"uid": uid[hit], "links": links[hit].astype(np.int64), "root": forest.least(uid)[hit]})

    return compare


def _classes(docs: DataFrame, p: JoinParams, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: doc_id, key (hash of the text), class_id, n_links, and kept for the rows equal to the one that stands for its class."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    signed = stage(_signatures(source, p), "signatures")
    has_words = F.col("n_shingles") > 0
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    reps = signed.where(has_words).groupBy("words").agg(
        F.min(row).alias("least"), F.count("*").alias("n"), F.any_value("n_shingles").alias("size"), F.any_value("paths").alias("paths")
    )
    reps = stage(reps.withColumn("uid", F.monotonically_increasing_id()), "texts")
    blocks = stage(connected_components(forest_edges(reps, reps.count(), p)), "blocks")

    # small blocks share groups of about a tile's size; larger ones are cut into tiles
    members = reps.drop("paths").join(blocks.withColumnRenamed("node", "uid"), "uid")
    load = F.greatest(F.count("*") / p.tile_rows, F.sum("size") / p.tile_shingles)
    sizes = members.groupBy("component").agg(F.ceil(load).cast("long").alias("tiles"))
    groups = max(1, int(members.agg(load).first()[0] or 1))
    # runs of tiles travel together: a text goes to each run of its block, and up to tile_runs runs are one for each tile
    width = F.greatest(F.lit(1), F.least(F.lit(p.tiles_of_run), F.ceil(F.col("tiles") / p.tile_runs))).cast("long")
    members = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles"))).withColumn("width", width)
    members = members.withColumn("run", F.floor(F.col("tile") / F.col("width"))).withColumn("last", F.floor((F.col("tiles") - 1) / F.col("width")))
    members = members.withColumn("grp", F.when(F.col("tiles") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(groups))))
    least = [F.coalesce("least.doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("least.key").alias("key")]
    members = stage(members.select("uid", *least, "n", "component", "tile", "run", "last", "grp"), "members")
    # one document of each member is read again; the filter of fixed size spares the others, the join is exact
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(members, [["doc_id", "key"]], p.filter_bits))
    texts = _packed(source, wanted).join(members.hint("merge"), ["doc_id", "key"])
    met = lambda a, b, second: F.struct(a.alias("t1"), b.alias("t2"), F.lit(second).alias("second"))
    to = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda r: F.when(r < F.col("run"), met(r, F.col("run"), True)).otherwise(met(F.col("run"), r, False)))
    pairs = texts.select("grp", "component", "tile", "uid", "n", "bytes", "packed", F.inline(to)).groupBy("grp", "t1", "t2")
    found = stage(pairs.applyInArrow(released(_compare(p)), "uid long, links long, root long"), "links")

    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("uid").alias("src"), F.col("root").alias("dst")))
    names = parts.join(reps.select(F.col("uid").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("class"))
    named = parts.join(names, "component").select(F.col("node").alias("uid"), "class")
    judged = reps.drop("paths").join(links, "uid", "left").join(named, "uid", "left")
    judged = judged.select("words", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class", "least").alias("class"))
    kept = F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("key") == F.col("class.key"))
    out = signed.where(has_words).join(judged, "words").select("doc_id", "key", F.col("class.doc_id").alias("class_id"), "n_links", kept.alias("kept"), F.lit(True).alias("has_words"))
    alone = signed.where(~has_words).select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), F.lit(False).alias("has_words"))
    return out.unionByName(alone)


def join_documents(docs: DataFrame, params: JoinParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Two documents link if the Jaccard index of their sets of ``width``-word
    shingles reaches the threshold. n_links counts the other documents linked
    directly, copies each. class_id is the smallest doc_id of the documents
    reachable by links. Texts with fewer words are one shingle; null texts and
    those without words link with nothing. Texts of any length are compared
    whole. Repeated rows are documents each; a class whose ids are all null has a
    null id. An empty table gives no rows; other columns are ignored.
    """
    return _classes(docs, params or JoinParams(), id_col, text_col).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame, params: JoinParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with one row of each class of linked documents: the one with the smallest id (nulls last).

    Rows are told apart by id and text, so rows that share an id, or have none,
    stay or go by their own text; of rows equal in both one stays. Texts without
    words stay, each row of them. Only rows that go, and those that are repeated,
    are shuffled with their texts.
    """
    p = params or JoinParams()
    judged = _classes(docs, p, id_col, text_col).where("has_words").groupBy("doc_id", "key").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    row_id, row_key, may, kept = spare_names(docs.columns, "row_id", "row_key", "may", "kept")
    special = judged.where("not kept or n > 1").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(row_id), F.col("key").alias(row_key), F.col("kept").alias(kept))
    special = stage(special, "not-single")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(special, [[row_id, row_key]], p.filter_bits))  # fixed size

    @F.arrow_udf("boolean")
    @released
    def may_be(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bits = wanted.value
        for ids, keys in batches:
            yield pa.array(has_bits(bits, hashed(ids.to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False))))

    keyed = docs.withColumns({row_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), row_key: F.xxhash64(F.col(text_col))})
    keyed = keyed.withColumn(may, may_be(row_id, row_key))
    met = keyed.where(may).join(special.hint("merge"), [row_id, row_key], "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = keyed.where(f"not {may}").select(*columns).unionByName(met.where(f"{kept} is null").select(*columns))
    return single.unionByName(met.where(kept).dropDuplicates([row_id, row_key]).select(*columns))
