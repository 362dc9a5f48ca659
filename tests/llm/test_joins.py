"""Similarity joins, vector search and the corpus pipeline against brute force, with odd tables."""

import random
import re
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import embedding_dedup, line_dedup, ngram_join, topk
from tracemill.llm import shingles as shingles_
from tracemill.llm.components import Forest, connected_components

WORDS = re.compile(f"[{shingles_.ALONE}]|(?:[a-z0-9]|[^\\x00-\\x7f{shingles_.SEPARATORS}{shingles_.ALONE}])+").findall


def words(text):
    return WORDS((text or "").lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(ids, pairs):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (5, 5)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(3, 1), (None, 2), (3, 1)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == classes({x for e in real for x in e}, real)


def test_forest():
    f = Forest(6)
    f.link(np.array([5, 4]), np.array([4, 3]))
    f.link(np.array([3, 0]), np.array([1, 2]))
    assert f.label.tolist() == [0, 1, 0, 1, 1, 1]


def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choices("aeioutnrslm", k=rng.randint(2, 7))) for _ in range(800)]
    base = [" ".join(rng.choices(vocab, k=rng.choice([3, 8, 60, 150]))) for _ in range(60)]
    texts = list(base)
    for _ in range(200):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [None, "", " . ", base[0].upper() + "!", "one", "one", "long " * 4000, "long " * 4001, base[3] + " " + base[4]]
    return [(i, t, 1, "c") for i, t in enumerate(texts)]


def test_ngram_join_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_links int, class_id string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join_documents(docs).collect()}
    sets = {i: shingles(t) for i, t, *_ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = classes(sets, pairs)
    links = {i: sum(i in p for p in pairs) for i in sets}
    found = sum(v[1] for v in got.values())
    assert got.keys() == sets.keys() and all(got[i][1] <= links[i] for i in sets)  # exact: no false link
    assert found >= 0.99 * sum(links.values())
    assert sum(got[i][0] == want[i] for i in sets) >= 0.98 * len(sets)


def test_ngram_join_of_large_groups_by_tiles(spark):
    rng = random.Random(7)
    base = [str(rng.random()) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"w{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = ngram_join.JoinParams(tile_rows=20)
    got = ngram_join.join_documents(docs, p).collect()
    sets = [shingles(t) for _, t in rows]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert {r["class_id"] for r in got} == {0} and all(r["n_links"] <= want[r["doc_id"]] for r in got)
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(want)


def test_ngram_join_keeps_every_verified_link_of_a_block(spark):
    """Every pair of the 100 variants is at Jaccard 0.8 or more; they form one block, so no link may be missing."""
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[: i + 3] + [f"x{i}"] + base[i + 4 :])) for i in range(1, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.join_documents(docs, ngram_join.JoinParams(trees=6, recall=0.9)).collect()}
    sets = [shingles(t) for _, t in rows]
    assert got == {i: sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for i, a in enumerate(sets)}


def test_ngram_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join_documents(docs).collect()), key=str)
    assert got == sorted([(None, 5, 3), (None, 5, 3), (5, 5, 3), (5, 5, 3), (7, 7, 0)], key=str)
    assert ngram_join.join_documents(docs.where("false")).count() == 0


def paths_of_pairs(n, common=40, own=5, seed=5):
    """Paths of ``n`` pairs of sets with a Jaccard index of 0.8 exactly (40 common values of 50)."""
    rng, p = np.random.default_rng(seed), ngram_join.JoinParams()
    values = rng.integers(0, 1 << 63, (n, common), dtype=np.uint64)
    signer = ngram_join.Signer(p)
    return [signer.paths(np.concatenate([values, rng.integers(0, 1 << 63, (n, own), dtype=np.uint64)], 1).reshape(-1), np.full(n, common + own)) for _ in range(2)]


def table_of(paths, p):
    out = np.zeros(p.node_cells, np.int64)
    for d in range(p.shortest, p.longest + 1):
        np.add.at(out, ngram_join.node_cells(paths, d, p.node_cells).reshape(-1), 1)
    return out


def test_depths_reach_the_recall_and_differ_between_parts():
    """Lonely texts end at one depth; texts of a dense part keep long prefixes in crowded tries and take short ones elsewhere."""
    p, rng = ngram_join.JoinParams(), np.random.default_rng(6)
    lonely = rng.integers(0, 1 << 63, (300, p.trees), dtype=np.uint64)
    dense = rng.integers(0, 1 << 63, (2000, p.trees), dtype=np.uint64)
    dense[:, :30] = dense[0, :30]  # in 30 of the 48 tries they share one path
    both = np.concatenate([lonely, dense])
    depth = ngram_join.chosen_depths(both, table_of(both, p), p)
    miss = np.log1p(-(p.threshold ** depth)).sum(1)
    assert (miss <= np.log1p(-p.recall)).all()
    assert (depth[:300].max(1) - depth[:300].min(1) <= 1).mean() > 0.95 and depth[:300].min() >= 6
    assert (depth[300:, :30] == p.longest).mean() > 0.9 and (depth[300:, 30:] < 6).mean() > 0.9


def test_pairs_at_the_threshold_meet():
    """Each of 4000 pairs shares a prefix that one of the two matches."""
    p = ngram_join.JoinParams()
    left, right = paths_of_pairs(4000)
    table = table_of(np.concatenate([left, right]), p)
    depth = np.minimum(ngram_join.chosen_depths(left, table, p), ngram_join.chosen_depths(right, table, p))
    assert (ngram_join.prefix(left, depth) == ngram_join.prefix(right, depth)).any(1).all()


@pytest.mark.parametrize("cut", [None, 7, 100])
def test_ties_of_the_tries_against_brute_force(cut):
    """Every text is tied to all others under a prefix that it matches, also where tasks part the rows of a trie."""
    rng, p = np.random.default_rng(3), ngram_join.JoinParams(trees=3)
    paths = rng.integers(0, 2, (60, 3, 8), dtype=np.uint64)
    paths = (paths << (np.uint64(56) - 8 * np.arange(8, dtype=np.uint64))).sum(2).astype(np.uint64)
    depth = rng.integers(3, 9, (60, 3))
    tree, uid = np.tile(np.arange(3), 60), np.repeat(np.arange(60), 3)
    path, want_depth = paths.reshape(-1), depth.reshape(-1)
    order = np.lexsort((uid, path, tree))
    tree, path, uid, want_depth = tree[order], path[order], uid[order], want_depth[order]
    edges = []
    for a in range(0, len(uid), cut or len(uid)):
        rows = slice(a, a + (cut or len(uid)))
        edges += list(zip(*(x.tolist() for x in ngram_join.trie_ties(tree[rows], path[rows], uid[rows], want_depth[rows], p))))
        if a and tree[a] == tree[a - 1] and ngram_join.prefix(path[a : a + 1], 2) == ngram_join.prefix(path[a - 1 : a], 2):
            edges.append((int(uid[a]), int(uid[a - 1])))
    tied = classes(range(60), edges)
    for i in range(60):
        for t in range(3):
            under = ngram_join.prefix(paths[:, t], int(depth[i, t])) == ngram_join.prefix(paths[i : i + 1, t], int(depth[i, t]))
            assert all(tied[i] == tied[j] for j in np.flatnonzero(under).tolist())


def test_ngram_join_by_many_tasks(spark):
    """Tries parted among many tasks give the same classes."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, n_links int, class_id string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    many = ngram_join.join_documents(docs, ngram_join.JoinParams(trie_rows=900)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(many) == sorted(ngram_join.join_documents(docs).collect())


def test_one_of_each_class_goes_by_rows(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue black white pink grey brown")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (None, b, "z"), (None, c, "u"), (None, c, "u"), (7, None, "n"), (7, None, "n"), (8, "", "n"), (9, b.upper(), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row_id` string")
    got = sorted(map(tuple, ngram_join.one_of_each_class(docs).collect()), key=str)
    assert got == sorted([(1, a, "x"), (5, b, "y"), (None, c, "u"), (7, None, "n"), (7, None, "n"), (8, "", "n")], key=str)


def brute_lines(rows, threshold=0.8):
    lines = [(d, i, frozenset(words(line)), line) for d, t in sorted(rows) for i, line in enumerate((t or "").split("\n"))]
    out = {d: [] for d, _ in rows}
    for k, (d, i, s, line) in enumerate(lines):
        gone = s and any(o and len(o & s) >= threshold * len(o | s) and (e, j) != (d, i) for e, j, o, _ in lines[:k])
        if not gone:
            out[d].append(line)
    return {d: "\n".join(v) for d, v in out.items()}


def test_words_against_the_pattern():
    rng, seen = random.Random(1), {}
    letters = "ab1 é—“”«» 日本語、。カ ｶx\n\0ºµª　！Ａ한글😀½⁰ヿ㐀-"
    for _ in range(1500):
        t = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        texts = [t, "a" * 700 + " " + "a" * 701, "", t]
        got = shingles_.word_hashes(texts)[0].tolist()
        want = [w for x in texts for w in words(x)]
        assert len(got) == len(want) and all(seen.setdefault(w, h) == h for w, h in zip(want, got))
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("frequent", "short_words"), [(4096, 128), (0, 128), (2, 8)])
def test_line_dedup_against_brute_force(spark, frequent, short_words):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("aeioutnrs", k=4)) for _ in range(150)]
    base = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 12, 40]))) for _ in range(40)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(1, 8)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            lines.append(rng.choice(["", " ", "-- "]) + " ".join(w) + rng.choice(["", ".", "\r"]))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "...\n...\n"), (104, "w " * 5000 + "\n" + "x" * 9000), (105, "\n".join(f"{i} a{i} b{i} c{i} d{i}" for i in range(5000)))]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_removed int")
    out = line_dedup.dedup_lines(docs, line_dedup.LineParams(frequent=frequent, short_words=short_words, tile_rows=16))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    want = brute_lines([r for r in rows if r[0] < 104]) | {100: None}
    assert {d: got[d] for d in want} == want and got[105].count("\n") == 4999
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]


def test_hot_prefix_words_leave_their_group():
    """Template lines share their rarest words: their entries are tied where they are, and only one row for each size is ordered."""
    rng, p = np.random.default_rng(3), line_dedup.LineParams(count_cells=64)
    key, uid = np.repeat([5, 9], [4000, 50]), rng.permutation(4050)
    cols = [x.astype(kind) for x, (kind, _) in zip((key, uid, rng.integers(8, 12, 4050), key * 0, key * 0, key * 0), line_dedup._ENTRY)]
    hot = np.bincount(line_dedup._cell(cols[0], 64), minlength=64) > 1000
    packed = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([b"".join(c.tobytes() for c in cols)], pa.binary())], names=["part", "prefixes"])
    cold = next(line_dedup._cold(types.SimpleNamespace(value=hot))(iter([packed]))).column(1)[0].as_py()
    assert set(line_dedup._entries(cold)[0]) == {9} and len(line_dedup._entries(cold)[0]) == 50
    ties = next(line_dedup._hot_ties(types.SimpleNamespace(value=hot))(iter([packed]))).to_pandas()
    assert len(ties) == 4000 and (ties.uid == ties.least).sum() == 4 and set(ties.key) == {5}
    assert (ties.groupby("size").uid.min() == ties.groupby("size").least.max()).all()


def test_line_dedup_of_template_lines_by_hot_words(spark):
    names = [f"t{i}" for i in range(12)]
    rows = [(d, "\n".join(" ".join(names[: 6 + (d + i) % 7]) + f" {7 * d + i} {d % 3}" for i in range(6))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = line_dedup.dedup_lines(docs, line_dedup.LineParams(hot_rows=20, tile_rows=16))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(rows)


def test_candidates_of_the_filters_hold_every_match():
    """Every pair of matching sets shares a key and passes the filters, whatever the rarity of the words."""
    rng = np.random.default_rng(8)
    vocab = np.array([f"w{i}" for i in range(60)])
    lines = []
    for _ in range(400):
        n = rng.choice([4, 5, 9, 12, 20])
        base = rng.choice(vocab[: rng.choice([24, 60])], n, replace=False)
        lines.append(" ".join(base))
        lines.append(" ".join([*base[: n - n // 9 - (n > 8)], *rng.choice(vocab, n // 9)]))
    p = line_dedup.LineParams(frequent=150, short_words=12)
    counts = np.zeros(p.count_cells)
    np.add.at(counts, (shingles_.word_hashes(lines)[0] % np.uint64(p.count_cells)).astype(int), 1)
    got = line_dedup.Lines(["\n".join(lines)], np.minimum(np.log2(counts + 1) * 100, 4095).astype(np.uint16))
    of, key, most = line_dedup.prefix_keys(got, p)
    assert (got.size[of] <= 12).any() and (got.size[of] > 12).any()
    a, b = line_dedup.candidate_links((key >> np.uint64(32)).astype("<u4"), of, got.size[of], most, got.maps[:, of], p)
    tied = classes(range(len(lines)), list(zip(a.tolist(), b.tolist())))
    sets = [frozenset(x.split()) for x in lines]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 100 and all(tied[i] == tied[j] for i, j in near)


def test_line_dedup_of_clashing_columns(spark):
    line = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(1, line, 7, 8, True), (2, line, 7, 8, True)], "doc_id long, Text string, N_Removed int, `key` int, may boolean")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "Text", "key", "may", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, line, 8, True, 1, 0), (2, "", 8, True, 1, 1)]


def test_line_dedup_of_odd_tables(spark):
    line = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(None, line, "a"), (1, line, "b"), (2, line + "\nother words here", "c"), (2, line + "\nother words here", "c")], "doc_id long, text string, kind string")
    got = sorted((r["kind"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [("a", line, 1, 0), ("b", "", 1, 1), ("c", "other words here", 2, 1), ("c", "other words here", 2, 1)]
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 24))
    rows = [b.tolist() for b in base]
    for _ in range(250):
        rows.append((base[rng.integers(40)] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.35])).tolist())
    rows += [rows[0], rows[0], [0.0] * 24, [float("nan")] + rows[1][1:], [float("inf")] * 24, [None] + rows[1][1:], None, [], [1.0, 2.0], [2.0, 4.0], [-x for x in rows[2]]]
    return rows


def usable(v):
    return v and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("tile_rows", [4096, 32])
def test_near_duplicates_against_brute_force(spark, tile_rows):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "l") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, kept string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, tile_rows=tile_rows).collect()}
    ok = [i for i, v in enumerate(rows) if usable(v) and any(v)]
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))
    pairs = [(i, j) for i in ok for j in ok if i < j and len(rows[i]) == len(rows[j]) and cos(rows[i], rows[j]) >= 0.95]
    want = classes(range(len(rows)), pairs)
    assert got == {i: (sum(i in p for p in pairs), want[i], want[i] == i) for i in range(len(rows))}


def test_near_duplicates_of_tiny_and_huge_vectors(spark):
    rows = [[1e-200, 2e-200], [2e-200, 4e-200], [1e200, 2e200], [1e300, -1e300], [3.0, 6.1], [5e-324, 0.0], [7.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (0, 3), 4: (3, 0), 5: (1, 5), 6: (1, 5)}


def test_cells_that_cannot_link_do_not_meet():
    rng = np.random.default_rng(2)
    centres = np.eye(12)[:8] * 3
    rows = (centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 12)) * 0.1)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    front = embedding_dedup.principal_axes(rows)[:, :8]
    nodes = embedding_dedup.halvings(rows @ front, 32)
    cell = embedding_dedup.cells_of(rows @ front, nodes)
    assert set(cell) <= set(range(32)) and np.bincount(cell).max() < 1000
    low, high = (np.stack([f((rows @ front)[cell == c], 0) for c in np.unique(cell)]) for f in (np.min, np.max))
    near = embedding_dedup.near_cells(low, high, np.sqrt(0.1))
    number = np.searchsorted(np.unique(cell), cell)
    i, j = np.nonzero(rows @ rows.T >= 0.95)
    assert near[number[i], number[j]].all() and near.mean() < 0.8


def test_blocks_below_the_kth_score_are_skipped():
    """Clustered rows: most blocks are never scored, and the result is that of all products."""
    rng = np.random.default_rng(4)
    docs = (rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] * 1000 + rng.normal(size=(3000, 16)) * 20).astype(int)
    work: dict = {}
    where, best = topk.tile_top(docs[:50].astype(float), np.arange(50), docs.astype(float), np.arange(3000), np.arange(3000), 10, work=work)
    assert 0 < work["scored"] < 0.5 * work["all"]
    scores = docs[:50] @ docs.T
    scores[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    assert (np.sort(scores, 1)[:, :-11:-1] == best).all()


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (9, None)], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (9, 0, 9, True)], key=str)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize(("tile_rows", "shard_rows", "dims"), [(8192, 2048, 24), (40, 2, 24), (64, 5, 3)])
def test_top_k_against_brute_force(spark, tile_rows, shard_rows, dims):
    rows = [v[:dims] if v else v for v in vectors()]
    ids = [i * 5 for i in range(len(rows))]
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, rows)], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in topk.top_k(df, tile_rows=tile_rows, shard_rows=shard_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in zip(ids, rows) if usable(v)}
    want = {}
    for q, a in whole.items():
        if q % 100 == 0:
            best = sorted(((-int(np.dot(a, b)), i) for i, b in whole.items() if i != q and len(a) == len(b)))[:10]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


@pytest.mark.parametrize("size", [1e4, 1e5, 1e6, 3e9, 1e200, 1.7e308])
def test_top_k_of_large_components(spark, size):
    """Sums beyond 2^53, beyond 2^63 (clamped, ties by id) and components beyond the doubles once scaled."""
    rng = np.random.default_rng(8)
    rows = rng.uniform(-1, 1, (130, 6)) * size
    rows[::7] /= 1e3
    df = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(x)) for x in np.clip(v * 1024.0, -np.finfo(float).max, np.finfo(float).max)] for v in rows]
    most = (1 << 63) - 1
    want = set()
    for q in range(0, 130, 10):
        scores = sorted((-max(-most, min(most, sum(x * y for x, y in zip(whole[q], v)))), i * 10) for i, v in enumerate(whole) if i != q)
        want |= {(q * 10, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])}
    for tile_rows in (8192, 16):
        assert {tuple(r) for r in topk.top_k(df, tile_rows=tile_rows, shard_rows=5).collect()} == want


@pytest.mark.parametrize("most", [10**4, 10**8, 1.2 * 10**16, 10**30])
def test_tiles_lose_no_row_however_large_the_scores(most):
    rng = np.random.default_rng(9)
    docs = np.floor(rng.uniform(-1, 1, (200, 4)) * np.sqrt(most / 4))
    where, best = topk.tile_top(docs[:3], np.arange(3), docs, np.arange(200), np.arange(200), 10, block=16)
    assert (where >= 0).sum() == 30 and best.shape == (3, 10)


def test_top_k_of_odd_tables(spark):
    df = spark.createDataFrame([(100, [1.0]), (100, [1.0]), (None, [9.0]), (7, [0.5])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    assert got == [(100, 1, 100, 1048576), (100, 1, 100, 1048576), (100, 2, 7, 524288), (100, 2, 7, 524288)]
    assert topk.top_k(df.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp

    rng = random.Random(9)
    vocab = ["".join(rng.choices("aeioutnrslm", k=6)) for _ in range(3000)]
    text = lambda n=60: " ".join(rng.choices(vocab, k=n))
    rows = [(i, text() + ("\nyou stupid moron idiot" if i % 5 == 0 else ""), "en", "s", 9) for i in range(200)]
    shared = "\n".join(text(20) for _ in range(3))
    rows += [(300, shared, "en", "s", 9), (301, shared, "en", "s", 9), (302, shared + "\n" + text(), "en", "s", 9), (303, None, None, None, None), (304, "", "en", "s", 0), (None, text(), "en", "s", 9)]
    rows += [rows[1], rows[1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(200)], "doc_id long, toxic int, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    kept = cp.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sum(i is not None and i < 200 and i % 5 == 0 for i in ids) <= 4 and sum(i is None or i >= 200 or i % 5 > 0 for i in ids) >= 0.97 * (len(rows) - 40)
    lines = {r["doc_id"]: r for r in cp.drop_repeated_lines(spark, docs, sf).collect()}
    assert lines[300]["text"] == shared and 301 not in lines and lines[302]["text"] == rows[202][1].split("\n")[-1] and lines[302]["n_chars"] == len(lines[302]["text"])
    assert lines[303]["text"] is None and 304 in lines and None in lines
    one = [r["doc_id"] for r in cp.keep_one_of_each_class(spark, docs, sf).collect()]
    assert one.count(1) == 1 and 300 in one and 301 not in one and {303, 304, None} <= set(one)
    assert cp.run(spark, sf).select("doc_id").distinct().count() > 150
    clash = docs.withColumn("score", F.lit("mine")).withColumn("N_Lines", F.lit("mine"))
    for f in (cp.drop_toxic, cp.drop_repeated_lines, cp.keep_one_of_each_class):
        out = f(spark, clash, sf)
        assert out.columns == clash.columns and out.where("score <> 'mine' or N_Lines <> 'mine'").count() == 0
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_pipeline_drops_copies_with_blank_lines(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp

    text = "alpha beta gamma delta\n\nepsilon zeta eta theta"
    docs = spark.createDataFrame([(1, text, 9), (2, text, 9), (3, " \n..", 4), (4, text + "\nother words", 9)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in cp.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: text, 3: " \n..", 4: "\nother words"}


def test_many_ties_of_a_group_become_a_star(spark):
    """A group whose texts meet in every trie brings fewer edges into the joins than it has texts; tries that hold it in other orders tie it to one text."""
    from tracemill.llm import components

    pick = random.Random(3)
    edges = {(max(e), min(e)) for e in ((pick.randrange(300), pick.randrange(300)) for _ in range(20_000)) if e[0] != e[1]}
    df = spark.createDataFrame(sorted(edges), "hi long, lo long").repartition(8)
    assert components._contracted(df, len(edges)).count() <= 2 * 299 < len(edges) / 10
    p, uid = ngram_join.JoinParams(), np.array([5, 9, 2, 7])
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]):
        ties = ngram_join.trie_ties(np.zeros(4, np.int32), np.zeros(4, np.uint64), uid[order], np.full(4, p.longest), p)
        assert sorted(zip(*(x.tolist() for x in ties))) == [(5, 2), (7, 2), (9, 2)]


def test_texts_travel_in_fewer_bytes_than_their_shingles():
    texts = [" ".join(f"w{i * k % 997}" for i in range(400)) for k in range(1, 20)]
    codec = pa.Codec("zstd")
    raw = [t.encode() for t in texts]
    packed = [codec.compress(r, asbytes=True) for r in raw]
    sets = ngram_join._sets(packed, [len(r) for r in raw], 5)
    assert all(len(a) == len(shingles(t)) for a, t in zip(sets, texts)) and sum(map(len, packed)) < sum(s.nbytes for s in sets) / 2
