"""Removal of repeated and nearly repeated lines by an exact set-similarity join.

A line is the set of its words. The words of a line are ordered by rarity, from
counts over all documents; lines whose Jaccard index reaches the threshold must
then share a word within short prefixes, at positions and with sizes that leave
room for enough common words. Lines that pass those filters are tied into
blocks; in a block the whole sets are compared, by products of their incidence
matrices, and a line goes if an earlier one matches it.

A prefix word that many lines hold is refined by the next common word: two lines
that first meet at a frequent word must meet again within prefixes that are one
word longer, so such lines are grouped by both words. What still gathers more
lines than one task may hold shares words far beyond chance and is tied without
the filters. Counts live in a table of fixed size (words share cells, which only
coarsens the order); prefixes travel as packed columns; pairs never become rows.
Words are compared by hashes of 52 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.components import Forest, connected_components
from tracemill.llm.ngram_join import overlaps
from tracemill.llm.shingles import LINE_END, SEPARATORS, TEXT_END, mixed, word_hashes
from tracemill.llm.sketches import NO_ID, bit_filter, has_bits, hashed, merged, saturated, sliced
from tracemill.llm.staging import drop_stage, released, small_batches, spare_names, stage, without

HAS_WORD = re.compile(f"[0-9A-Za-z]|[^\\x00-\\x7f{SEPARATORS}]").search


@dataclass(frozen=True)
class LineParams:
    threshold: float = 0.8
    #: cells of the word counts and of the filter of line sets, both of fixed size
    count_cells: int = 1 << 20
    filter_bits: int = 1 << 26
    #: words that occur more often are joined by pairs of words, in lines of at most ``short_words`` words
    frequent: int = 4096
    short_words: int = 128
    #: prefix entries of a cell of keys, above which its keys are not gathered but tied where they are
    hot_rows: int = 1 << 16
    tile_rows: int = 512


class Lines:
    """The distinct words of all lines of some texts, as 64-bit hashes; lines without words have none."""

    def __init__(self, texts: list[str], counts: np.ndarray | None):
        words, starts, data, ends = word_hashes(texts)
        breaks = np.flatnonzero((data == LINE_END) | (data == TEXT_END))
        line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(starts, breaks), prepend=0))
        self.total = len(breaks)
        last = np.searchsorted(breaks, ends)
        self.per_text = np.diff(np.concatenate([[-1], last]))
        self.text = np.repeat(np.arange(len(texts)), self.per_text)
        self.number = np.arange(self.total) - np.repeat(last + 1 - self.per_text, self.per_text)
        plain = words >> np.uint64(12)
        rank = np.zeros(len(words), np.uint64) if counts is None else counts[words % np.uint64(len(counts))].astype(np.uint64)
        if self.total < 4096:  # line, rarity and word in one key, which sorts several times as fast
            order = np.argsort((line.astype(np.uint64) << np.uint64(52)) | (rank << np.uint64(40)) | (plain >> np.uint64(12)))
        else:
            order = np.lexsort((plain >> np.uint64(12), rank, line))
        plain, line, rank = plain[order], line[order], rank[order]
        new = np.ones(len(plain), bool)
        new[1:] = (plain[1:] != plain[:-1]) | (line[1:] != line[:-1])
        self.plain, self.line = plain[new], line[new]
        #: rarity above the word, so that equal values are equal words
        self.word = (rank[new] << np.uint64(52)) | self.plain
        self.size = np.bincount(self.line, minlength=self.total)
        self.first = np.cumsum(self.size) - self.size
        total = np.zeros(self.total, np.uint64)
        some = self.size > 0
        if some.any():
            spread = mixed(self.plain)
            total[some] = np.add.reduceat(spread, self.first[some])
        self.key = mixed(total + self.size.astype(np.uint64))  # of the set, whatever the order
        if counts is None:
            return
        #: each word flips one of 128 bits (two halves); two sets differ in at least as many words as their maps do in bits
        self.maps = np.zeros((2, self.total), np.uint64)
        if some.any():
            flip, half = np.uint64(1) << (spread >> np.uint64(58)), (spread >> np.uint64(57)) & np.uint64(1)
            for h in (0, 1):
                self.maps[h, some] = np.bitwise_xor.reduceat(np.where(half == h, flip, np.uint64(0)), self.first[some])


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def rarity(docs: DataFrame, p: LineParams) -> np.ndarray:
    """For each cell the logarithm of how often its words occur in all documents, in 12 bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(p.count_cells, np.int64)
        for _, texts in _batches(batches):
            np.add.at(table, (word_hashes(texts)[0] % np.uint64(p.count_cells)).astype(np.int64), 1)
        yield sliced(np.minimum(table, (1 << 32) - 1).astype("<u4"))

    total = merged(docs.mapInArrow(released(count), "slice int, cells binary"), "<u4", saturated, p.count_cells)
    return np.minimum(np.log2(total + 1.0) * 100, 4095).astype(np.uint16)


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def prefix_keys(lines: Lines, p: LineParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, most) of every prefix entry: two lines that match share a key, and have at most the smaller ``most`` words in common.

    The key is the first common word, or, where that is frequent, the first two.
    Lines near ``short_words`` have keys of both kinds, since one of the two may be longer.
    A set of fewer than 4 words is similar to none but itself and has none.
    """
    size = lines.size[lines.line]
    place = np.arange(len(lines.word)) - lines.first[lines.line]
    within = (place < prefix_length(size, p.threshold)) & (size >= 4)
    rank = (lines.word >> np.uint64(52)).astype(np.int64)
    # a word that occurs once in all documents is in no other line
    within &= rank > 100
    frequent = rank > np.log2(p.frequent + 1.0) * 100
    one = np.flatnonzero(within & (~frequent | (size > p.threshold * p.short_words)))
    first = np.flatnonzero(within & frequent & (size <= p.short_words))
    # the second common word lies within a prefix that is one word longer
    left = np.minimum(prefix_length(size[first], p.threshold) + 1, size[first]) - place[first] - 1
    left = np.maximum(left, 0)
    two = np.repeat(first, left)
    second = two + 1 + np.arange(len(two)) - np.repeat(np.cumsum(left) - left, left)
    key = np.concatenate([mixed(lines.plain[one]), mixed(mixed(lines.plain[two]) + lines.plain[second])])
    most = np.concatenate([size[one] - place[one], size[two] - place[second] + 1])
    return np.concatenate([lines.line[one], lines.line[two]]), key, most


def candidate_links(key: np.ndarray, uid: np.ndarray, size: np.ndarray, most: np.ndarray, maps: np.ndarray, p: LineParams) -> tuple[np.ndarray, np.ndarray]:
    """(set, another of its group) for all sets that some shared key ties to another; keys are of 32 bits."""
    at = (key.astype(np.uint64) << np.uint64(32)) | size.astype(np.uint64)
    order = np.argsort(at)
    at, uid, size, most, maps = at[order], uid[order], size[order].astype(np.int64), most[order].astype(np.int64), maps[:, order]
    names, local = np.unique(uid, return_inverse=True)
    forest = Forest(len(names))
    # each line is tested with those after it in its group, as far as the length filter allows
    longest = np.floor(size / p.threshold + 1e-9).astype(np.uint64)
    upto = np.searchsorted(at, (at & np.uint64(0xFFFFFFFF00000000)) | np.minimum(longest, np.uint64(0xFFFFFFFF)), side="right")
    n = upto - np.arange(len(at)) - 1
    done = np.cumsum(n)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + (1 << 19), side="right")))
        for a in range(0, int(n[begin]) if end == begin + 1 else 1, 1 << 20):  # one line may have more than fit
            some = np.minimum(n[begin:end] - a, 1 << 20)
            i = np.repeat(np.arange(begin, end), some)
            j = i + 1 + a + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
            both = size[i] + size[j]
            room = both - 2 * np.ceil(p.threshold / (1 + p.threshold) * both - 1e-9).astype(np.int64)
            ok = np.flatnonzero(np.bitwise_count(maps[0, i] ^ maps[0, j]) <= room)
            i, j, both, room = i[ok], j[ok], both[ok], room[ok]
            apart = np.bitwise_count(maps[0, i] ^ maps[0, j]).astype(np.int64) + np.bitwise_count(maps[1, i] ^ maps[1, j])
            ok = (apart <= room) & (2 * np.minimum(most[i], most[j]) >= both - room)
            forest.link(local[i[ok]], local[j[ok]])
        begin = end
    moved = np.flatnonzero(forest.label != np.arange(len(names)))
    return names[moved], names[forest.label[moved]]


def _first_places(docs: DataFrame, counts, p: LineParams, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first place of every line set, links between sets that may match, and how many lines with words each document has; one pass over the texts.

    The prefixes are packed into ``parts`` groups of keys. Each task also counts
    the entries of its keys in a table of fixed size; keys of cells with more
    than ``hot_rows`` are in no group, see :func:`_hot_ties`.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        held: dict[str, list[np.ndarray]] = {c: [] for c in ("uid", "doc", "line", "key", "of", "size", "most", "low", "high")}
        room = 0
        entries = np.zeros(p.count_cells, np.int64)

        def flush() -> pa.RecordBatch:
            c = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in held.items()}
            by = np.lexsort((c["line"], c["doc"], c["uid"]))
            uid = c["uid"][by]
            lead = np.concatenate([[True], uid[1:] != uid[:-1]]) if len(uid) else np.zeros(0, bool)
            by = by[lead]
            # groups of keys, and one entry for each key and set
            full = c["key"].astype(np.uint64)
            group = full % np.uint64(parts)
            near = np.argsort((group << np.uint64(44)) | (mixed(full + mixed(c["of"].astype(np.uint64))) >> np.uint64(20)))
            key, of = (full >> np.uint64(32)).astype("<u4")[near], c["of"][near]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            near, key = near[new], key[new]
            np.add.at(entries, _cell(key, p.count_cells), 1)
            bounds = np.searchsorted(group[near], np.arange(parts + 1).astype(np.uint64))
            used = np.flatnonzero(np.diff(bounds))
            cols = [key, c["of"][near], c["size"][near].astype("<u4"), c["most"][near].astype("<u4"), c["low"][near], c["high"][near]]
            blobs = [b"".join(x[bounds[g] : bounds[g + 1]].tobytes() for x in cols) for g in used]
            named, lines_of = np.unique(c["doc"].astype(np.int64), return_counts=True)
            n, m, d = len(by), len(used), len(named)
            # rows of three kinds: first places, packed prefixes, and documents (whose number of lines stands under line)
            first = {k: pa.array(c[k][by].astype(np.int64)) for k in ("uid", "doc", "line")}
            cols = [
                pa.concat_arrays([first["uid"], pa.nulls(m + d, pa.int64())]),
                pa.concat_arrays([first["doc"], pa.nulls(m, pa.int64()), pa.array(named)]),
                pa.concat_arrays([first["line"], pa.nulls(m, pa.int64()), pa.array(lines_of.astype(np.int64))]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(used.astype(np.int64)), pa.nulls(d, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(blobs, pa.binary()), pa.nulls(d, pa.binary())]),
            ]
            for v in held.values():
                v.clear()
            return pa.RecordBatch.from_arrays(cols, names=["uid", "doc_id", "line", "part", "prefixes"])

        for ids, texts in _batches(batches):
            lines = Lines(texts, order)
            doc = np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64)
            real = lines.size > 0
            uid = lines.key.view(np.int64)
            held["uid"].append(uid[real])
            held["doc"].append(doc[lines.text[real]])
            held["line"].append(lines.number[real])
            of, key, most = prefix_keys(lines, p)
            held["key"].append(key)
            held["of"].append(uid[of])
            held["size"].append(lines.size[of])
            held["most"].append(most)
            for half, bits in zip(("low", "high"), lines.maps.view(np.int64)):
                held[half].append(bits[of])
            room += len(of) + int(real.sum())
            if room > 600_000:
                room = 0
                yield flush()
        yield flush()
        if entries.any():  # rows of a fourth kind: the slices of the counts, under negative parts
            table = sliced(np.minimum(entries, p.hot_rows + 1).astype("<u4"))
            none = pa.nulls(table.num_rows, pa.int64())
            part = pa.array(-1 - table.column(0).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([none, none, none, part, table.column(1)], names=["uid", "doc_id", "line", "part", "prefixes"])

    both = stage(docs.mapInArrow(released(cut), "uid long, doc_id long, line long, part long, prefixes binary"), "line-sets", hashes=True)
    firsts = both.where("uid is not null").groupBy("uid").agg(F.min(F.struct("doc_id", "line")).alias("at")).select("uid", "at.doc_id", "at.line")
    firsts = stage(firsts, "line-firsts")
    tables = both.where("part < 0").select((-1 - F.col("part")).cast("int").alias("slice"), F.col("prefixes").alias("cells"))
    hot = merged(tables, "<u4", saturated, p.count_cells) > p.hot_rows
    prefixes = both.where("part >= 0").select("part", "prefixes")
    if hot.any():
        cells = docs.sparkSession.sparkContext.broadcast(hot)  # fixed size
        ties = stage(prefixes.mapInArrow(released(_hot_ties(cells)), "key long, size long, uid long, least long"), "line-ties")
        links = _chained(ties, p).unionByName(
            prefixes.mapInArrow(released(_cold(cells)), "part long, prefixes binary").groupBy("part").applyInArrow(released(_candidates(p)), "src long, dst long")
        )
    else:
        links = prefixes.groupBy("part").applyInArrow(released(_candidates(p)), "src long, dst long")
    links = stage(links, "line-links")
    sizes = both.where("uid is null and part is null").groupBy("doc_id").agg(F.sum("line").alias("n"))
    sizes = stage(sizes, "line-counts")
    drop_stage(both)
    return firsts, links, sizes


def _cell(key: np.ndarray, cells: int) -> np.ndarray:
    return (mixed(key.astype(np.uint64)) % np.uint64(cells)).astype(np.int64)


#: an entry of packed prefixes: key, set, size and most as in :func:`prefix_keys`, and the two halves of the map; column by column
_ENTRY = (("<u4", 4), ("<i8", 8), ("<u4", 4), ("<u4", 4), ("<u8", 8), ("<u8", 8))


def _entries(packed: bytes) -> list[np.ndarray]:
    n, at, out = len(packed) // sum(w for _, w in _ENTRY), 0, []
    for kind, width in _ENTRY:
        out.append(np.frombuffer(packed, kind, n, at))
        at += n * width
    return out


def _cold(hot):
    """The packed prefixes without the keys of hot cells."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, left = [], []
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cols = _entries(packed)
                cold = ~hot.value[_cell(cols[0], len(hot.value))]
                if cold.any():
                    parts.append(part)
                    left.append(b"".join(c[cold].tobytes() for c in cols))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(left, pa.binary())], names=["part", "prefixes"])

    return keep


def _hot_ties(hot):
    """Every set under a key of a hot cell, and the least set of that key and size among the same packed prefixes."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(1).to_pylist():
                key, uid, size = _entries(packed)[:3]
                own = hot.value[_cell(key, len(hot.value))]
                key, uid, size = key[own].astype(np.int64), uid[own], size[own].astype(np.int64)
                order = np.lexsort((uid, size, key))
                key, uid, size = key[order], uid[order], size[order]
                lead = np.ones(len(key), bool)
                lead[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1])
                least = uid[lead][np.cumsum(lead) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, size, uid, least)], names=["key", "size", "uid", "least"])

    return tie


def _chained(ties: DataFrame, p: LineParams) -> DataFrame:
    """Links that tie the sets of each key as neighbours in the order of size: a superset of the pairs that may match.

    Only the least sets are ordered by key: at most one row for each size and
    each pack of prefix entries of a task.
    """
    by_size = Window.partitionBy("key").orderBy("size", "uid")
    leasts = ties.where("uid = least").select("size", "uid", F.lag("uid").over(by_size).alias("before"), F.lag("size").over(by_size).alias("smaller"))
    tied = leasts.where(F.col("smaller") >= p.threshold * F.col("size") - 1e-9).select(F.col("uid").alias("src"), F.col("before").alias("dst"))
    return tied.unionByName(ties.where("uid <> least").select(F.col("uid").alias("src"), F.col("least").alias("dst")))


def _candidates(p: LineParams):
    def find(key: tuple, table: pa.Table) -> pa.Table:
        cols = [np.concatenate(c) for c in zip(*(_entries(x) for x in table.column("prefixes").to_pylist()))]
        a, b = candidate_links(*cols[:4], np.stack(cols[4:]), p)
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    return find


def _block_sets(docs: DataFrame, wanted, p: LineParams) -> DataFrame:
    """uid and sorted words (bytes) of the lines that the filter of places lets pass; others than wanted ones may pass too."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            doc = batch.column(0).fill_null(NO_ID).to_numpy()
            batch = batch.filter(pa.array(has_bits(bits, hashed(doc))))
            for ids, texts in _batches(iter([batch])):
                lines = Lines(texts, None)
                doc = ids.fill_null(NO_ID).to_numpy()
                rows = np.flatnonzero((lines.size > 0) & has_bits(bits, hashed(doc[lines.text], lines.number)))
                sets = [np.sort(lines.plain[lines.first[r] : lines.first[r] + lines.size[r]]).tobytes() for r in rows.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(lines.key.view(np.int64)[rows]), pa.array(sets, pa.binary())], names=["uid", "words"])

    return docs.mapInArrow(released(pick), "uid long, words binary")


def _matched(p: LineParams):
    def match(key: tuple, table: pa.Table) -> pa.Table:
        """The sets that an earlier one of their block matches, among the two tiles (or one) of a group."""
        block, uid, doc, line, second = (table.column(c).to_numpy() for c in ("component", "uid", "doc_id", "line", "second"))
        raw = table.column("words").to_pylist()
        same = key[1].as_py() == key[2].as_py()
        gone = np.zeros(len(uid), bool)
        rank = np.empty(len(uid), np.int64)
        rank[np.lexsort((uid, line, doc))] = np.arange(len(uid))
        order = np.argsort(block, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            left = rows if same else rows[~second[rows]]
            right = rows if same else rows[second[rows]]
            if not len(left) or not len(right) or same and len(rows) < 2:
                continue
            a, b = ([np.frombuffer(raw[i], np.uint64) for i in side] for side in (left, right))
            shared = overlaps(a, b)
            sizes = [np.array([len(s) for s in side]) for side in (a, b)]
            fits = shared >= p.threshold * (sizes[0][:, None] + sizes[1] - shared) - 1e-9
            earlier = rank[left][:, None] < rank[right]
            gone[right] |= (fits & earlier).any(0)
            gone[left] |= (fits & (rank[left][:, None] > rank[right])).any(1)
        return pa.table({"uid": pa.array(uid[gone], pa.int64())})

    return match


def kept_lines(docs: DataFrame, params: LineParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, line) of every line with words that stays, and (doc_id, n) of all lines with words; a null doc_id is ``sketches.NO_ID``."""
    p = params or LineParams()
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(rarity(source, p))  # fixed size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), source.rdd.getNumPartitions())
    firsts, links, sizes = _first_places(source, counts, p, parts)
    blocks = stage(connected_components(links), "line-blocks")

    n = blocks.count()
    if n:
        tiles = blocks.groupBy("component").agg(F.ceil(F.count("*") / p.tile_rows).cast("long").alias("tiles"))
        members = blocks.withColumnRenamed("node", "uid").join(tiles, "component").join(firsts, "uid")
        members = members.withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")))
        groups = F.lit(max(1, n // p.tile_rows))
        members = members.withColumn("grp", F.when(F.col("tiles") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), groups)))
        # two columns: a group number must not meet a component of that name
        members = stage(members.withColumn("large", F.col("tiles") > 1), "line-members")
        wanted = spark.sparkContext.broadcast(bit_filter(members, [["doc_id"], ["doc_id", "line"]], p.filter_bits))  # fixed size
        sets = stage(members.join(_block_sets(source, wanted, p).dropDuplicates(["uid"]), "uid"), "line-words")
        ahead = sets.withColumn("t2", F.explode(F.sequence("tile", F.col("tiles") - 1)))
        ahead = ahead.select("*", F.col("tile").alias("t1"), F.lit(False).alias("second"))
        behind = sets.where("tile > 0").withColumn("t1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile") - 1)))
        behind = behind.select("*", F.col("tile").alias("t2"), F.lit(True).alias("second"))
        columns = ["grp", "t1", "t2", "large", "component", "second", "uid", "doc_id", "line", "words"]
        pairs = ahead.select(columns).unionByName(behind.select(columns)).groupBy("grp", "t1", "t2", "large")
        gone = pairs.applyInArrow(released(_matched(p)), "uid long").distinct()
        firsts = firsts.join(gone, "uid", "left_anti")
    return firsts.select("doc_id", "line"), sizes


def dedup_lines(docs: DataFrame, params: LineParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of the lines that stay, and n_lines and n_removed.

    Lines are ordered by document id, then position. A line goes if an earlier
    line of any document has a Jaccard index of word sets at or above the
    threshold, whether or not that one stays. Lines without words always stay.
    Null texts stay null, with no lines; null ids come first and count as one
    document, as do rows that repeat an id: equal places do not remove each
    other. Input columns named n_lines or n_removed, in any case, are replaced;
    all others pass through. Texts and lines of any length are compared whole.
    An empty table gives no rows.
    """
    p = params or LineParams()
    small_batches(docs.sparkSession)
    places, sizes = kept_lines(docs, p, id_col, text_col)
    kept = without(docs.columns, "n_lines", "n_removed")
    key, stays, loses, may, cut = spare_names([*kept, "doc_id", "n"], "key", "stays", "loses", "may", "cut")
    left = places.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias(stays), F.count("*").alias("n_kept"))
    # a row for each document that loses a line: only those texts are shuffled
    losers = sizes.join(left, "doc_id", "left").where(F.coalesce("n_kept", F.lit(0)) < F.col("n"))
    losers = stage(losers.select(F.col("doc_id").alias(key), stays, F.lit(True).alias(loses)), "line-losers")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(losers, [[key]], p.filter_bits))  # fixed size

    @F.arrow_udf("boolean")
    @released
    def may_lose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = wanted.value
        for keys in batches:
            yield pa.array(has_bits(bits, hashed(keys.to_numpy(zero_copy_only=False))))

    @F.arrow_udf("text string, n_lines long, n_removed long")
    @released
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, stay in batches:
            out, n, removed = [], [], []
            for a in range(0, len(texts), 256):
                for text, at in zip(texts.slice(a, 256).to_pylist(), stay.slice(a, 256).to_pylist()):
                    lines, keep = (text or "").split("\n"), set(at or ())
                    left = [t for i, t in enumerate(lines) if i in keep or not HAS_WORD(t)]
                    out.append("\n".join(left))
                    n.append(len(lines) if text else 0)
                    removed.append(len(lines) - len(left))
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["text", "n_lines", "n_removed"])

    keyed = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias(key))
    keyed = keyed.withColumn(may, may_lose(key))
    # losers grow with the corpus, so no broadcast at any size
    met = keyed.where(may).join(losers.hint("merge"), key, "left")
    short = met.where(loses).withColumn(cut, apply(F.col(text_col), F.col(stays)))
    columns = [F.when(F.col(c).isNotNull(), F.col(f"{cut}.text")).alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in kept]
    short = short.select(*columns, f"{cut}.n_lines", f"{cut}.n_removed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = F.when(text != "", F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0).cast("long")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f"`{c}`") for c in kept), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))

    return short.unionByName(whole(met.where(f"{loses} is null"))).unionByName(whole(keyed.where(f"not {may}")))
