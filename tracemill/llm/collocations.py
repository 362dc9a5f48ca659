"""Phrase collocations per language, scored exactly.

Texts become rows of all their n-grams up to ``max_n`` words (the 0-gram of a
language counts its words), summed per batch before they are shuffled and then
hash-aggregated by language and phrase. Phrases that are frequent enough meet
the counts of the two parts of each of their cuts by joins; scores are decimals.
A phrase goes if an extension of it by one word is at least half as frequent,
which one anti-join decides: between a phrase and a longer one around it lie
extensions by one word that are no rarer than the longer one. Windows rank the
rest, first within parts of a language, so that no language meets in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.staging import released, small_batches, stage

NO_LANG = "und"
#: ends of pieces become full stops, which then stand alone as tokens; bytes.split() finds no other space than this and tabs
_ENDS = bytes.maketrans(b",;:!?\n\x0b\f\r", b"." * 9)


def _tokens(text: bytes, step: int = 1 << 22) -> Iterator[list[bytes]]:
    """Words and full stops of a text, which ends with one, some ``step`` bytes at a time; ASCII capitals become small."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + step) if at + step < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].lower().translate(_ENDS).replace(b".", b" . ").split()
        at = end
    yield [b"."]


class _Counter:
    """n-grams of a stream of tokens, summed whenever ``held`` tokens have come; those that end in a later sum keep the tokens before it."""

    def __init__(self, max_n: int, held: int, bounds: list[tuple[bytes, ...]]):
        self.max_n, self.held, self.bounds = max_n, held, bounds
        self.langs: dict[str, int] = {}
        self.parts: list[pa.Array] = []
        self.sizes: list[tuple[int, int]] = []  # lang, tokens
        self.waiting: list[bytes] = []
        self.size = self.carried = 0

    def feed(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        code = self.langs.setdefault(lang, len(self.langs))
        for tokens in _tokens(text):
            self.waiting += tokens
            self.sizes.append((code, len(tokens)))
            self.size += len(tokens)
            if len(self.waiting) > 100_000:
                self._pack()
            if self.size >= self.held:
                yield from self.flush()

    def _pack(self) -> None:
        self.parts.append(pa.array(self.waiting, pa.binary()))
        self.waiting = []

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._pack()
        tokens = pa.chunked_array(self.parts, pa.binary()).combine_chunks()
        lang = np.repeat(*(np.array(x, np.int64) for x in (zip(*self.sizes) if self.sizes else ([], []))))
        begin, keep = self.carried, min(self.max_n - 1, len(tokens))
        last = tokens.slice(len(tokens) - keep)
        rest = [(int(c), 1) for c in lang[len(lang) - keep :]]
        self.parts, self.sizes, self.size, self.carried = [last], rest, keep, keep
        yield from _sums(tokens, lang, begin, self.max_n, list(self.langs), self.bounds)


def _sums(tokens: pa.Array, lang: np.ndarray, begin: int, max_n: int, names: list[str], bounds: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams that end at ``begin`` or later, one row for each language, n and zone.

    A phrase is numbered by its first n - 1 words, a phrase too, and its last
    word; only the distinct ones are ever joined to strings, in order of their
    words. ``bounds`` part that order into zones.
    """
    coded = tokens.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    place = np.empty(len(words), np.int64)
    place[order.to_numpy()] = np.arange(len(words))
    word = place[coded.indices.to_numpy()]
    stop = pc.index(words, pa.scalar(b".", pa.binary())).as_py()
    ends = np.flatnonzero(word != stop)  # places of the last words of the phrases in hand
    ids, langs, phrases, before = lang, np.arange(len(names)), pa.array([b""] * len(names), pa.binary()), None
    for n in range(max_n + 1):
        if n == 0:
            keys, ids_at = np.arange(len(names)), lang[ends]
        else:
            if n > 1:
                ends = ends[(ends > 0) & before[ends - 1]]
            keys, ids_at = np.unique(ids[ends - (n > 1)] * len(words) + word[ends], return_inverse=True)
            first, final = keys // len(words), pa.array(keys % len(words))
            langs = langs[first]
            phrases = words.take(final) if n == 1 else pc.binary_join_element_wise(phrases.take(pa.array(first)), words.take(final), b" ")
            ids = np.zeros(len(word), np.int64)
            ids[ends] = ids_at
            before = np.zeros(len(word), bool)
            before[ends] = True
        counts = np.bincount(ids_at[ends >= begin], minlength=len(keys))
        seen = np.flatnonzero(counts)
        counts, said, of_lang = pa.array(counts[seen].astype(np.int64)), phrases.take(pa.array(seen)), langs[seen]
        rows: dict[str, list] = {"zone": [], "lang": [], "begin": []}
        for code in np.unique(of_lang):
            low, high = (int(np.searchsorted(of_lang, code, side)) for side in ("left", "right"))
            key = lambda i: tuple(said[i].as_py().split(b" ")) if n else ()
            cuts = [low]
            for bound in bounds:
                cuts.append(bisect_left(range(high), bound, lo=cuts[-1], key=key))
            for zone, (at, end) in enumerate(zip(cuts, [*cuts[1:], high])):
                if at < end:
                    for k, v in zip(rows, (zone, names[code], at)):
                        rows[k].append(v)
        starts = pa.array([*rows["begin"], len(seen)], pa.int32())
        text = pc.binary_join(pa.ListArray.from_arrays(starts, said), b"\n").cast(pa.string(), safe=False)
        columns = [pa.array(rows["zone"], pa.int32()), pa.array(rows["lang"], pa.string()), pa.array([n] * len(text), pa.int32()), text, pa.ListArray.from_arrays(starts, counts)]
        yield pa.RecordBatch.from_arrays(columns, ["zone", "lang", "words", "phrases", "counts"])


def _count(max_n: int, held: int, bounds: list[tuple[bytes, ...]]):
    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(max_n, held, bounds)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    yield from counter.feed(lang, text or b"")
        yield from counter.flush()

    return count


def _starts(max_n: int, each: int):
    """Up to ``each`` phrases of ``max_n`` words from evenly spread places of every text."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                tokens = [t for part in _tokens(text or b"") for t in part]
                found += [b" ".join(tokens[i : i + max_n]) for i in range(0, len(tokens), max(1, -(-len(tokens) // each))) if tokens[i] != b"."]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["phrase"])

    return starts


def phrase_counts(docs: DataFrame, max_n: int = 3, text_col: str = "text", lang_col: str = "lang", held: int = 1_000_000, spread: int = 4) -> DataFrame:
    """lang, words, phrase (space-joined), a: how often each n-gram of up to ``max_n`` words occurs within the pieces of all whole texts.

    The phrase of no words, one a language, counts its words. A worker sums some
    ``held`` words at once. Its phrases travel in order of their words, those of
    a language, n and zone as one row, and become rows of their own after the
    shuffle, where zones, ``spread`` times as many as shuffles have partitions,
    hold them for the hash aggregation. Phrases of some 2000 texts, 50 of each,
    come to the driver as bounds between zones: they balance the work and do not
    touch the result.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    zones = spread * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = texts.sample(min(1.0, 2000 / max(1, docs.count())), seed=1).mapInArrow(_starts(max_n, 50), "phrase binary").limit(200_000)
    taken = sorted({tuple(bytes(r["phrase"]).split(b" ")) for r in sample.collect()})
    bounds = sorted({taken[i * len(taken) // zones] for i in range(1, zones)}) if taken else []
    packed = texts.mapInArrow(_count(max_n, held, bounds), "zone int, lang string, words int, phrases string, counts array<long>")
    packed = packed.repartitionById(zones, "zone")
    phrases = packed.select("zone", "lang", "words", F.inline(F.arrays_zip(F.split("phrases", "\n").alias("phrase"), F.col("counts").alias("a"))))
    return phrases.groupBy("zone", "lang", "words", "phrase").agg(F.sum("a").alias("a")).drop("zone")


def _part(phrase: str, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def collocations(
    docs: DataFrame,
    max_n: int = 3,
    min_count: int = 10,
    cover_percent: int = 50,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    parts: int = 200,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of each language's ``top`` phrases of 2 to ``max_n`` words.

    ``a`` (at least ``min_count``) counts the phrase, ``n`` all words of its
    language, ``l`` and ``r`` the two parts of its lowest-scoring cut (of equal
    scores the earliest): floor(1000000 * a * a / (l * r)), exact for counts
    below 10^15. Phrases go that lie in a longer counted one with at least
    ``cover_percent`` per cent of their count. Order: score, a (both falling),
    phrase by its bytes. Null texts count as empty, null languages as ``und``;
    repeated rows count each; texts are counted whole, words of any length too.
    Only A to Z are lower-cased. An empty table gives no rows. Other columns are
    ignored.
    """
    counts = phrase_counts(docs, max_n, text_col, lang_col).where((F.col("words") == 0) | (F.col("a") >= min_count))
    counts = stage(counts, "collocations")
    found = counts.where("words >= 2")
    known = counts.where("words >= 1").select("lang", "phrase", "a")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _part("phrase", 1, F.col("k")), "right": _part("phrase", F.col("k") + 1, F.col("words"))})
    cuts = cuts.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    product = F.lit(1_000_000).cast("decimal(7,0)") * (exact["a"] * exact["a"])
    cuts = cuts.withColumns({"above": product, "below": exact["l"] * exact["r"]}).withColumn("score", F.expr("above div below"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    longer = found.where("words >= 3").withColumn("size", F.col("words") - 1)
    longer = longer.withColumn("phrase", F.explode(F.array(_part("phrase", 1, F.col("size")), _part("phrase", 2, F.col("size")))))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = (scored["lang"] == longer["lang"]) & (scored["phrase"] == longer["phrase"]) & (longer["longer"] * 100 >= scored["a"] * cover_percent)
    kept = scored.join(longer, covered, "left_anti")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: the definition, over the table ``documents`` with the parameters above
DUCKDB_SQL = r"""
    WITH w AS (
        SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS p
            FROM documents WHERE text IS NOT NULL)
    ), grams AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k
    ), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, k, phrase, a FROM f WHERE k >= 2 AND a >= 10),
    cuts AS (
        SELECT c.lang, c.phrase, c.a, cut, f1.a AS l, f2.a AS r,
               (1000000::HUGEINT * c.a * c.a) // (f1.a::HUGEINT * f2.a) AS score
        FROM (SELECT *, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS v FROM c) c
        JOIN f f1 ON f1.lang = c.lang AND f1.phrase = array_to_string(c.v[1:cut], ' ')
        JOIN f f2 ON f2.lang = c.lang AND f2.phrase = array_to_string(c.v[cut + 1:], ' ')
    ), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    kept AS (
        SELECT * FROM lowest x WHERE NOT EXISTS (
            SELECT 1 FROM c y
            WHERE y.lang = x.lang AND y.k = 3 AND 100 * y.a >= 50 * x.a AND len(string_split(x.phrase, ' ')) = 2
              AND x.phrase IN (array_to_string(string_split(y.phrase, ' ')[1:2], ' '), array_to_string(string_split(y.phrase, ' ')[2:3], ' ')))
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
