"""Collocations against a brute-force count, and on odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, A string, phrase int"


def words_of(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split("[.,;:!?\x0a-\x0d]", small) if (w := re.findall("[^\x20\x09]+", p))]


def brute(docs, max_n, min_count, percent, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for w in words_of(text):
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in known.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            if any(inside(q) and 100 * b >= percent * a for q, b in known.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def random_docs(seed, rows=60):
    pick = random.Random(seed)
    signs = ["a", "b", "B", "é", "É", "cc", "d d", "x", " ", " y", "the"]
    ends = [" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\x0b", "?! "]
    return [(i, "".join(pick.choice(signs) + pick.choice(ends) for _ in range(pick.randint(0, 60))), pick.choice(["en", "en", "fr", None, "und", ""]), "x", 1) for i in range(rows)]


@pytest.mark.parametrize("max_n,min_count,percent,top", [(3, 2, 50, 2000), (2, 3, 50, 5), (4, 2, 80, 30)])
def test_equals_brute_force(spark, max_n, min_count, percent, top):
    docs = random_docs(max_n) + [(None, None, "en", None, None), (1, "", "de", "x", 1), (2, "a B. a b, A b", None, "x", 1)] + random_docs(max_n)[:7]
    got = c.collocations(spark.createDataFrame(docs, SCHEMA).repartition(3), max_n, min_count, percent, top, parts=4)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, max_n, min_count, percent, top)


def test_small_memories_and_long_texts_change_nothing(spark, monkeypatch):
    docs = [(1, "la la lo " * 30_000, "en", "x", 1), (2, "w" * 100_000 + " la lo, la " + "w" * 100_000 + " la", "en", "x", 1)]
    table = spark.createDataFrame(docs, SCHEMA)
    want = Counter()
    for _, text, *_ in docs:
        for w in words_of(text):
            for k in (1, 2, 3):
                want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
            want[""] += len(w)
    for held in (3, 400_000):
        assert {r["phrase"]: r["a"] for r in c.phrase_counts(table, held=held).collect()} == want


def test_tokens_are_the_same_however_a_text_is_cut():
    text = b"A b\tc d, E.f  \xc3\x89 g!?h \x00 i"
    for step in (1, 2, 5, 100):
        assert sum(c._tokens(text, step), []) == [b"a", b"b", b"c", b"d", b".", b"e", b".", b"f", b"\xc3\x89", b"g", b".", b".", b"h", b"\x00", b"i", b"."]
    assert list(c._tokens(b"")) == [[b"."]]


def test_scores_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 4_000_000_009, 5_000_000_029
    row = spark.range(1).select(*(F.lit(x).cast("decimal(19,0)").alias(n) for n, x in (("a", a), ("l", l), ("r", r))))
    row = row.selectExpr("(CAST(1000000 AS DECIMAL(7,0)) * (a * a)) div (l * r) AS score")
    assert row.first()["score"] == 1_000_000 * a * a // (l * r)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.collocations(empty).count() == 0
    assert c.collocations(spark.createDataFrame([(1, "...", "en", "x", 1), (2, None, None, "x", 1)], SCHEMA)).count() == 0
