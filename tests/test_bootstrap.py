"""The Poisson bootstrap against the same counts by hand, and against the exact one."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.operators import bootstrap, metrics


def table(spark, seed, scores):
    pick = random.Random(seed)
    score = {"one": lambda i: 0.5, "unlike": lambda i: (i * 7919 % 1000) / 1000, "some": lambda i: pick.choice([0.1, 0.4, 0.4, 0.9, -2.0, None])}[scores]
    rows = [(pick.choice(["a", "a", "b"]), i // 2, score(i), pick.randint(0, 1)) for i in range(500)]
    return rows, spark.createDataFrame(rows, "family string, k long, score double, label int").repartition(4)


def value(score, label, w):
    """AUROC over all weighted pairs of a positive and a negative."""
    p, n = label == 1, label == 0
    ahead = (score[p][:, None] > score[n]) + 0.5 * (score[p][:, None] == score[n])
    whole = w[p].sum() * w[n].sum()
    return (ahead * w[p][:, None] * w[n]).sum() / whole if whole else 0.0


@pytest.mark.parametrize("scores", ["one", "unlike", "some"])
@pytest.mark.parametrize(("ranges", "common"), [(1, 64), (9, 1), (5, 10**9), (6, 20)])
def test_equals_counts_by_hand(spark, scores, ranges, common):
    rows, df = table(spark, 1, scores)
    known = [r for r in rows if r[2] is not None]
    number = lambda *s: int(hashlib.md5("|".join(map(str, s)).encode()).hexdigest()[:8], 16) % bootstrap.PRIME
    factor = bootstrap.factors(8, "poisson")
    assert factor[0][3] == number("poisson", "a", 3) and factor[2][7] == number("poisson", "b", 7)
    for by in (None, "family"):
        got = bootstrap.poisson_auc(df, "k", 8, by, ranges=ranges, common=common)
        found = {(r[by] if by else None, r["replicate"]): r["value"] for r in got.collect()}
        for g in {r[0] for r in known} if by else {None}:
            mine = [r for r in known if g in (None, r[0])]
            xy = np.array([[number("poisson", c, r[1]) for c in "xy"] for r in mine])
            w = bootstrap.weights(xy, factor)
            score, label = np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
            for r in range(8):
                assert found.pop((g, r)) == pytest.approx(value(score, label, w[:, r]), abs=1e-12)
        assert not found


def test_empty(spark):
    assert bootstrap.poisson_auc(table(spark, 1, "one")[1].where("false"), "k", 4).count() == 0


def test_counts_are_poisson():
    xy = np.random.default_rng(0).integers(0, bootstrap.PRIME, (5000, 2))
    w = bootstrap.weights(xy, bootstrap.factors(40, "poisson"))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w.T)[np.triu_indices(40, 1)]).max() < 0.08  # replicates are independent
    assert np.abs(np.corrcoef(w[:300])[np.triu_indices(300, 1)]).mean() < 0.15  # so are rows


def test_interval_is_that_of_the_exact_bootstrap(spark):
    pick = random.Random(6)
    pairs = spark.createDataFrame([(i, "all", pick.gauss(0.6, 0.2), pick.gauss(0.5, 0.2)) for i in range(400)], "k long, family string, pos_score double, neg_score double")
    exact, poisson = (metrics.pair_intervals(pairs, "family", "k", 1000, method=m).first() for m in ("exact", "poisson"))
    for c in ("auroc", "lower", "upper"):
        assert abs(exact[c] - poisson[c]) < 0.01
    whole = metrics.evaluate_auroc(pairs, "k", 200, method="poisson").first()
    assert whole["num_positive"] == 400 and whole["lower"] < whole["auroc"] < whole["upper"]


def test_no_row_for_a_draw(spark):
    """Rows in the plan after folding: at most those of the table, and far fewer where scores repeat."""
    rows = spark.range(20_000).select((F.col("id") % 5 / 5).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.col("id").alias("k")).coalesce(2)
    slim = rows.select(F.lit("").alias("g"), F.lit(0).alias("zone"), "score", "label", F.col("k").alias("x"), F.col("k").alias("y"))
    folded = slim.mapInArrow(bootstrap._fold(bootstrap.factors(10, "s"), 64), "g string, zone int, score double, label int, x long, y long, n binary, p binary")
    assert folded.count() == 5 * 2  # a batch of 10,000 rows from each of two tasks


def test_draws_are_those_of_single_digests():
    for prefix in ("bootstrap|", "b" * 50 + "|", "b" * 61 + "|7|", "é" * 70 + "|"):
        for begin, end in ((0, 1005), (99990, 100020), (5, 5)):
            assert bootstrap.draws(prefix, begin, end).tolist() == [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(begin, end)]


def test_drawn_pairs_by_hand(spark):
    """Two groups, one of two zones, a null and ties; draws travel as counts by zones, never as rows."""
    pick = random.Random(8)
    pairs = [(g, k, pick.choice([None, 0.1, 0.5, pick.random()]), pick.choice([0.5, pick.random()])) for g, n in (("a", 9000), ("b", 3)) for k in range(n)]
    df = spark.createDataFrame(pairs, "family string, k long, pos_score double, neg_score double").repartition(5)
    got = bootstrap.drawn_auc(metrics.sides(df, "family", "k"), "k", 3, "family")
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    found = {(r["family"], r["replicate"]): r["value"] for r in got.collect()}
    for g, n in (("a", 9000), ("b", 3)):
        scores = np.array([[-np.inf if s is None else s for s in r[2:]] for r in pairs if r[0] == g])
        for r in range(3):
            taken = scores[bootstrap.draws(f"bootstrap|{g}|{r}|", 0, n) % n]
            pos, neg = taken[:, 0], np.sort(taken[:, 1])
            ahead = np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")
            assert found.pop((g, r)) == pytest.approx(ahead.sum() / 2 / n / n, abs=1e-12)
    assert not found
    assert bootstrap.drawn_auc(metrics.sides(df.where("false"), "family", "k"), "k", 3, "family").count() == 0
    assert "FlatMapCoGroupsInArrow" in metrics.pair_intervals(df, "family", "k", 3)._jdf.queryExecution().toString()


def test_common_scores_meet_whatever_the_batches():
    """Batches of 1000 rows (the training-data operators ask for those) fold as one of 10,000 does."""
    whole = pa.record_batch({"g": ["x"] * 10_000, "score": [0.5] * 10_000, "label": [1] * 10_000, "x": list(range(10_000)), "y": list(range(10_000))})
    fold = bootstrap._fold(bootstrap.factors(4, "s"), 64)
    assert [b.num_rows for b in fold(whole.slice(a, 1000) for a in range(0, 10_000, 1000))] == [1]


def test_draws_by_score_are_the_draws(spark):
    rows = spark.createDataFrame([(k, k % 5 / 5, int(k % 3 == 0)) for k in range(40)], "k long, score double, label int")
    plain, folded = (metrics.resamples(rows, "k", 40, 6, "bootstrap", by) for by in (False, True))
    assert "Generate" not in folded.select("times")._jdf.queryExecution().toString().split("MapInArrow")[0]
    each = [{tuple(r) for r in d.groupBy("replicate", "score", "label").agg(F.sum("times")).collect()} for d in (plain, folded)]
    assert each[0] == each[1] and len(each[0]) > 20
