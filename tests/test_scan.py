"""Running sums by ranges against running sums by hand, with one key, all keys unlike, and odd values."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tracemill.operators import metrics, rank, scan


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, k double, tie long, v long, x double").repartition(3)


def rows_of(seed, n=400, keys=None):
    pick = random.Random(seed)
    key = {"one": lambda i: 0.5, "unlike": lambda i: i / 7, "some": lambda i: pick.choice([0.1, 0.2, 0.3, None, float("nan"), -1.0])}[keys]
    rows = [(pick.choice(["a", "a", "a", "b", None]), key(i), i, pick.randint(-3, 5), pick.random()) for i in range(n)]
    pick.shuffle(rows)
    return rows


def sorted_key(r):
    k = r[1]
    return (k is not None, (k != k, 0.0 if k != k else k) if k is not None else (False, 0.0), r[2])


@pytest.mark.parametrize("keys", ["one", "unlike", "some"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums_and_maxima(spark, keys, by):
    rows = rows_of(1, keys=keys)
    got = scan.running(table(spark, rows), {"s": F.col("v"), "c": F.lit(1)}, ["k", "tie"], by, ranges=7)
    most = scan.running(table(spark, rows), {"m": F.col("v")}, ["k", "tie"], by, ranges=7, kind="max")
    assert got.columns == ["g", "k", "tie", "v", "x", "s", "c"]
    want, peaks = {}, {}
    for g in {r[0] for r in rows} if by else {0}:
        mine = sorted((r for r in rows if not by or r[0] == g), key=sorted_key)
        for i, (r, s, m) in enumerate(zip(mine, accumulate(r[3] for r in mine), accumulate((r[3] for r in mine), max))):
            want[r[2]], peaks[r[2]] = (s, i + 1), m
    assert {r["tie"]: (r["s"], r["c"]) for r in got.collect()} == want
    assert {r["tie"]: r["m"] for r in most.collect()} == peaks
    assert scan.running(table(spark, rows).where("false"), {"s": F.col("v")}, ["k", "tie"], by, ranges=7).count() == 0


def test_ranges_share_the_rows(spark):
    """A group that holds all rows, and one key that does, are spread by the tie."""
    for keys in ("one", "unlike"):
        rows = [("a", k, t, v, x) for _, k, t, v, x in rows_of(2, 3000, keys)]
        dealt = scan.ranged(table(spark, rows), ["k", "tie"], ["g"], 40)
        sizes = [r["count"] for r in dealt.groupBy("__range").count().collect()]
        assert len(sizes) >= 36 and max(sizes) < 250


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_that_meet_in_one_task(df):
    """Exchanges to a single partition whose rows are not partial aggregates."""
    lines = plan_of(df).split("\n")
    return [b for a, b in zip(lines, lines[1:]) if "SinglePartition" in a and "partial_" not in b]


@pytest.mark.parametrize("scores", ["one", "unlike", "some"])
def test_metrics_by_ranges(spark, scores):
    rows = [(r[0], r[1] if r[1] == r[1] else 7.0, r[2], r[3] % 2, 0.0) for r in rows_of(4, 300, scores)]
    df = table(spark, rows).withColumnRenamed("k", "score").withColumnRenamed("v", "label")
    known = df.where("score is not null")
    out, ap = metrics.roc_auc(known, ranges=6), metrics.average_precision(df, ["tie"], ranges=6)
    assert not rows_that_meet_in_one_task(out) and not rows_that_meet_in_one_task(ap)
    pairs = [(a > b) + 0.5 * (a == b) for _, a, _, y, _ in rows if a is not None and y for _, b, _, z, _ in rows if b is not None and not z]
    assert out.first()["auroc"] == pytest.approx(sum(pairs) / len(pairs))
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[2]))
    hits = list(accumulate(r[3] for r in order))
    precise = [h / i for i, (h, r) in enumerate(zip(hits, order), 1) if r[3]]
    assert ap.first()["average_precision"] == pytest.approx(sum(precise) / len(precise))


@pytest.mark.parametrize("ranges", [None, 5])
def test_budget_over_ranges(spark, ranges):
    rows = rows_of(5, 500, "unlike")
    fits = rank.under_budget(table(spark, rows), ["g"], ["k", "tie"], F.col("v").cast("double"), 40, ranges)
    want = set()
    for g in {r[0] for r in rows}:
        spent = 0
        for r in sorted((r for r in rows if r[0] == g), key=sorted_key):
            spent += r[3]
            if spent > 40:
                break
            want.add((r[2], float(spent)))
    assert {(r["tie"], r["spent"]) for r in fits.collect()} == want


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_sums_over_an_aggregate(spark, ranges, by):
    """Both sides of the join come from one aggregate: no filter by the range's expression may end up where its columns are not."""
    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(50)], "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    got = scan.running(rows, {"upto": F.col("n")}, ["v"], by, ranges)
    assert [r["upto"] for r in got.orderBy("v").collect()] == [8, 15, 22, 29, 36, 43, 50]


def test_place_compares_in_two_steps(spark):
    """Among 199 bounds a row's place is found by arrays of 16, not by comparing all of them."""
    bounds = [F.lit(3 * i) for i in range(199)]
    rows = spark.range(-2, 700).select("id", scan.place(F.col("id"), bounds).alias("p"))
    assert all(r["p"] == min(199, max(0, r["id"] // 3 + 1)) for r in rows.collect())
    assert spark.range(1).select(scan.place(F.col("id"), [])).first()[0] == 0
