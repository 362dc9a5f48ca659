import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import metrics, rank


def scored(spark, labels, scores):
    return spark.createDataFrame([(i, s, y) for i, (y, s) in enumerate(zip(labels, scores))], "k int, score double, label int")


def auc(spark, labels, scores):
    return metrics.roc_auc(scored(spark, labels, scores)).first()["auroc"]


def test_roc_auc(spark):
    assert auc(spark, [1, 0, 1, 0, 1], [0.9, 0.8, 0.8, 0.3, 0.1]) == pytest.approx(0.58333333)
    assert auc(spark, [1, 1], [0.5, 0.7]) == 0.0


def test_roc_auc_against_pairs(spark):
    rng = random.Random(3)
    y, s = [rng.randint(0, 1) for _ in range(200)], [rng.randint(0, 9) / 10 for _ in range(200)]
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(s, y) if i for b, j in zip(s, y) if not j]
    assert auc(spark, y, s) == pytest.approx(sum(pairs) / len(pairs))
    assert auc(spark, [1 - i for i in y], s) == pytest.approx(1 - sum(pairs) / len(pairs))


def test_average_precision(spark):
    ap = lambda y, s: metrics.average_precision(scored(spark, y, s), ["k"]).first()["average_precision"]
    assert ap([1, 0, 1, 0, 1], [0.9, 0.8, 0.7, 0.3, 0.1]) == pytest.approx(0.7555555)
    assert ap([1, 0], [0.5, 0.5]) == 1.0
    assert ap([0, 1], [0.5, 0.5]) == 0.5
    assert ap([0, 0], [0.5, 0.5]) == 0.0


def test_pair_accuracy_and_far(spark):
    pairs = spark.createDataFrame([(0.9, 0.1), (0.2, 0.4), (0.5, 0.5)], "pos_score double, neg_score double")
    assert metrics.pair_accuracy(pairs).first()["accuracy"] == pytest.approx(0.5)
    assert metrics.false_acceptance_rate(scored(spark, [0, 0, 1], [0.6, 0.4, 0.9]), 0.5).first()["far"] == 0.5


def test_calibration_bins(spark):
    rows = scored(spark, [1] * 5, [0.3, 0.6, 0.7, 1.0, -0.1])
    assert sorted(r["bin"] for r in metrics.calibration(rows).collect()) == [0, 2, 5, 6, 9]
    assert metrics.calibration_error(metrics.calibration(rows.where("false"))).first()["ece"] is None


def test_detection_zero_division(spark):
    out = metrics.detection(scored(spark, [0, 0], [0.1, 0.2]), (F.col("score") > 0.5).cast("int"), F.col("label")).first()
    assert (out["accuracy"], out["precision"], out["recall"], out["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_bootstrap_orders(spark):
    values = spark.range(1000).select(F.col("id").cast("double").alias("value"))
    out = metrics.bootstrap_interval(values, 1000).first()
    assert (out["lower_order"], out["upper_order"]) == (24.0, 974.0)
    assert out["lower"] == pytest.approx(0.025 * 999)


@pytest.mark.parametrize("ids", [[], [7], [5, 1, 9, 3], list(range(0, 3000, 3)), [1 << 60, (1 << 60) + 1, -4, 0]])
def test_ordinals(spark, ids):
    """Numbers in order, without a task that sorts all rows."""
    rows = spark.createDataFrame([(i,) for i in random.Random(2).sample(ids, len(ids))], "doc_id long").repartition(3)
    out = metrics.ordinals(rows, "doc_id", "k", 5)
    assert [r["k"] for r in out.orderBy("doc_id").collect()] == list(range(len(ids)))
    assert len(ids) < 2 or "SinglePartition" not in out._jdf.queryExecution().toString()


def test_bootstrap_numbers_rows_by_ranges(spark, monkeypatch):
    from tracemill.plans import catalogue

    seen = []
    monkeypatch.setattr(catalogue, "_scored", lambda *_: scored(spark, [1, 0] * 50, [i / 100 for i in range(100)]).withColumnRenamed("k", "doc_id"))
    monkeypatch.setattr(metrics, "resamples", lambda rows, *a: seen.append(rows) or rows.withColumns({"replicate": F.lit(0), "times": F.lit(1)}))
    catalogue._bootstrap(spark, "")
    assert "SinglePartition" not in seen[0]._jdf.queryExecution().toString() and {r["k"] for r in seen[0].collect()} == set(range(100))


def test_decision(spark):
    row = spark.range(1).select(metrics.decision(F.lit(0.06), F.lit(0.6), F.lit(0.5)).alias("a"), metrics.decision(F.lit(0.03), F.lit(0.6), F.lit(0.5)).alias("b"), metrics.decision(F.lit(0.06), F.lit(0.4), F.lit(0.5)).alias("c")).first()
    assert tuple(row) == ("GO", "MARGINAL", "NO-GO")


@pytest.mark.parametrize(("labels", "critical", "expected"), [([1, 0, 1, 1], [1, 1, 1, 0], 0.25), ([1, 1, 1, 0], [1, 1, 1, 0], 0.75), ([1, 0], [1, 1], 0.0), ([], [], 0.0)])
def test_aggregate_scores(spark, labels, critical, expected):
    row = spark.createDataFrame([([float(x) for x in labels], [bool(c) for c in critical])], "s array<double>, c array<boolean>")
    assert row.select(rank.aggregate_scores(F.col("s"), F.col("c"))).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize(("costs", "budget", "seen"), [([1, 2, 3], 3, 2), ([4, 1], 3, 0), ([1, None], 2, 2), ([1], 0, 0), ([2, 5, -9], 3, 1)])
def test_budget(spark, costs, budget, seen):
    rows = spark.createDataFrame([("g", i, None if c is None else float(c)) for i, c in enumerate(costs)], "g string, pos int, cost double")
    assert rank.under_budget(rows, ["g"], ["pos"], F.col("cost"), budget).count() == seen


def test_same_on_any_number_of_partitions(spark):
    rng = random.Random(1)
    rows = scored(spark, [rng.randint(0, 1) for _ in range(300)], [rng.random() for _ in range(300)])
    got = {round(metrics.roc_auc(rows.repartition(n)).first()["auroc"], 12) for n in (1, 3, 16)}
    assert len(got) == 1 and not math.isnan(got.pop())


def test_any_metric_with_its_estimate(spark):
    """The estimate is that of the rows as they are, and replicates are those of :func:`metrics.resamples`."""
    rows = scored(spark, [1, 0, 1, 1, 0, 1], [0.9, 0.8, 0.4, 0.7, 0.2, 0.6])
    spread = lambda labels, scores: float(scores[labels == 1].sum() - scores[labels == 0].sum())
    out = metrics.metric_interval(rows, spread, "k", 40)
    row = out.first()
    numbered = metrics.ordinals(rows, "k", "o", 2)
    values = {}
    for r in metrics.resamples(numbered, "o", 6, 40).collect():
        values[r["replicate"]] = values.get(r["replicate"], 0.0) + r["times"] * r["score"] * (1 if r["label"] else -1)
    values = sorted(values.values())
    assert row["estimate"] == pytest.approx(1.6) and row["mean"] == pytest.approx(sum(values) / 40)
    assert (row["lower_order"], row["upper_order"]) == (pytest.approx(values[0]), pytest.approx(values[38]))
    assert metrics.metric_interval(rows.where("false"), spread, "k", 5).count() == 0
