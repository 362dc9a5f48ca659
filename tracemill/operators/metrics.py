"""Ranking, detection and calibration metrics as aggregations; degenerate inputs give 0 unless stated."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.picks import draw
from tracemill.operators import scan


def safe_mean(values: Column) -> Column:
    return F.coalesce(F.avg(values), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def bad_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: how many labels are not 0 or 1."""
    return rows.agg(F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("bad_labels"))


def roc_auc(rows: DataFrame, by: list[str] | None = None, score: str = "score", label: str = "label", ranges: int | None = None) -> DataFrame:
    """Tie-aware AUROC per group, 0 where a class is missing: (by, n, positives, auroc).

    Equal scores are counted first; running sums go over ranges of the scores
    (:mod:`tracemill.operators.scan`), so that no task holds all of a group.
    """
    by = by or []
    ties = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("p"))
    ranked = scan.running(ties, {"upto": F.col("n")}, [score], by, ranges).withColumn("mid", F.col("upto") - (F.col("n") - 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), F.sum(F.col("mid") * F.col("p")).alias("ranks"))
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    return sums.select(*by, "n", "positives", ratio(F.col("ranks") - p * (p + 1) / 2.0, p * q).alias("auroc"))


def average_precision(rows: DataFrame, tie: list[str], by: list[str] | None = None, score: str = "score", label: str = "label", ranges: int | None = None) -> DataFrame:
    """Mean precision at the positives, in order of falling score (nulls last); ``tie`` orders equal scores. Running counts go over ranges of that order."""
    by = by or []
    keys = [F.col(score).isNull().alias("__last"), (-F.col(score)).alias("__down")]
    order = ["__last", "__down", *tie]
    rows = rows.select(*by, F.col(label).alias("label"), *keys, *(c for c in tie if c not in by))
    at = scan.running(rows, {"hits": F.col("label"), "place": F.lit(1)}, order, by, ranges)
    return at.groupBy(*by).agg(safe_mean(F.when(F.col("label") == 1, F.col("hits") / F.col("place"))).alias("average_precision"))


def pair_accuracy(pairs: DataFrame, by: list[str] | None = None, better: str = "pos_score", worse: str = "neg_score") -> DataFrame:
    """Share of pairs in the right order; ties count half."""
    value = F.when(F.col(better) > F.col(worse), 1.0).when(F.col(better) == F.col(worse), 0.5).otherwise(0.0)
    return pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), safe_mean(value).alias("accuracy"))


def false_acceptance_rate(rows: DataFrame, threshold: float, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    accepted = F.when(F.col(label) == 0, (F.col(score) >= threshold).cast("double"))
    return rows.groupBy(*(by or [])).agg(safe_mean(accepted).alias("far"))


def detection(rows: DataFrame, predicted: Column, label: Column, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of a 0/1 prediction."""
    hit, said, true = (predicted == 1) & (label == 1), predicted == 1, label == 1
    sums = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("tp"), F.count_if(said).alias("said"), F.count_if(true).alias("true"), F.count_if(predicted == label).alias("right")
    )
    out = sums.withColumns(
        {"accuracy": ratio(F.col("right"), F.col("n")), "precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("true"))}
    )
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(*(by or []), "n", "accuracy", "precision", "recall", f1.alias("f1"))


def divergence(pairs: DataFrame, place: str = "t_star", family: str = "family") -> DataFrame:
    """Share of pairs with the better trace strictly ahead: overall, by first differing step, by family (grouping sets)."""
    ahead = (F.col("pos_score") > F.col("neg_score")).cast("double")
    cells = pairs.groupingSets([[], [place], [family]], place, family)
    return cells.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.avg(ahead).alias("accuracy")).select(
        "level", place, family, "n", "accuracy"
    )


def calibration(rows: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """One row per non-empty bin: bin, n, confidence, accuracy, gap. Edges are compared as they are, not by multiplication."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(bins)])  # multiples of the width, as evenly spaced edges are computed
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.size(F.filter(edges, lambda e: e <= F.col(score))) - 1))
    cells = rows.groupBy(place.cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy")
    )
    return cells.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected and largest gap of :func:`calibration`; null for an empty input."""
    return bins.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def top1_accuracy(rows: DataFrame, label: str = "label") -> DataFrame:
    """Mean of 0/1 outcomes; 0 for none."""
    return rows.agg(safe_mean(F.col(label).cast("double")).alias("top1_accuracy"))


def with_scores(pairs: DataFrame, scores: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs with the scores of their two traces, by key and never by place; a pair without both scores is left out."""
    both = scores.where("pos_score is not null and neg_score is not null").select(key, "pos_score", "neg_score")
    return pairs.drop("pos_score", "neg_score").join(both, key)


def sides(pairs: DataFrame, *keep: str) -> DataFrame:
    """A row for each side of a pair: ``keep``, score, and label 1 for the better one."""
    return pairs.select(*keep, F.inline(F.array(*[F.struct(F.col(c).alias("score"), F.lit(l).alias("label")) for c, l in (("pos_score", 1), ("neg_score", 0))])))


def pair_intervals(pairs: DataFrame, group: str, order: str, replicates: int = 1000, alpha: float = 0.05, method: str = "exact") -> DataFrame:
    """(group, auroc, lower, upper): mean and percentiles of the AUROC of resampled pairs, whose two scores stay together.

    ``order`` is a number that orders the pairs of a group and tells them apart.
    ``exact`` draws as many pairs as there are, with replacement; ``poisson``
    counts each pair Poisson(1) times instead. Neither makes rows for that
    (:mod:`tracemill.operators.bootstrap`).
    """
    if method == "poisson":
        from tracemill.operators.bootstrap import poisson_auc  # it builds on this module

        values = poisson_auc(sides(pairs, group, order), order, replicates, group)
        return _interval(values, group, alpha)
    ranges = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = ordinals(pairs.select(group, order, "pos_score", "neg_score"), order, "ordinal", ranges, group)
    from tracemill.operators.bootstrap import drawn_auc

    return _interval(drawn_auc(sides(numbered, group, "ordinal"), "ordinal", replicates, group), group, alpha)


def _interval(values: DataFrame, group: str, alpha: float) -> DataFrame:
    return values.groupBy(group).agg(
        F.avg("value").alias("auroc"), F.percentile("value", alpha / 2).alias("lower"), F.percentile("value", 1 - alpha / 2).alias("upper")
    )


def evaluate_auroc(pairs: DataFrame, order: str, replicates: int = 1000, threshold: float = 0.5, method: str = "exact") -> DataFrame:
    """One row: AUROC over resampled pairs with its interval (0.5, 0, 1 without pairs), and detection of scores above the threshold."""
    boot = pair_intervals(pairs.withColumn("all", F.lit("all")), "all", order, replicates, method=method).drop("all")
    found = detection(sides(pairs), (F.col("score") > threshold).cast("int"), F.col("label"))
    counts = pairs.agg(F.count("*").alias("num_positive"), F.count("*").alias("num_negative"))
    out = found.drop("n").crossJoin(counts)  # one row each
    out = out.withColumn("one", F.lit(1)).join(boot.withColumn("one", F.lit(1)), "one", "left").drop("one")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("auroc", 0.5), ("lower", 0.0), ("upper", 1.0))})


def family_intervals(pairs: DataFrame, order: str, replicates: int = 1000, family: str = "family", method: str = "exact") -> DataFrame:
    """:func:`by_family` with the mean AUROC of resampled pairs and its interval; null for a single pair."""
    boot = pair_intervals(pairs, family, order, replicates, method=method)
    out = by_family(pairs, family).drop("auroc").join(boot, family)
    return out.withColumns({c: F.when(F.col("n") > 1, F.col(c)) for c in ("auroc", "lower", "upper")})


def by_family(pairs: DataFrame, family: str = "family") -> DataFrame:
    """AUROC, accuracy, means and population deviations per family; AUROC null for a single pair."""
    auc = roc_auc(sides(pairs, family), [family]).select(family, "auroc")
    rest = pairs.groupBy(family).agg(
        F.count("*").alias("n"),
        F.avg((F.col("pos_score") > F.col("neg_score")).cast("double")).alias("accuracy"),
        F.avg("pos_score").alias("pos_mean"), F.avg("neg_score").alias("neg_mean"),
        F.stddev_pop("pos_score").alias("pos_std"), F.stddev_pop("neg_score").alias("neg_std"),
    )
    return rest.join(auc, family).withColumn("auroc", F.when(F.col("n") > 1, F.col("auroc")))


def best_and_worst(families: DataFrame, family: str = "family", value: str = "auroc") -> DataFrame:
    """The families with the highest and lowest value; ties go to the smaller name."""
    known = families.where(F.col(value).isNotNull())
    return known.agg(
        F.min_by(family, F.struct(-F.col(value), family)).alias("best"), F.max(value).alias("best_value"),
        F.min_by(family, F.struct(value, family)).alias("worst"), F.min(value).alias("worst_value"),
    )


def ordinals(rows: DataFrame, by: str, name: str, ranges: int, group: str | None = None) -> DataFrame:
    """Numbers the rows from 0 in the order of the number ``by``, as ``name``: each range between quantiles is numbered alone, and shifted by the rows before it.

    With a ``group`` the rows of each are numbered from 0; groups are few.
    """
    bounds = sorted(set(rows.approxQuantile(by, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    place = scan.place(F.col(by), [F.lit(b) for b in bounds])
    dealt = rows.withColumn("__range", place)
    if group:
        sizes = dealt.groupBy(group, "__range").agg(F.count("*").alias("__size"))  # one row for each group and range
        upto = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        shifts = sizes.select(F.col(group).alias("__g"), F.col("__range").alias("__r"), F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__before"))
        within = F.row_number().over(Window.partitionBy(group, "__range").orderBy(by))
        # cast on both sides, as in scan.running: the planner must not infer filters by the range's expression
        same = (F.col(group) == F.col("__g")) & (F.col("__range").cast("string") == F.col("__r").cast("string"))
        return dealt.withColumn(name, within).join(shifts, same).withColumn(name, F.col(name) + F.col("__before") - 1).drop("__range", "__before", "__g", "__r")
    sizes = {r["__range"]: r["count"] for r in dealt.groupBy("__range").count().collect()}  # one row for each range
    before = [sum(n for k, n in sizes.items() if k < i) for i in range(len(bounds) + 1)]
    within = F.row_number().over(Window.partitionBy("__range").orderBy(by))
    return dealt.withColumn(name, F.get(F.array(*(F.lit(n).cast("long") for n in before)), F.col("__range")) + within - 1).drop("__range")


def resamples(rows: DataFrame, ordinal: str, n: int, replicates: int, salt: str = "bootstrap", by_score: bool = False) -> DataFrame:
    """``replicates`` draws with replacement of ``n`` rows numbered 0..n-1 by ``ordinal``: adds replicate and times.

    Only draw counts are generated and joined by ordinal; the rows themselves are
    never multiplied before a draw asks for them. ``by_score`` gives only
    (replicate, score, label, times), for 0/1 labels, in parts that add up, and makes no row for a draw.
    """
    if by_score:
        from tracemill.operators.bootstrap import drawn_by_score

        return drawn_by_score(rows, ordinal, replicates, "score", "label", salt)
    draws = rows.sparkSession.range(replicates * n).select(
        F.floor(F.col("id") / n).alias("replicate"),
        F.pmod(draw(F.lit(salt), F.floor(F.col("id") / n), F.col("id") % n), F.lit(n)).alias(ordinal),
    )
    return draws.groupBy("replicate", ordinal).agg(F.count("*").alias("times")).join(rows, ordinal)


def weighted_auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """AUROC of rows (score, label, times) that count ``times`` each."""
    ties = rows.groupBy(*by, "score").agg(F.sum("times").alias("n"), F.sum(F.col("label") * F.col("times")).alias("p"))
    upto = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ties.withColumn("mid", F.sum("n").over(upto) - (F.col("n") - 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("mid") * F.col("p")).alias("ranks"))
    return sums.select(*by, ratio(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * (F.col("n") - F.col("p"))).alias("value"))


def metric_values(rows: DataFrame, metric: Callable[[np.ndarray, np.ndarray], float], by: list[str], score: str = "score", label: str = "label", times: str = "times") -> DataFrame:
    """(``by``, value): any metric of labels and scores, by group; a row counts ``times`` often. The rows of a group must fit one task."""

    def value(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("times").to_numpy()
        got = float(metric(np.repeat(table.column("label").to_numpy(), n), np.repeat(table.column("score").to_numpy(), n)))
        return pa.table({c: pa.array([k.as_py()], k.type) for c, k in zip(by, key)} | {"value": pa.array([got])})

    kinds = dict(rows.dtypes)
    slim = rows.select(*by, F.col(label).cast("int").alias("label"), F.col(score).cast("double").alias("score"), F.col(times).cast("long").alias("times"))
    return slim.groupBy(*by).applyInArrow(value, ", ".join([*(f"{c} {kinds[c]}" for c in by), "value double"]))


def metric_interval(
    rows: DataFrame, metric: Callable[[np.ndarray, np.ndarray], float], order: str, replicates: int = 1000, alpha: float = 0.05, score: str = "score", label: str = "label", salt: str = "bootstrap"
) -> DataFrame:
    """One row: the ``estimate`` of a metric on the rows as they are, and :func:`bootstrap_interval` of its values on resampled rows.

    ``metric`` gets arrays of labels and of scores; ``order`` is a number that
    tells the rows apart. No rows give none.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = ordinals(rows.select(order, score, label), order, "__ordinal", ranges).drop(order)
    n = numbered.count()
    drawn = resamples(numbered, "__ordinal", n, replicates, salt).select("replicate", score, label, "times")
    own = numbered.select(F.lit(-1).cast("long").alias("replicate"), score, label, F.lit(1).cast("long").alias("times"))
    values = metric_values(drawn.unionByName(own), metric, ["replicate"], score, label)
    # the estimate rides along as a value of its own, so that the metric is computed once
    split = values.select(F.when(F.col("replicate") >= 0, F.col("value")).alias("value"), F.when(F.col("replicate") < 0, F.col("value")).alias("own"))
    return bootstrap_interval(split, replicates, alpha, estimate=F.max("own")).where(F.lit(n > 0))


def bootstrap_interval(values: DataFrame, replicates: int, alpha: float = 0.05, estimate: Column | None = None) -> DataFrame:
    """Mean of the replicates' values with percentile bounds, and the bounds by order statistics; ``estimate`` is an aggregate to stand first."""
    low, high = max(0, int(alpha / 2 * replicates) - 1), min(replicates - 1, -int(-(1 - alpha / 2) * replicates // 1) - 1)
    sorted_values = F.array_sort(F.collect_list("value"))  # one number per replicate
    out = values.agg(
        F.avg("value").alias("mean"), F.percentile("value", alpha / 2).alias("lower"), F.percentile("value", 1 - alpha / 2).alias("upper"), sorted_values.alias("v"),
        *([] if estimate is None else [estimate.alias("estimate")]),
    )
    return out.select(*([] if estimate is None else ["estimate"]), "mean", "lower", "upper", F.get("v", F.lit(low)).alias("lower_order"), F.get("v", F.lit(high)).alias("upper_order"))


def decision(delta: Column, challenger_low: Column, baseline_high: Column, mock: Column | None = None) -> Column:
    """GO, MARGINAL or NO-GO from the gain and the two interval bounds; NO-GO for mock scores."""
    go = (delta >= 0.05) & (challenger_low > baseline_high)
    return F.when(F.lit(False) if mock is None else mock, "NO-GO").when(go, "GO").when((delta >= 0.02) & (delta < 0.05), "MARGINAL").otherwise("NO-GO")
