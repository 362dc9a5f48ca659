"""Largest gaps of two distribution functions against a count by hand, exact and by sketches."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import gaps


def by_hand(rows):
    values, kept = [v for v, _ in rows], [v for v, k in rows if k]
    return max(abs(sum(v <= x for v in values) / len(values) - sum(v <= x for v in kept) / len(kept)) for x in values)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_gaps(spark, by):
    pick = random.Random(1)
    rows = [(pick.choice("ab"), v := pick.choice([pick.gauss(0, 1), 0.5, 7.0]), pick.random() < (0.8 if v > 0 else 0.3)) for _ in range(3000)]
    rows += [("none", 1.0, None), ("none", 2.0, False)] if by else []
    df = spark.createDataFrame([*rows, ("a", None, True)], "g string, v double, kept boolean").repartition(5)
    exact, near = (f(df, "v", F.col("kept"), by).collect() for f in (gaps.exact_gap, gaps.sketch_gap))
    for found, bound in ((exact, 1e-12), (near, 0.02)):
        for g in sorted({r[0] for r in rows}) if by else [None]:
            mine = [(v, k) for h, v, k in rows if g in (None, h)]
            (row,) = [r for r in found if not by or r["g"] == g]
            assert row["n"] == len(mine) and row["retained"] == sum(bool(k) for _, k in mine)
            assert row["gap"] is None if g == "none" else row["gap"] == pytest.approx(by_hand(mine), abs=bound)
