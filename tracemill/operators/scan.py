"""Running sums and maxima in an order, distributed by ranges.

A window over a whole group is one task for the group. Here rows are dealt to
ranges of the order instead: bounds between ranges come from a random sample and
stand in the plan as constants, so that every job sees the same ranges. Each
range is summed (one row a group and range), the sums before it are its shift,
and windows run within ranges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import once

#: bounds compared at each of the two steps that find a row's range
_FAN = 16


def _known(row: list, types: list[str]) -> Column:
    """A sampled key as a constant of the types of ``row``'s columns."""
    return F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(row, types))))


def place(key: Column, bounds: list[Column]) -> Column:
    """How many of the ascending constants ``bounds`` are not above ``key``, in two steps of some :data:`_FAN` comparisons."""
    if not bounds:
        return F.lit(0)
    upto = lambda known: F.size(F.filter(known, lambda b: b <= key))
    parts = [F.array(*bounds[i : i + _FAN]) for i in range(0, len(bounds), _FAN)]
    coarse = upto(F.array(*bounds[::_FAN]))
    return once(coarse, lambda c: F.when(c == 0, 0).otherwise((c - 1) * _FAN + upto(F.get(F.array(*parts), c - 1))))


def range_of(rows: DataFrame, keys: list[Column], ranges: int, per_range: int = 64) -> Column:
    """Which of ``ranges`` ranges of the ascending order of ``keys`` (nulls first) a row lies in; equal keys lie in one.

    A sample of ``ranges * per_range`` rows at most comes to the driver.
    """
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    sample = rows.select(*named)
    types = [t for _, t in sample.dtypes]
    taken = sample.orderBy(F.rand(1)).limit(ranges * per_range).orderBy(*sample.columns).collect()
    bounds = list(dict.fromkeys(tuple(taken[i * len(taken) // ranges]) for i in range(1, ranges))) if taken else []
    key = F.struct(*named)
    return place(key, [_known(b, types) for b in bounds])


def default_ranges(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(rows: DataFrame, order: list[Column | str], by: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``__range``, a range of the order within (or across) the groups of ``by``."""
    keys = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    return rows.withColumn("__range", range_of(rows, keys, ranges or default_ranges(rows)))


def running(rows: DataFrame, totals: dict[str, Column], order: list[Column | str], by: list[str] | None = None, ranges: int | None = None, kind: str = "sum", keep_range: bool = False) -> DataFrame:
    """``rows`` with the running sum (or ``kind='max'``) of each of ``totals`` up to and with the row, in ascending ``order`` (nulls first) within ``by``.

    ``order`` should tell the rows of a group apart: rows with equal keys lie in
    one range, in any order. ``rows`` is computed three times, so stage what is
    costly. Rows that have a ``__range`` (of :func:`ranged`) keep it.
    """
    by = by or []
    dealt = rows if "__range" in rows.columns else ranged(rows, order, by, ranges)
    fold = {"sum": F.sum, "max": F.max}[kind]
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "max": lambda a, b: F.greatest(a, b)}[kind]
    dealt = dealt.withColumns({f"__v{i}": v for i, v in enumerate(totals.values())})
    values = [f"__v{i}" for i in range(len(totals))]
    # all ranges of a group, a row each; without groups the key is true, which the planner cannot know
    whole = by or ["__whole"]
    partial = dealt.groupBy(*by, "__range").agg(*(fold(v).alias(v) for v in values), (F.count("*") > 0).alias("__whole"))
    before = Window.partitionBy(*whole).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = partial.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), F.col("__range").alias("__r"), *(fold(v).over(before).alias(f"__b{v}") for v in values))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"__w{v}": fold(v).over(within) for v in values})
    # cast on both sides: of plain columns the planner infers filters by the range's expression, and puts them where its columns are not
    same = F.col("__range").cast("string") == F.col("__r").cast("string")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    out = out.join(shifts, same)
    kept = [c for c in dealt.columns if c not in values and (keep_range or c != "__range") and c not in totals]
    return out.select(*kept, *(join(F.col(f"__b{v}"), F.col(f"__w{v}")).alias(name) for name, v in zip(totals, values)))
