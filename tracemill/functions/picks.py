"""Deterministic choices, the same for every partitioning: by md5, equal on every engine, or by Python's own generator.

Within ``generator("python")`` choices are those of ``random.Random`` seeded
with the salts joined by ``|``, in Arrow batches; columns keep the generator
under which they were made.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import once

_generator: ContextVar[str] = ContextVar("generator", default="md5")


@contextmanager
def generator(name: str) -> Iterator[None]:
    """Choices made inside come from ``md5`` or from ``python``."""
    if name not in ("md5", "python"):
        raise ValueError(f"unknown generator {name}")
    token = _generator.set(name)
    try:
        yield
    finally:
        _generator.reset(token)


def _seed(salts: tuple[Column, ...]) -> Column:
    return F.concat_ws("|", *(F.coalesce(s.cast("string"), F.lit("None")) for s in salts))


def _python_index(size: Column, salts: tuple[Column, ...]) -> Column:
    @F.arrow_udf("int")
    def below(seeds: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([random.Random(s).randrange(n) if n and n > 0 else None for s, n in zip(seeds.to_pylist(), sizes.to_pylist())], pa.int32())

    return below(_seed(salts), size)


def _python_take(values: Column, k: Column, salts: tuple[Column, ...]) -> Column:
    """The first ``k`` of the shuffled strings, sorted; repeated ones count each."""

    @F.arrow_udf("array<string>")
    def first(seeds: pa.Array, lists: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for seed, items, n in zip(seeds.to_pylist(), lists.to_pylist(), counts.to_pylist()):
            if items is None or n is None or not 0 <= n <= len(items):
                out.append(None)
                continue
            random.Random(seed).shuffle(items)
            out.append(sorted(items[:n]))
        return pa.array(out, pa.list_(pa.string()))

    return first(_seed(salts), values, k)


def draw(*salts: Column) -> Column:
    """A 32-bit number from the salts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(s.cast("string") for s in salts))), 1, 8), 16, 10).cast("long")


def index(size: Column, *salts: Column) -> Column:
    """A position below ``size``; null where there is none."""
    if _generator.get() == "python":
        return _python_index(size, salts)
    return F.when(size > 0, F.pmod(draw(*salts), size)).cast("int")


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value, evaluated once; Python's generator cannot choose inside of a lambda, so there it is evaluated where it is used."""
    return body(value) if _generator.get() == "python" else once(value, body)


def pick(values: Column, *salts: Column) -> Column:
    """One element of an array; null for empty and null arrays."""
    return held(values, lambda v: F.get(v, index(F.size(v), *salts)))


def take(values: Column, k: Column, *salts: Column) -> Column:
    """``k`` distinct elements in ascending order, none for 0; null where the array holds fewer."""
    if _generator.get() == "python":
        return _python_take(values, k, salts)

    def first(distinct: Column) -> Column:
        keyed = F.sort_array(F.transform(distinct, lambda v: F.struct(draw(*salts, v).alias("d"), v.alias("v"))))
        return F.when((k >= 0) & (F.size(distinct) >= k), F.array_sort(F.transform(F.slice(keyed, 1, k), lambda s: s["v"])))

    return once(F.array_distinct(values), first)


def in_share(percent: int, *salts: Column) -> Column:
    """True for about ``percent`` of a hundred keys."""
    return F.pmod(draw(*salts), F.lit(100)) < percent
