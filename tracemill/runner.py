"""Stages that run when what they depend on has changed, and their publication.

A stage's fingerprint covers its name, version and parameters and the
fingerprints of its inputs; a source's covers its files (paths, sizes, times). A
stage writes to a folder named by its fingerprint and then a record there, with
its counts: only a table with a record is published, so a run that dies leaves
nothing that a reader could mistake for a result, and the next run writes it
anew. A finished stage is skipped; a changed input changes the fingerprints of
all that follows it, and of nothing else.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.summary import StageCounts, training_gate

RECORD = "fingerprint string, stage string, counts array<struct<stage: string, benchmark: string, n: bigint>>"


@dataclass(frozen=True)
class Stage:
    """``build`` gets its inputs by name and gives a table; it is run anew if ``version`` or ``parameters`` change."""

    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]
    version: str = "1"
    parameters: dict = field(default_factory=dict)
    #: named conditions whose rows are counted while the table is written
    watch: dict = field(default_factory=dict)
    #: (inputs) -> whether the stage may run; else it and what needs it are skipped
    gate: Callable[..., bool] | None = None


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def fingerprint_of_files(spark: SparkSession, path: str) -> str:
    """Of the names, sizes and times of the files under a path; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    row = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    # added up as numbers, which does not depend on their order
    sums = files.select(F.sha2(row, 256).alias("h")).agg(F.count("*"), *(F.sum(F.conv(F.substring("h", i, 8), 16, 10).cast("decimal(38,0)")) for i in (1, 9, 17, 25)))
    return _digest(path, [str(v) for v in sums.first()])


class Runner:
    """Runs stages in their order under ``root``, a folder in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, stages: list[Stage], sources: dict[str, str], by: str = "benchmark"):
        self.spark, self.root, self.stages, self.by = spark, root.rstrip("/"), stages, by
        known = set(sources)
        for s in stages:
            if missing := set(s.needs) - known:
                raise ValueError(f"stage {s.name} needs {', '.join(sorted(missing))}, which comes later or never")
            if s.name in known:
                raise ValueError(f"two stages or sources are called {s.name}")
            known.add(s.name)
        self.sources = sources

    def _fingerprint(self, stage: Stage, known: dict[str, str]) -> str:
        return _digest(stage.name, stage.version, stage.parameters, [known[n] for n in stage.needs])

    def _folder(self, stage: str, fingerprint: str) -> str:
        return f"{self.root}/{stage}/{fingerprint}"

    def record(self, stage: str, fingerprint: str) -> dict | None:
        """What was published of a stage, None if nothing was."""
        try:
            row = self.spark.read.schema(RECORD).json(f"{self._folder(stage, fingerprint)}/record").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return row.asDict(recursive=True) if row else None

    def run(self, only: tuple[str, ...] | None = None) -> dict[str, str]:
        """What came of each stage: ``done``, ``skipped`` (it was there), or ``closed`` (its gate, or that of an input, is)."""
        known = {name: fingerprint_of_files(self.spark, path) for name, path in self.sources.items()}
        tables: dict[str, DataFrame | str] = dict(self.sources)
        out: dict[str, str] = {}
        for stage in self.stages:
            if any(out.get(n) == "closed" for n in stage.needs):
                out[stage.name] = "closed"
                continue
            known[stage.name] = mark = self._fingerprint(stage, known)
            folder = self._folder(stage.name, mark)
            inputs = {n: tables[n] for n in stage.needs}
            if self.record(stage.name, mark) is not None:
                out[stage.name] = "skipped"
            elif stage.gate and not stage.gate(**inputs):
                out[stage.name] = "closed"
                continue
            else:
                rows = stage.build(**inputs, **stage.parameters)
                counts = StageCounts(self.by)
                if self.by in rows.columns:
                    rows = counts.watch(rows, **({stage.name: F.lit(True)} | stage.watch))
                rows.write.mode("overwrite").parquet(f"{folder}/data")
                row = [(mark, stage.name, counts.counts())]
                self.spark.createDataFrame(row, RECORD).coalesce(1).write.mode("overwrite").json(f"{folder}/record")
                out[stage.name] = "done"
            tables[stage.name] = self.spark.read.parquet(f"{folder}/data")
            if only and set(only) <= set(out):
                break
        return out

    def published(self) -> dict[str, str]:
        """Fingerprints of the stages whose table stands for the sources as they are now."""
        known = {name: fingerprint_of_files(self.spark, path) for name, path in self.sources.items()}
        out = {}
        for stage in self.stages:
            if all(n in known for n in stage.needs):
                mark = self._fingerprint(stage, known)
                if self.record(stage.name, mark) is not None:
                    known[stage.name] = out[stage.name] = mark
        return out

    def table(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(stage, self.published()[stage])}/data")

    def counts(self) -> DataFrame:
        """(stage, benchmark, n) as they were observed when the tables were written."""
        rows = [(c["stage"], c["benchmark"], c["n"]) for s, mark in self.published().items() for c in self.record(s, mark)["counts"] or []]
        return self.spark.createDataFrame(rows, "stage string, benchmark string, n long")

    def gate(self) -> DataFrame:
        """:func:`tracemill.operators.summary.training_gate` over the published tables: a benchmark is completed with verified and corrupted rows."""
        counts = self.counts().groupBy("benchmark").agg(F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("n"))  # a few stages each
        there = lambda stage: F.when(F.coalesce(F.try_element_at("n", F.lit(stage)), F.lit(0)) > 0, F.lit(stage))
        rows = counts.withColumns({"verified": there("verified"), "corrupted": there("corrupted")})
        status = F.when(F.col("verified").isNotNull() & F.col("corrupted").isNotNull(), "completed").otherwise("started")
        return training_gate(rows.select("benchmark", status.alias("status"), F.lit(None).cast("boolean").alias("include_in_training"), "verified", "corrupted"))
