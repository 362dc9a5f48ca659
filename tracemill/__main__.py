"""Command line over the stages: ``python -m tracemill run|status|pending --root ... --manifest ... --outputs ...``."""

from __future__ import annotations

import argparse
import json
import sys

from tracemill.flow import flow, unanswered
from tracemill.schemas import BENCHMARKS
from tracemill.session import build_session
from tracemill.sources.readers import write_jsonl


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tracemill", description="Reasoning traces from manifests and outputs to training sets; finished stages are skipped.")
    p.add_argument("command", choices=("run", "status", "pending"), help="run stages; counts and gate of what is published; requests without an output, as JSON lines")
    p.add_argument("--root", required=True, help="folder of the tables")
    p.add_argument("--manifest", required=True, help="JSON lines of the manifest, with evidence columns")
    p.add_argument("--outputs", required=True, help="JSON lines with request_id and raw_text")
    p.add_argument("--benchmark", required=True, choices=BENCHMARKS)
    p.add_argument("--prompt", help="prompt template; the benchmark's canonical one unless given")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--limit", type=int, help="first rows of the manifest only")
    p.add_argument("--only", nargs="*", help="stop once these stages are there")
    p.add_argument("--to", help="folder for the pending requests")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = build_session("tracemill")
    runner = flow(spark, a.root, a.manifest, a.outputs, a.benchmark, a.prompt or f"{a.benchmark}_canonical_v1", a.seed, a.limit)
    if a.command == "run":
        print(json.dumps(runner.run(tuple(a.only) if a.only else None)))
    elif a.command == "pending":
        rows = unanswered(runner)
        if a.to:
            write_jsonl(rows, a.to)
        print(json.dumps({"pending": rows.count()}))
        return 0
    counts = [r.asDict() for r in runner.counts().orderBy("stage", "benchmark").collect()]
    print(json.dumps({"published": sorted(runner.published()), "counts": counts, "gate": runner.gate().first().asDict()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
