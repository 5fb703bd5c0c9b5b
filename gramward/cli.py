"""``python -m gramward.cli ingest|gen|bless|check|run|load|list``: datasets, suites, gated runs and the store."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import platform
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gramward.functions import registry
from gramward.functions.predicates import OPS, Query
from gramward.operators import gate, generator, measure, suite
from gramward.plans import loader, spec
from gramward.sources import columns

GATE_FAILED = 3


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    read = {"parquet": columns.read_parquet, "csv": columns.read_delimited, "tsv": lambda s, p, c: columns.read_delimited(s, p, c, "\t")}[args.format]
    rows = columns.ingest(read(spark, args.source, args.column))
    Path(args.folder).mkdir(parents=True, exist_ok=True)
    columns.write_column(rows, args.folder, args.id, {"path": args.source, "format": args.format, "column": args.column})
    return 0


def gen(spark: SparkSession, args: argparse.Namespace) -> int:
    """The workload's suite, and beside it the report of its points."""
    rows, manifest = columns.load_column(spark, args.folder)
    made, report = generator.workload(rows, "row_id", "data", quick=args.quick, seed=args.seed)
    queries = [Query(m.id, m.point.op, tuple(n.encode() for n in m.needles)) for m in made]
    suite.write(args.suite, manifest["id"], manifest["checksum"], queries, force=args.force)
    counts = {s: sum(r["status"] == s for r in report) for s in ("filled", "partial", "empty")}
    columns.write_json(str(Path(args.suite, "gen-report.json")), {"dataset": manifest["id"], "seed": args.seed, "queries": len(queries), "points": report} | counts)
    return 0


def bless(spark: SparkSession, args: argparse.Namespace) -> int:
    rows, manifest = columns.load_column(spark, args.folder)
    suite.bless(rows, manifest, args.suite, force=args.force)
    return 0


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    rows, manifest = columns.load_column(spark, args.folder, verify=True)
    return GATE_FAILED if suite.check(rows, manifest, args.suite) else 0


def _query_row(system: registry.System, rows: DataFrame, manifest: dict, q: Query, expected: dict, timing: spec.Measurement) -> dict:
    """One result: declined, failed, wrong (with the first row that differs) or timed. The gate comes before any figure."""
    row = {"kind": "query", "system": system.label, "dataset": manifest["id"], "query_id": q.id, "op": q.op, "status": "ok"}
    why = system.reason(q)
    if why:
        return row | {"status": "unsupported", "error": why}
    try:
        found = suite.truth(system.run(rows, "row_id", "data", q), manifest["num_rows"])
        if found != expected:
            right = registry.system("uncompressed/direct").run(rows, "row_id", "data", q)
            first = gate.explain(right, system.run(rows, "row_id", "data", q), rows, "row_id", "data").first()
            return row | {"status": "gate_failed", "gate": {"expected": expected, "actual": found, "first_divergent": first["first_divergent"], "text": first["divergent_text"]}}
        times = sorted(measure.timed(lambda: system.run(rows, "row_id", "data", q), timing.warmup, timing.iterations, timing.least_ms))
        size = {"n_values": manifest["num_rows"], "raw_bytes": manifest["payload_bytes"] + 8 * (manifest["num_rows"] + 1)}
        return row | size | {"latency_ns": times, "median_ns": times[len(times) // 2]}
    except Exception as why:  # noqa: BLE001 (a result of its own, as a run goes on)
        return row | {"status": "error", "error": f"{type(why).__name__}: {why}"[:500]}


def run_spec(spark: SparkSession, chosen: spec.Spec, out: str) -> int:
    """Each system on each query of each dataset. Builds that fail and modules that are not there are rows of their own."""
    failed, rows_out, about = False, [], []
    for dataset, where in zip(chosen.datasets, chosen.suites, strict=True):
        rows, manifest = columns.load_column(spark, dataset)
        _, queries, truths = suite.read(where, manifest)
        about.append({"id": manifest["id"], "checksum": manifest["checksum"], "suite": Path(where).name})
        built: dict[str, DataFrame | None] = {}
        for system in chosen.chosen():
            scheme = system.scheme
            base = {"kind": "build", "system": system.label, "dataset": manifest["id"]}
            if not scheme.available():
                rows_out.append(base | {"status": "module_unavailable", "error": f"no module {scheme.module}"})
                continue
            if scheme.name not in built:
                try:
                    folder = f"{out}/built/{scheme.name}-{os.path.basename(tempfile.mktemp())}"
                    built[scheme.name] = scheme.build(rows, folder) if scheme.build else rows
                except Exception as why:  # noqa: BLE001
                    built[scheme.name] = None
                    rows_out.append(base | {"status": "build_failed", "error": f"{type(why).__name__}: {why}"[:500]})
            if built[scheme.name] is not None:
                rows_out += [_query_row(system, built[scheme.name], manifest, q, truths[q.id], chosen.measurement) for q in queries]
    failed = any(r["status"] == "gate_failed" for r in rows_out)
    Path(out).mkdir(parents=True, exist_ok=True)
    Path(out, "results.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows_out))
    columns.write_json(str(Path(out, "run.json")), {
        "name": chosen.name, "spec_key": chosen.key(), "started_at": datetime.datetime.now(datetime.UTC).isoformat(), "spark": spark.version, "datasets": about,
        "platform": {"host": platform.node(), "os": platform.system(), "arch": platform.machine(), "cpu": platform.processor() or None, "cores": os.cpu_count()},
    })
    return GATE_FAILED if failed else 0


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """By a specification file, or systems on one dataset."""
    if args.folder.endswith(".toml"):
        return run_spec(spark, spec.load(args.folder), args.suite)
    chosen = spec.Spec("run", tuple(args.variants), (args.folder,), (args.suite,), measurement=spec.Measurement(1, 3, 0.0))
    chosen.chosen()
    return run_spec(spark, chosen, args.out)


def load(spark: SparkSession, args: argparse.Namespace) -> int:
    print(json.dumps({"run": args.folder, "load": loader.Store(spark, args.suite).load(args.folder)}))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gramward")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    p = verbs.add_parser("ingest")
    for name in ("source", "folder", "id", "column"):
        p.add_argument(name)
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "tsv"])
    for verb in ("gen", "bless", "check", "run", "load"):
        p = verbs.add_parser(verb)
        p.add_argument("folder", help="a dataset; for run also a specification (.toml), for load a run")
        p.add_argument("suite", help="a suite; the output of a specification's run; for load the store")
        p.add_argument("--force", action="store_true")
        p.add_argument("--seed", type=int, default=42)
        if verb == "gen":
            p.add_argument("--quick", action="store_true", help="a small grid")
        if verb == "run":
            p.add_argument("out", nargs="?", default="out")
            p.add_argument("--variants", nargs="+", default=["uncompressed/direct+memmem", "dict_like"])
    args = parser.parse_args(argv)
    if args.verb == "list":
        print(json.dumps({"ops": OPS, "scanners": sorted(registry.SCANNERS), "schemes": {n: sorted(s.strategies) for n, s in registry.SCHEMES.items()}}))
        return 0
    try:
        verb = {"ingest": ingest, "gen": gen, "bless": bless, "check": check, "run": run, "load": load}[args.verb]
        return verb(SparkSession.builder.getOrCreate(), args)
    except (ValueError, TypeError, OSError) as why:
        print(f"error: {why}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
