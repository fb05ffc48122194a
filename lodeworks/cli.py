"""Command line: build, query, exec, diff, parser and resolve."""

from __future__ import annotations

import argparse
import os
import sys

from lodeworks.operators import matching, resolver
from lodeworks.operators.diff import Differ
from lodeworks.operators.query import ReadOnlyViolation


def _registry():
    from lodeworks.sources.registry import Registry

    registry = Registry()
    registry.discover()
    return registry


def build(args, spark) -> int:
    from lodeworks.pipeline import Context, default_pipeline

    registry = _registry()
    parser = args.parser or registry.detect(args.source)
    if parser is None:
        print("no parser recognises the source", file=sys.stderr)
        return 1
    flow = default_pipeline(args.source, parser, registry, args.resolve, args.skip_sanitize)
    for name, stats in flow.run(Context(spark, args.source, args.output, parser), args.fresh).items():
        print(f"{name}: {stats}")
    return 0


def query(args, spark) -> int:
    from lodeworks.workspace import Workspace

    try:
        engine = Workspace(spark, args.workspace).query(args.allow_unverified)
    except PermissionError as problem:
        print(problem, file=sys.stderr)
        return 3
    try:
        if args.stats:
            for name, rows in engine.stats().items():
                print(f"{name}: {rows}")
        elif args.search:
            print(engine.search(args.search, args.table).to_markdown())
        else:
            print(engine.execute(args.sql).to_markdown())
    except ReadOnlyViolation as problem:
        print(problem, file=sys.stderr)
        return 2
    return 0


def execute(args, spark) -> int:
    from lodeworks.workspace import Workspace

    print(f"writing to {args.workspace}")
    print(f"affected rows: {Workspace(spark, args.workspace).execute_write(args.sql)}")
    return 0


def diff(args, spark) -> int:
    from lodeworks.operators import stix
    from lodeworks.pipeline import now
    from lodeworks.workspace import Workspace

    differ = Differ(Workspace(spark, args.old).tables(), Workspace(spark, args.new).tables())
    report = differ.generate_report()
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(report)
    else:
        print(report)
    if args.stix:
        stix.write_bundle(stix.diff_notes(differ.unified(), now()), args.stix)
    return 0


def parser_command(args, spark) -> int:
    from lodeworks import harness
    from lodeworks.sources.registry import load_manifest

    if args.action == "list":
        for p in _registry().list():
            print(f"{p['name']}: {p['description']} ({p['tier']}, specificity {p['specificity']}, confidence {p['confidence']})")
        return 0
    if args.action == "validate":
        print(load_manifest(args.target))
        return 0
    results = harness.run_gates(_registry().get(args.target), spark, args.fixture)
    for r in results:
        print(f"{r.name}: {'passed' if r.passed else 'FAILED ' + r.message}")
    return 0 if all(r.passed for r in results) else 1


def resolve(args, spark) -> int:
    from pyspark.sql import functions as F

    from lodeworks import schema
    from lodeworks.pipeline import now
    from lodeworks.workspace import Workspace

    if not 0 <= args.threshold <= 1 or not all(Workspace(spark, s).exists for s in args.sources):
        print("the threshold lies between 0 and 1, and every source must exist", file=sys.stderr)
        return 1
    kinds = list(matching.PROJECTIONS) if args.entity_type == "all" else [args.entity_type]
    tables = schema.empty(spark)
    sources = {i: Workspace(spark, s).tables() for i, s in enumerate(args.sources, 1)}
    tables["versions"] = spark.createDataFrame([(i, str(i), "resolve", os.path.abspath(s), None, None, 0, "{}") for i, s in enumerate(args.sources, 1)], schema.DDL["versions"])
    for kind in kinds:
        rows = None
        for i, t in sources.items():
            own = t[kind]
            if kind == "binaries":
                own = own.join(t["files"].select(F.col("id").alias("file_id"), "path", "sha256"), "file_id", "left")
            own = own.withColumn("source_version_id", F.lit(i).cast("long"))
            rows = own if rows is None else rows.unionByName(own)
        atoms = matching.atomize(rows, kind).withColumn("id", F.abs(F.xxhash64("source_version_id", "entity_type", "source_key")))
        tables["atoms"] = tables["atoms"].unionByName(schema.conform(atoms, "atoms"))
        if args.atomize_only:
            continue
        wide = atoms.select("*", *[F.get_json_object("properties", f"$.{r.field}").alias(r.field) for r in matching.SCORING_SPECS[kind]])
        done = resolver.resolve_scored(wide, kind, args.threshold)
        for name, rows in resolver.stored(done, kind, now()).items():
            tables[name] = tables[name].unionByName(schema.conform(rows, name))
        print(f"{kind}: {done.counts}")
        if done.overflow:
            print(f"{kind}: {done.overflow} atoms in buckets too large to be paired in full", file=sys.stderr)
    os.makedirs(args.out, exist_ok=True)
    Workspace(spark, args.out).save(tables)
    return 0


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodeworks")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build")
    for flag in ("--source", "--output"):
        p.add_argument(flag, required=True)
    p.add_argument("--parser")
    for flag in ("--fresh", "--skip-sanitize", "--resolve"):
        p.add_argument(flag, action="store_true")
    p.set_defaults(run=build)
    p = sub.add_parser("query")
    p.add_argument("workspace")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--sql")
    what.add_argument("--search")
    what.add_argument("--stats", action="store_true")
    p.add_argument("--table", default="files")
    p.add_argument("--allow-unverified", action="store_true")
    p.set_defaults(run=query)
    p = sub.add_parser("exec")
    p.add_argument("workspace")
    p.add_argument("--sql", required=True)
    p.set_defaults(run=execute)
    p = sub.add_parser("diff")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("--output")
    p.add_argument("--stix")
    p.set_defaults(run=diff)
    p = sub.add_parser("parser")
    p.add_argument("action", choices=("validate", "test", "list"))
    p.add_argument("target", nargs="?")
    p.add_argument("--fixture")
    p.set_defaults(run=parser_command)
    p = sub.add_parser("resolve")
    p.add_argument("--out", required=True)
    p.add_argument("--entity-type", choices=(*matching.PROJECTIONS, "all"), default="all")
    p.add_argument("--threshold", type=float, default=resolver.THRESHOLD)
    p.add_argument("--atomize-only", action="store_true")
    p.add_argument("sources", nargs="+")
    p.set_defaults(run=resolve)
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = arguments().parse_args(argv)
    if spark is None:
        from lodeworks.session import build_session

        spark = build_session()
    try:
        return args.run(args, spark)
    except (ValueError, OSError, RuntimeError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
