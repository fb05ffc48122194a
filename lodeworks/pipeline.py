"""Build of a workspace in phases, with checkpoints, fingerprint, provenance and gates."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks import __version__, schema
from lodeworks.operators import matching, resolver, sanitize
from lodeworks.sources.registry import Registry
from lodeworks.workspace import Workspace

STAMPED = ("files", "binaries", "daemons", "entitlements", "sandbox_profiles", "sandbox_rules", "kexts", "frameworks", "mach_services")


class FingerprintMismatch(RuntimeError):
    """A checkpoint of another source, parser, engine version or configuration."""


class OutputExists(RuntimeError):
    """The output is there already and no checkpoint of it."""


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def fingerprint(source: str, parser: str, config: dict) -> str:
    """Canonical JSON of all that must agree for a run to be resumed."""
    return json.dumps({"source": os.path.abspath(source), "parser": parser, "engine": __version__, "schema": schema.SCHEMA_VERSION, "config": config}, sort_keys=True, separators=(",", ":"))


@dataclass
class Context:
    spark: SparkSession
    source: str
    output: str
    parser: str
    started_at: str = field(default_factory=now)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    version_id: int = 1


@dataclass(frozen=True)
class Phase:
    name: str
    handler: Callable[[Context], dict]
    description: str = ""


class CheckpointLog:
    """Phase records beside the output, and the tables as the last complete phase left them."""

    def __init__(self, output: str) -> None:
        self.folder = output.rstrip("/") + ".run"
        self.path = os.path.join(self.folder, "phases.json")

    def read(self) -> dict | None:
        if not os.path.exists(self.path):
            return None
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def write(self, state: dict) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(state, f)
        os.replace(self.path + ".new", self.path)

    def clear(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Pipeline:
    def __init__(self, phases: list[Phase], mark: str) -> None:
        self.phases, self.mark = phases, mark

    def run(self, context: Context, fresh: bool = False) -> dict[str, dict]:
        """All phases in order, resuming behind the last complete one of an equal run.

        The output changes only when all phases are through. ``fresh`` forgets checkpoints
        and replaces an existing output.
        """
        log = CheckpointLog(context.output)
        space = Workspace(context.spark, context.output)
        if fresh:
            log.clear()
        state = log.read()
        if state is not None and state.get("fingerprint") != self.mark:
            raise FingerprintMismatch("the checkpoint belongs to a different run; start fresh")
        if state is None and space.exists and not fresh:
            raise OutputExists(context.output)
        names = [p.name for p in self.phases]
        if state is None or state["names"] != names:
            state = {"fingerprint": self.mark, "names": names, "done": [], "stats": {}, "started_at": context.started_at}
        context.started_at = state["started_at"]
        staged = Workspace(context.spark, os.path.join(log.folder, "tables"))
        if state["done"] and staged.exists:
            context.tables = staged.tables()
        before = dict(context.tables)
        for phase in self.phases[len(state["done"]) :]:
            log.write(state | {"running": phase.name})
            try:
                stats = phase.handler(context)
            except BaseException as error:
                log.write(state | {"failed": phase.name})
                if isinstance(error, sanitize.SanitizationFailed):
                    self._mark_failed(context, space)
                raise
            if context.tables:
                # Tables the phase left alone are linked, not written again.
                staged.save(context.tables, {n for n, t in context.tables.items() if t is before.get(n)})
                context.tables = staged.tables()
                before = dict(context.tables)
            state["done"].append(phase.name)
            state["stats"][phase.name] = stats
            log.write(state)
        finished = context.tables["versions"].withColumn("completed_at", F.coalesce("completed_at", F.lit(now())))
        total = sum(v for v in state["stats"].get("ingest", {}).values() if isinstance(v, int))
        context.tables["versions"] = finished.withColumn("entity_count", F.lit(total).cast("long"))
        try:
            self._gate(context)
        except sanitize.SanitizationFailed:
            self._mark_failed(context, space)
            raise
        os.makedirs(context.output, exist_ok=True)
        space.save(context.tables)
        log.clear()
        return state["stats"]

    @staticmethod
    def _mark_failed(context: Context, space: Workspace) -> None:
        """Leave a workspace that says its sanitation failed and holds nothing else but its runs.

        Readers refuse it; what was not proved clean is not published. A finished workspace of
        an earlier build stays as it is.
        """
        if space.exists:
            return
        _metadata(context, sanitize_status="FAILED")
        os.makedirs(context.output, exist_ok=True)
        space.save({n: context.tables[n] for n in ("metadata", "versions") if n in context.tables})

    @staticmethod
    def _gate(context: Context) -> None:
        """Rescan after the last write to the key-value table; a finding fails the build."""
        status = sanitize.sanitization_status({r["key"]: r["value"] for r in context.tables["metadata"].collect()})
        if status == "verified" and any(sanitize.verify_clean(context.tables).values()):
            raise sanitize.SanitizationFailed("findings in the finished tables")


def _metadata(context: Context, **pairs: str) -> None:
    rows = context.spark.createDataFrame([(k, v) for k, v in pairs.items()], "key string, value string")
    kept = context.tables["metadata"].join(rows.select("key"), "key", "left_anti").select("key", "value")
    context.tables["metadata"] = kept.unionByName(rows)


def stamp(tables: dict[str, DataFrame], version_id: int, started_at: str) -> dict[str, DataFrame]:
    """Provenance of rows a run wrote: version and time of observation, where none is set."""
    out = {}
    for name, df in tables.items():
        df = schema.conform(df, name) if name in schema.DDL else df
        if name in STAMPED:
            df = df.withColumns({"source_version_id": F.coalesce("source_version_id", F.lit(version_id).cast("long")), "observed_time": F.coalesce("observed_time", F.lit(started_at))})
        elif name == "observations":
            df = df.withColumn("version_id", F.coalesce("version_id", F.lit(version_id).cast("long")))
        out[name] = df
    return out


def default_pipeline(source: str, parser: str, registry: Registry, resolve: bool = False, skip_sanitize: bool = False) -> Pipeline:
    """init, ingest, relationships, verify, resolve if wished, and sanitize or a mark that it was skipped."""
    reader = registry.get(parser)

    def init(c: Context) -> dict:
        c.tables = schema.empty(c.spark)
        c.tables["versions"] = c.spark.createDataFrame([(c.version_id, uuid.uuid4().hex, parser, os.path.abspath(source), c.started_at, None, 0, "{}")], schema.DDL["versions"])
        _metadata(c, schema_version=str(schema.SCHEMA_VERSION))
        return {"tables": len(c.tables)}

    def ingest(c: Context) -> dict:
        found = reader.extract_entities(c.spark, source)
        for name, df in found.items():
            if "id" not in df.columns and name not in ("bag_atoms", "metadata"):
                found[name] = df.withColumn("id", F.abs(F.xxhash64(*[F.col(x) for x, t in df.dtypes if t in ("string", "bigint")])))
        c.tables |= stamp(found, c.version_id, c.started_at)
        return {n: c.tables[n].count() for n in found}

    def relationships(c: Context) -> dict:
        c.tables |= stamp(reader.extract_relationships(c.tables), c.version_id, c.started_at)
        return {"linked": c.tables["daemons"].where("binary_id IS NOT NULL").count()}

    def verify(c: Context) -> dict:
        counts = reader.verify({n: t for n, t in c.tables.items() if n in reader.entity_types})
        broken = schema.link_violations(c.tables).limit(1).collect()
        if broken:
            raise ValueError(f"broken link: {broken[0]['child']}.{broken[0]['child_key']} -> {broken[0]['parent']}")
        return counts

    def resolution(c: Context) -> dict:
        merged = {}
        for kind in matching.PROJECTIONS:
            rows = c.tables[kind]
            if kind == "binaries":
                rows = rows.join(c.tables["files"].select(F.col("id").alias("file_id"), "path", "sha256"), "file_id", "left")
            atoms = matching.atomize(rows, kind).withColumn("id", F.abs(F.xxhash64("source_version_id", "entity_type", "source_key")))
            if atoms.isEmpty():
                continue
            fields = [r.field for r in matching.SCORING_SPECS[kind]]
            wide = atoms.select("*", *[F.get_json_object("properties", f"$.{f}").alias(f) for f in fields])
            done = resolver.resolve_scored(wide, kind)
            c.tables["atoms"] = c.tables["atoms"].unionByName(schema.conform(atoms, "atoms"))
            for name, rows in resolver.stored(done, kind, c.started_at).items():
                c.tables[name] = c.tables[name].unionByName(schema.conform(rows, name))
            merged[kind] = done.counts["merges"]
        return merged

    def clean(c: Context) -> dict:
        try:
            c.tables, before = sanitize.sanitize_output(c.tables)
        except sanitize.SanitizationFailed:
            _metadata(c, sanitize_status="FAILED")
            raise
        _metadata(c, sanitize_status="verified")
        return {n: v for n, v in before.items() if v}

    def skipped(c: Context) -> dict:
        _metadata(c, sanitize_skipped="true")
        return {}

    phases = [Phase("init", init), Phase("ingest", ingest), Phase("relationships", relationships), Phase("verify", verify)]
    phases += [Phase("resolve", resolution)] if resolve else []
    phases.append(Phase("sanitize_skipped", skipped) if skip_sanitize else Phase("sanitize", clean))
    return Pipeline(phases, fingerprint(source, parser, {"resolve": resolve, "skip_sanitize": skip_sanitize}))
