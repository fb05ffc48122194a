"""Gates for parsers: golden counts and fingerprint, conformance, idempotency, no sensitive text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks import schema
from lodeworks.operators import sanitize
from lodeworks.sources.base import SourceParser


@dataclass
class GateResult:
    name: str
    passed: bool
    message: str = ""
    details: dict = field(default_factory=dict)


def content_fingerprint(tables: dict[str, DataFrame]) -> str:
    """Order-free digest of all rows without surrogate ids."""
    total = 0
    for name in sorted(tables):
        df = tables[name]
        columns = [c for c in sorted(df.columns) if c not in ("id", "modified_time") and not c.endswith("_id")]
        row = df.select(F.xxhash64(F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]).alias("h")).agg(F.bit_xor("h").alias("x"), F.count("*").alias("n")).first()
        total ^= ((row["x"] or 0) & (2**64 - 1)) ^ (row["n"] * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return f"{total:016x}"


def _run(parser: SourceParser, spark: SparkSession, source: str) -> dict[str, DataFrame]:
    return parser.extract_relationships(parser.extract_entities(spark, source))


def golden(parser: SourceParser, spark: SparkSession, source: str, expected: dict) -> GateResult:
    tables = _run(parser, spark, source)
    counts = {n: t.count() for n, t in tables.items()}
    wrong = {n: (counts.get(n, 0), c) for n, c in expected.get("entity_counts", {}).items() if counts.get(n, 0) != c}
    if "observation_count" in expected and counts.get("observations", 0) != expected["observation_count"]:
        wrong["observations"] = (counts.get("observations", 0), expected["observation_count"])
    mark = content_fingerprint(tables)
    if expected.get("content_fingerprint") not in (None, mark):
        wrong["content_fingerprint"] = (mark, expected["content_fingerprint"])
    return GateResult("golden", not wrong, "" if not wrong else f"differs: {wrong}", {"counts": counts, "content_fingerprint": mark})


def conformance(parser: SourceParser, spark: SparkSession, source: str) -> GateResult:
    tables = _run(parser, spark, source)
    strange = [n for n in tables if n not in parser.entity_types]
    columns = {n: [c for c in t.columns if c not in schema.struct(n).fieldNames()] for n, t in tables.items() if n in schema.DDL}
    extra = {n: c for n, c in columns.items() if c}
    events = []
    if "observations" in tables and "*" not in parser.event_types:
        events = [r[0] for r in tables["observations"].select("event_type").distinct().collect() if r[0] not in parser.event_types]
    ok = not (strange or extra or events)
    return GateResult("conformance", ok, "" if ok else f"undeclared tables {strange}, columns {extra}, events {events}")


def idempotency(parser: SourceParser, spark: SparkSession, source: str) -> GateResult:
    one, two = (content_fingerprint(_run(parser, spark, source)) for _ in range(2))
    return GateResult("idempotency", one == two, "" if one == two else "two runs differ", {"first": one, "second": two})


def zero_findings(parser: SourceParser, spark: SparkSession, source: str) -> GateResult:
    found = {n: c for n, c in sanitize.verify_clean(_run(parser, spark, source)).items() if c}
    return GateResult("zero_findings", not found, "" if not found else f"findings: {found}", found)


def run_gates(parser: SourceParser, spark: SparkSession, source: str, expected: dict | None = None) -> list[GateResult]:
    gates = [golden(parser, spark, source, expected)] if expected is not None else []
    return [*gates, conformance(parser, spark, source), idempotency(parser, spark, source), zero_findings(parser, spark, source)]
