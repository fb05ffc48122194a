"""Parser registry, detection contest, manifests and catalogs."""

from __future__ import annotations

import importlib.metadata
import json
import logging
import os
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.sources.base import SourceParser

LOG = logging.getLogger(__name__)
GROUP = "lodeworks.parsers"
#: Specificity (smaller wins) and confidence of the built-in parsers.
SPECIFICITY = [("cloud_aws_cloudtrail", 5, 0.95), ("macos", 8, 0.95), ("windows", 20, 0.85), ("linux", 20, 0.90), ("generic_json", 100, 0.30), ("generic_xml", 100, 0.30), ("generic_sqlite", 100, 0.30), ("generic_archive", 100, 0.30), ("generic_binary", 100, 0.10)]
TIERS = ("production", "candidate", "prototype", "private")


def contest(claims: DataFrame) -> DataFrame:
    """The winner of (name, specificity, confidence): most specific, most confident, first by name."""
    order = Window.orderBy("specificity", F.desc("confidence"), "name")
    return claims.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


@dataclass
class Manifest:
    """Declared facts of a parser; unknown keys and values out of range are refused."""

    id: str
    name: str
    version: str
    tier: str
    description: str = ""
    specificity: int = 50
    confidence: float | None = None
    default_confidence: float = 0.5
    reliability: str = "C"
    entity_types: list[str] = field(default_factory=list)
    event_types: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z0-9_]+(?:[./][a-z0-9_]+)*", self.id):
            raise ValueError(f"bad id: {self.id!r}")
        if not re.fullmatch(r"\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?", self.version):
            raise ValueError(f"bad version: {self.version!r}")
        if self.tier not in TIERS:
            raise ValueError(f"bad tier: {self.tier!r}")
        if not 1 <= self.specificity <= 100:
            raise ValueError("specificity lies between 1 and 100")
        if self.confidence is None:
            self.confidence = self.default_confidence
        if not 0 <= self.confidence <= 1:
            raise ValueError("confidence lies between 0 and 1")
        if self.reliability not in "ABCDEF" or len(self.reliability) != 1:
            raise ValueError("reliability is one of A to F")


def load_manifest(path: str) -> Manifest:
    """A manifest from a JSON or flat YAML file."""
    with open(path, encoding="utf-8") as source:
        text = source.read()
    data = json.loads(text) if path.endswith(".json") else flat_yaml(text)
    known = set(Manifest.__dataclass_fields__)
    if unknown := set(data) - known:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return Manifest(**data)


def flat_yaml(text: str) -> dict:
    """The subset of YAML that manifests use: scalars, and lists of scalars."""
    out: dict = {}
    key = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- "):
            out.setdefault(key, []) if key else None
            if not isinstance(out.get(key), list):
                out[key] = []
            out[key].append(_scalar(line.lstrip()[2:]))
            continue
        key, _, value = line.partition(":")
        key = key.strip()
        out[key] = _scalar(value) if value.strip() else []
    return out


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False, "null": None}.get(text, text)


def catalogs(folder: str) -> dict[str, list[dict]]:
    """Production and development catalogs of all valid manifests under a folder, by path."""
    out: dict[str, list[dict]] = {"production": [], "devel": []}
    paths = sorted(os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith((".yaml", ".yml", ".json")))
    for path in paths:
        try:
            manifest = load_manifest(path)
        except (ValueError, TypeError, json.JSONDecodeError):
            LOG.warning("invalid manifest: %s", path)
            continue
        if manifest.tier == "production":
            out["production"].append(asdict(manifest))
        elif manifest.tier in ("candidate", "prototype"):
            out["devel"].append(asdict(manifest))
    return out


class Registry:
    """Parsers by name; broken plug-ins are logged and left out."""

    def __init__(self) -> None:
        self._parsers: dict[str, SourceParser] = {}

    def register(self, parser: SourceParser) -> None:
        self._parsers[parser.name] = parser

    def discover(self) -> None:
        from lodeworks.sources import readers

        for kind in readers.BUILT_IN:
            self.register(kind())
        for point in importlib.metadata.entry_points(group=GROUP):
            try:
                self.register(point.load()())
            except Exception as problem:
                LOG.warning("parser %s can't be loaded: %s", point.name, problem)

    def get(self, name: str) -> SourceParser:
        if name not in self._parsers:
            raise ValueError(f"no parser {name!r}; known: {', '.join(sorted(self._parsers))}")
        return self._parsers[name]

    def list(self, tier: str | None = None) -> list[dict]:
        chosen = [p for _, p in sorted(self._parsers.items()) if tier is None or p.tier == tier]
        return [{"name": p.name, "description": p.description, "specificity": p.specificity, "confidence": p.confidence, "tier": p.tier} for p in chosen]

    def list_production(self) -> list[dict]:
        return self.list("production")

    def list_candidate(self) -> list[dict]:
        return self.list("candidate")

    def detect(self, source: str) -> str | None:
        """Name of the parser that claims a source and wins the contest."""
        claims = []
        for parser in self._parsers.values():
            try:
                if parser.identify(source):
                    claims.append((parser.specificity, -parser.confidence, parser.name))
            except OSError:
                continue
        return min(claims)[2] if claims else None
