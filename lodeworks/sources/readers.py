"""The built-in parsers: trail logs, Apple, Linux and Windows trees, and generic files."""

from __future__ import annotations

import io
import json
import os
import plistlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.jsonwalk import records
from lodeworks.operators.diff import first_wins
from lodeworks.sources import columns as C
from lodeworks.sources import macho
from lodeworks.sources.base import SourceParser, catalogued, contents, with_ids

OBSERVED = "path string, event_type string, properties string"
TRAIL_LIMIT, JSON_LIMIT = 200_000_000, 50_000_000
#: Types by extension (fixed values per system).
WINDOWS_TYPES = {".exe": "binary", ".dll": "dylib", ".sys": "driver", ".json": "config", ".xml": "config", ".ini": "config", ".pdb": "debug", ".pak": "resource", ".dat": "data", ".manifest": "manifest", ".cat": "catalog"}
LINUX_TYPES = {".so": "shared_lib", ".service": "systemd_unit", ".conf": "config", ".py": "script"}
APPLE_TYPES = {".plist": "plist", ".dylib": "binary", ".framework": "bundle", ".kext": "bundle", ".app": "bundle", ".appex": "bundle", ".sb": "sandbox_profile", ".sqlite": "database", ".db": "database", ".png": "image", ".jpg": "image", ".car": "asset_catalog", ".strings": "strings", ".nib": "nib"}
#: Folders that systems keep their programs and services in (fixed values).
UNIT_DIRS = ("lib/systemd/system", "usr/lib/systemd/system", "usr/local/lib/systemd/system", "etc/systemd/system", "run/systemd/system")
BIN_DIRS = ("usr/bin", "usr/sbin", "bin", "sbin", "usr/libexec")
LIB_DIRS = ("usr/lib", "lib", "usr/lib64", "lib64")
LAUNCH_DIRS = ("System/Library/LaunchDaemons", "System/Library/LaunchAgents", "Library/LaunchDaemons", "Library/LaunchAgents")
ARCHIVE_MEMBERS, TAR_INFLATE, SQLITE_TABLES = 50, 64 * 1024 * 1024, 30


def _some(source: str, endings: tuple[str, ...], files: int = 5000, dirs: int = 1000) -> bool:
    """Whether a file with one of the endings is among the first ones of a tree."""
    seen = 0
    for folder, _, names in islice(os.walk(source), dirs):
        for name in names:
            seen += 1
            if name.lower().endswith(endings):
                return True
            if seen >= files:
                return False
    return False


def _under(column: str, dirs: tuple[str, ...], directly: bool = False):
    tests = [F.col(column).rlike("^/" + d + ("/[^/]+$" if directly else "/")) for d in dirs]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _with_content(spark: SparkSession, source: str, files: DataFrame, limit: int = C.HASH_LIMIT) -> DataFrame:
    regular = files.where("is_symlink = 0").select("id", "path", "filename", "extension")
    return regular.join(contents(spark, source, limit), "path")


class Windows(SourceParser):
    name, description, specificity, confidence = "windows", "Windows file tree", 20, 0.85
    entity_types = ("files", "binaries", "frameworks")

    def identify(self, source):
        return os.path.isdir(source) and _some(source, (".exe", ".dll"))

    def extract_entities(self, spark, source):
        files = catalogued(spark, source, WINDOWS_TYPES)
        programs = _with_content(spark, source, files).where(F.lower("extension").isin("exe", "dll") & C.has_magic(F.col("content"), "4d5a"))
        binaries = programs.select(F.col("id").alias("file_id"), F.col("filename").alias("executable_name"), C.pe_arch(F.col("content")).alias("arch"), "path", "extension")
        libraries = binaries.where("lower(extension) = 'dll'").select(F.regexp_replace("executable_name", r"\.[^.]*$", "").alias("name"), "path", F.lit(0).alias("is_private"))
        return {"files": files, "binaries": with_ids(binaries).drop("extension", "path"), "frameworks": with_ids(libraries)}


class Linux(SourceParser):
    name, description, specificity, confidence = "linux", "Linux root file system", 20, 0.90
    entity_types = ("files", "binaries", "daemons", "frameworks")

    def identify(self, source):
        return any(os.path.exists(os.path.join(source, p)) for p in ("etc/passwd", "usr/bin", "lib/systemd"))

    def extract_entities(self, spark, source):
        files = catalogued(spark, source, LINUX_TYPES)
        read = _with_content(spark, source, files)
        elf = read.where(C.has_magic(F.col("content"), "7f454c46"))
        binaries = elf.where(_under("path", BIN_DIRS)).select(F.col("id").alias("file_id"), F.col("filename").alias("executable_name"), C.elf_arch(F.col("content")).alias("arch"), "path")
        libraries = elf.where(_under("path", LIB_DIRS) & F.col("filename").rlike(r"\.so(\.|$)")).select(F.col("filename").alias("name"), "path", F.lit(0).alias("is_private"))
        units = read.where(_under("path", UNIT_DIRS, True) & F.col("filename").endswith(".service") & (F.col("length") < C.UNIT_LIMIT))
        daemons = units.select(F.regexp_replace("filename", r"\.service$", "").alias("label"), F.col("path").alias("plist_path"), C.exec_start(C.text("content")).alias("program"), F.lit(None).cast("long").alias("binary_id"))
        daemons = with_ids(first_wins(daemons, ["label"], [F.col("plist_path")]), "label")
        return {"files": files, "binaries": with_ids(binaries).drop("path"), "daemons": daemons, "frameworks": with_ids(libraries)}


def _plist(data: bytes) -> dict | None:
    try:
        found = plistlib.loads(data)
        return found if isinstance(found, dict) else None
    except Exception:
        return None


def _text(value: object) -> str | None:
    """Text of a property-list scalar; containers as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, (int, float)) else json.dumps(value, default=str)


def typed(value: object) -> tuple[str, str]:
    """(text, type) of an entitlement value."""
    kinds = ((bool, "boolean"), (str, "string"), (int, "integer"), (list, "array"), (dict, "dict"))
    return _text(value) or "", next((name for kind, name in kinds if isinstance(value, kind)), "other")


class Apple(SourceParser):
    name, description, specificity, confidence = "macos", "Apple root file system", 8, 0.95
    entity_types = ("files", "binaries", "entitlements", "daemons", "mach_services", "kexts", "frameworks", "sandbox_profiles")

    def identify(self, source):
        if not os.path.isdir(source):
            return False
        base = os.path.join(source, "System/Library")
        if os.path.exists(os.path.join(base, "CoreServices/SystemVersion.plist")):
            return True
        return sum(os.path.isdir(os.path.join(base, d)) for d in ("LaunchDaemons", "Frameworks", "CoreServices", "Extensions")) >= 2

    def extract_entities(self, spark, source):
        hidden = r"(^|/)(\.[^/]+|__pycache__)/"
        files = catalogued(spark, source, APPLE_TYPES).where(~F.col("path").rlike(hidden))
        read = _with_content(spark, source, files)

        def programs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for file_id, path, name, data in zip(part["id"], part["path"], part["filename"], part["content"]):
                    if (found := macho.info(bytes(data))) is not None:
                        grants = [(k, *typed(v)) for k, v in sorted(found["entitlements"].items())]
                        rows.append((file_id, path, name, found["arch"], found["code_sign_flags"], grants))
                yield pd.DataFrame(rows, columns=["file_id", "path", "executable_name", "arch", "code_sign_flags", "grants"])

        magic = F.hex(F.substring("content", 1, 4)).isin(*[m.hex().upper() for m in (*macho.THIN, *macho.FAT)])
        found = with_ids(read.where(magic).select("id", "path", "filename", "content").mapInPandas(programs, "file_id long, path string, executable_name string, arch string, code_sign_flags string, grants array<struct<key:string,value:string,value_type:string>>"))

        def lists(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for path, data in zip(part["path"], part["content"]):
                    if (p := _plist(bytes(data))) is None:
                        continue
                    args = p.get("ProgramArguments")
                    args = args if isinstance(args, list) else []
                    services = p.get("MachServices")
                    services = sorted(services) if isinstance(services, dict) else [s for s in services if isinstance(s, str)] if isinstance(services, list) else []
                    classes = sorted({_text(x.get("IOClass")) for x in (p.get("IOKitPersonalities") or {}).values() if isinstance(x, dict) and x.get("IOClass")}) if isinstance(p.get("IOKitPersonalities"), dict) else []
                    client = int("IOUserClientClass" in json.dumps(p.get("IOKitPersonalities"), default=str))
                    rows.append((path, _text(p.get("Label")), _text(p.get("Program") or (args[0] if args else None)), json.dumps(args, default=str), _text(p.get("UserName")), int(bool(p.get("RunAtLoad"))), int(bool(p.get("KeepAlive"))), int(bool(p.get("Disabled"))), _text(p.get("SandboxProfile") or p.get("POSIXSpawnSandboxProfile")), services, _text(p.get("CFBundleIdentifier")), _text(p.get("CFBundleName")), _text(p.get("CFBundleVersion") or p.get("CFBundleShortVersionString")), classes, client, json.dumps(sorted(p.get("OSBundleLibraries") or {}), default=str)))
                yield pd.DataFrame(rows, columns=["path", "label", "program", "program_arguments", "user_name", "run_at_load", "keep_alive", "is_disabled", "sandbox_profile", "services", "bundle_id", "bundle_name", "version", "classes", "has_user_client", "dependencies"])

        schema = "path string, label string, program string, program_arguments string, user_name string, run_at_load int, keep_alive int, is_disabled int, sandbox_profile string, services array<string>, bundle_id string, bundle_name string, version string, classes array<string>, has_user_client int, dependencies string"
        plists = read.where(F.col("filename").endswith(".plist")).select("path", "content").mapInPandas(lists, schema)
        rank = F.lit(len(LAUNCH_DIRS))
        for i, d in reversed(list(enumerate(LAUNCH_DIRS))):
            rank = F.when(F.col("path").rlike(f"^/{d}/[^/]+$"), F.lit(i)).otherwise(rank)
        jobs = plists.where(_under("path", LAUNCH_DIRS, True)).withColumn("label", F.coalesce("label", F.regexp_extract("path", r"([^/]+)\.plist$", 1)))
        jobs = with_ids(first_wins(jobs.withColumn("rank", rank), ["label"], [F.col("rank"), F.col("path")]), "label")
        services = jobs.select(F.col("id").alias("daemon_id"), F.explode("services").alias("service_name")).distinct()
        daemons = jobs.select("id", "label", F.col("path").alias("plist_path"), "program", "program_arguments", "user_name", "run_at_load", "keep_alive", "is_disabled", "sandbox_profile", F.when(F.size("services") > 0, F.to_json("services")).alias("mach_services"), F.lit(None).cast("long").alias("binary_id"))
        kexts = plists.where(F.col("path").rlike(r"\.kext/(Contents/)?Info\.plist$") & F.col("bundle_id").isNotNull())
        kexts = first_wins(kexts, ["bundle_id"], [F.col("path")]).select("bundle_id", F.col("bundle_name").alias("name"), "version", "dependencies", F.to_json("classes").alias("iokit_classes"), "has_user_client")
        frames = plists.where(F.col("path").rlike(r"^/System/Library/(Private)?Frameworks/[^/]+\.framework/.*Info\.plist$"))
        frames = frames.select(F.regexp_extract("path", r"/([^/]+)\.framework/", 1).alias("name"), F.regexp_extract("path", r"^(.*?\.framework)/", 1).alias("path"), "bundle_id", "version", F.col("path").contains("/PrivateFrameworks/").cast("int").alias("is_private"))
        profiles = files.where(F.col("filename").endswith(".sb")).select(F.regexp_replace("filename", r"\.sb$", "").alias("name"), F.col("path").alias("profile_path"))
        entitlements = found.select(F.col("id").alias("binary_id"), F.explode("grants").alias("g")).select("binary_id", "g.*").distinct()
        return {"files": files, "binaries": found.drop("path", "grants"), "entitlements": entitlements, "daemons": daemons, "mach_services": services, "kexts": with_ids(kexts, "bundle_id"), "frameworks": with_ids(first_wins(frames, ["path"], [F.col("version")])), "sandbox_profiles": with_ids(first_wins(profiles, ["name"], [F.col("profile_path")]), "name")}


def trail_records(bodies: DataFrame) -> DataFrame:
    """doc_id, record_pos and the fields of trail records as text, from (doc_id, body)."""
    fields = ("arn", "user_type", "account", "event_time", "event_name", "event_source", "event_id", "source_ip", "region", "error_code", "error_message", "request", "response")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, body in zip(part["doc_id"], part["body"]):
                for pos, r in enumerate(records(body)):
                    if not isinstance(r, dict):
                        continue
                    who = r.get("userIdentity") if isinstance(r.get("userIdentity"), dict) else {}
                    payload = [json.dumps(r[k]) if isinstance(r.get(k), dict) else None for k in ("requestParameters", "responseElements")]
                    rows.append((doc, pos, *[_text(who.get(k)) for k in ("arn", "type", "accountId")], *[_text(r.get(k)) for k in ("eventTime", "eventName", "eventSource", "eventID", "sourceIPAddress", "awsRegion", "errorCode", "errorMessage")], *payload))
            yield pd.DataFrame(rows, columns=["doc_id", "record_pos", *fields])

    return bodies.mapInPandas(read, "doc_id string, record_pos long, " + ", ".join(f"{f} string" for f in fields))


def trail_tables(bodies: DataFrame) -> dict[str, DataFrame]:
    """daemons (one per identity, the first record decides) and observations (deduplicated events).

    Records without identity are left out, events without time too. Events are the same if
    identity, time, name and event id (missing counts as empty) agree.
    """
    known = trail_records(bodies).where("arn IS NOT NULL AND arn <> ''")
    first = first_wins(known, ["arn"], [F.col("doc_id"), F.col("record_pos")])
    daemons = with_ids(first.select(F.col("arn").alias("label"), F.col("doc_id").alias("plist_path"), F.col("user_type").alias("program"), F.col("account").alias("user_name"), F.lit(None).cast("long").alias("binary_id")), "label")
    timed = known.where("event_time IS NOT NULL").withColumn("event_id", F.coalesce("event_id", F.lit("")))
    events = first_wins(timed, ["arn", "event_time", "event_name", "event_id"], [F.col("doc_id"), F.col("record_pos")])
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    properties = F.to_json(F.struct(full("event_id").alias("eventID"), full("source_ip").alias("sourceIPAddress"), full("region").alias("awsRegion"), full("error_code").alias("errorCode"), full("error_message").alias("errorMessage"), F.col("request").alias("requestParameters"), F.col("response").alias("responseElements")))
    seen = events.select(F.lit("daemons").alias("entity_table"), F.abs(F.xxhash64("arn")).alias("entity_id"), F.col("event_time").alias("observed_at"), F.col("event_source").alias("observer"), F.col("event_name").alias("event_type"), properties.alias("properties"), F.lit(0.90).alias("confidence"))
    return {"daemons": daemons, "observations": seen}


class Trail(SourceParser):
    name, description, specificity, confidence = "cloud_aws_cloudtrail", "Cloud audit trail logs", 5, 0.95
    entity_types, event_types = ("files", "daemons", "observations"), ("*",)

    def identify(self, source):
        for folder, _, names in islice(os.walk(source), 100):
            for name in sorted(names):
                if not name.endswith(".json"):
                    continue
                try:
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        first = records(f.read(5_000_000))[:1]
                except (OSError, UnicodeDecodeError):
                    continue
                if first and isinstance(first[0], dict) and {"eventVersion", "eventSource"} <= first[0].keys():
                    return True
        return False

    def extract_entities(self, spark, source):
        files = catalogued(spark, source, {".json": "json"}).where("extension = 'json'")
        bodies = _with_content(spark, source, files, TRAIL_LIMIT).select(F.col("path").alias("doc_id"), C.text("content").alias("body"))
        return {"files": files} | trail_tables(bodies)


class _Generic(SourceParser):
    """Files of some endings, with one observation per file."""

    specificity, confidence = 100, 0.30
    endings: tuple[str, ...] = ()
    entity_types = ("files", "observations")

    def identify(self, source):
        return os.path.isdir(source) and _some(source, self.endings)

    def observe(self, read: DataFrame) -> DataFrame | None:
        return None

    def extract_entities(self, spark, source):
        files = catalogued(spark, source, {})
        if self.endings:
            files = files.where(F.lower("filename").rlike("(" + "|".join(e.replace(".", r"\.") for e in self.endings) + ")$"))
        seen = self.observe(_with_content(spark, source, files))
        out = {"files": files}
        if seen is not None:
            out["observations"] = seen.select(F.lit("files").alias("entity_table"), F.abs(F.xxhash64("path")).alias("entity_id"), "event_type", "properties")
        return out


class GenericJson(_Generic):
    name, description, endings, event_types = "generic_json", "JSON files", (".json",), ("json_keys",)

    def observe(self, read):
        text = C.text("content")
        keyed = read.where(F.col("length") <= JSON_LIMIT).select("path", C.json_keys(text).alias("properties"))
        return keyed.where("properties IS NOT NULL").select("path", F.lit("json_keys").alias("event_type"), "properties")


class GenericXml(_Generic):
    name, description, endings, entity_types = "generic_xml", "XML files", (".xml",), ("files",)


def _observer(event: str, look):
    def run(read: DataFrame) -> DataFrame:
        def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = [(path, event, found) for path, data in zip(part["path"], part["content"]) if (found := look(path, bytes(data))) is not None]
                yield pd.DataFrame(rows, columns=["path", "event_type", "properties"])

        return read.select("path", "content").mapInPandas(each, OBSERVED)

    return run


def sqlite_tables(path: str, data: bytes) -> str | None:
    """Names of the first tables of an embedded database, read from memory."""
    import sqlite3

    if not data.startswith(b"SQLite format 3\0"):
        return None
    try:
        db = sqlite3.connect(":memory:")
        db.deserialize(data)
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY rowid LIMIT ?", (SQLITE_TABLES,))]
        db.close()
        return json.dumps({"schema_tables": ", ".join(names)})
    except sqlite3.Error:
        return None


class _Bounded(io.RawIOBase):
    """A stream that ends after a number of bytes, so that no archive inflates without end."""

    def __init__(self, inner, most: int) -> None:
        self.inner, self.left = inner, most

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.inner.read(min(len(buffer), self.left))
        buffer[: len(data)] = data
        self.left -= len(data)
        return len(data)


def archive_members(path: str, data: bytes) -> str | None:
    """Names of the first members of a zip or tar archive; compressed tars inflate up to a bound."""
    import gzip
    import tarfile
    import zipfile

    lower, names = path.lower(), []
    try:
        if lower.endswith(".zip"):
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()[:ARCHIVE_MEMBERS]
        elif lower.endswith((".tar", ".tgz", ".tar.gz")):
            raw = io.BytesIO(data) if lower.endswith(".tar") else io.BufferedReader(_Bounded(gzip.GzipFile(fileobj=io.BytesIO(data)), TAR_INFLATE))
            with tarfile.open(fileobj=raw, mode="r|") as tar:
                for member in tar:
                    names.append(member.name)
                    if len(names) >= ARCHIVE_MEMBERS:
                        break
        else:
            return None
    except Exception:
        if not names:
            return None
    return json.dumps({"archive_contents": ", ".join(names)})


class GenericSqlite(_Generic):
    name, description, endings, event_types = "generic_sqlite", "SQLite databases", (".sqlite", ".db", ".sqlite3"), ("schema_tables",)

    def observe(self, read):
        return _observer("schema_tables", sqlite_tables)(read)


class GenericArchive(_Generic):
    name, description, endings, event_types = "generic_archive", "Archives", (".zip", ".tar", ".tgz", ".tar.gz", ".gz"), ("archive_contents",)

    def observe(self, read):
        return _observer("archive_contents", archive_members)(read)


class GenericBinary(_Generic):
    name, description, confidence, event_types = "generic_binary", "Any files, by entropy", 0.10, ("binary_entropy",)

    def identify(self, source):
        return os.path.isdir(source) and any(names for _, _, names in islice(os.walk(source), 100))

    def observe(self, read):
        measured = C.entropy(read.select(F.col("path").alias("id"), "content")).where("shannon_entropy IS NOT NULL")
        return measured.select(F.col("id").alias("path"), F.lit("binary_entropy").alias("event_type"), F.to_json(F.struct("shannon_entropy")).alias("properties"))


BUILT_IN = (Trail, Apple, Windows, Linux, GenericJson, GenericXml, GenericSqlite, GenericArchive, GenericBinary)
