"""The seventeen tables of a workspace, their keys and links, and upgrades between versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 6
_P4 = "source_version_id long, confidence double, observed_time string, marking string"
#: Columns per table (fixed by the data model).
DDL = {
    "metadata": "key string, value string",
    "files": f"id long, path string, filename string, extension string, size long, permissions string, owner string, group_name string, modified_time string, sha256 string, file_type string, is_symlink int, symlink_target string, {_P4}",
    "binaries": f"id long, file_id long, bundle_id string, executable_name string, arch string, min_os_version string, sdk_version string, code_sign_flags string, team_id string, linked_dylibs string, rpaths string, segments string, has_restrict int, has_pie int, is_encrypted int, {_P4}",
    "daemons": f"id long, label string, plist_path string, program string, program_arguments string, user_name string, group_name string, run_at_load int, keep_alive int, sandbox_profile string, mach_services string, binary_id long, is_disabled int, session_type string, {_P4}",
    "entitlements": f"id long, binary_id long, key string, value string, value_type string, {_P4}",
    "sandbox_profiles": f"id long, name string, profile_path string, raw_sbpl string, rule_count int, allows_network int, allows_mach_lookup int, {_P4}",
    "sandbox_rules": f"id long, profile_id long, operation string, action string, filter_type string, filter_value string, requires string, {_P4}",
    "kexts": f"id long, bundle_id string, name string, version string, file_id long, dependencies string, personalities string, iokit_classes string, has_user_client int, {_P4}",
    "frameworks": f"id long, name string, path string, bundle_id string, version string, is_private int, binary_id long, exported_symbols_count int, {_P4}",
    "versions": "id long, run_id string, parser_name string, source_path string, started_at string, completed_at string, entity_count long, metadata string",
    "observations": "id long, entity_table string, entity_id long, observed_at string, observer string, event_type string, properties string, version_id long, confidence double",
    "atoms": "id long, source_version_id long, entity_type string, source_key string, properties string, created_at string",
    "bags": "id long, entity_type string, canonical_key string, created_at string, resolved_at string, atom_count long, score double",
    "bag_atoms": "bag_id long, atom_id long",
    "resolution_event_log": "id long, event_type string, bag_id long, atom_ids string, reason string, confidence double, operator string, timestamp string",
    "match_candidates": "id long, entity_type string, atom_a long, atom_b long, score double, features string, created_at string",
    "mach_services": f"id long, daemon_id long, service_name string, {_P4}",
}
#: Unique keys.
UNIQUE = {"metadata": ["key"], "files": ["path"], "daemons": ["label"], "sandbox_profiles": ["name"], "kexts": ["bundle_id"], "frameworks": ["path"], "versions": ["run_id"], "atoms": ["source_version_id", "entity_type", "source_key"], "bag_atoms": ["bag_id", "atom_id"], "match_candidates": ["atom_a", "atom_b"], "mach_services": ["daemon_id", "service_name"]}
#: (child, key, parent): links that must hold where the key is not null; parents by id.
LINKS = [("binaries", "file_id", "files"), ("daemons", "binary_id", "binaries"), ("entitlements", "binary_id", "binaries"), ("sandbox_rules", "profile_id", "sandbox_profiles"), ("kexts", "file_id", "files"), ("frameworks", "binary_id", "binaries"), ("mach_services", "daemon_id", "daemons"), ("observations", "version_id", "versions"), ("atoms", "source_version_id", "versions"), ("bag_atoms", "bag_id", "bags"), ("bag_atoms", "atom_id", "atoms")]
LINKS += [(t, "source_version_id", "versions") for t in ("files", "binaries", "daemons", "entitlements", "sandbox_profiles", "sandbox_rules", "kexts", "frameworks", "mach_services")]
DEFAULTS = {"confidence": 1.0, "marking": "UNCLASSIFIED", "is_symlink": 0, "has_pie": 1, "has_restrict": 0, "is_encrypted": 0, "run_at_load": 0, "keep_alive": 0, "is_disabled": 0, "has_user_client": 0, "is_private": 0, "exported_symbols_count": 0, "rule_count": 0, "allows_network": 0, "allows_mach_lookup": 0, "size": 0, "atom_count": 1}


class SchemaVersionError(ValueError):
    """A workspace of a version that can't be read."""


class SchemaValidationError(ValueError):
    """A workspace whose tables are not what its version says."""


def struct(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame([], ddl) for t, ddl in DDL.items()}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; missing ones take their default or null."""
    out = []
    for f in struct(table).fields:
        default = F.lit(DEFAULTS.get(f.name))
        value = F.coalesce(F.col(f.name), default) if f.name in df.columns and f.name in DEFAULTS else F.col(f.name) if f.name in df.columns else default
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def validate(tables: dict[str, DataFrame]) -> None:
    """SchemaValidationError unless every table is there with all its columns."""
    for name in DDL:
        if name not in tables:
            raise SchemaValidationError(f"table {name} is missing")
        missing = [f.name for f in struct(name).fields if f.name not in tables[name].columns]
        if missing:
            raise SchemaValidationError(f"table {name} lacks {', '.join(missing)}")


#: What each version added: tables, and columns by table.
ADDED = {3: ({"mach_services"}, {}), 4: ({"atoms", "bags", "bag_atoms", "resolution_event_log"}, {}), 5: ({"match_candidates"}, {"bags": ["score"]}), 6: (set(), {t: ["source_version_id", "confidence", "observed_time", "marking"] for t in ("mach_services",)})}


def upgrade(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Tables of an older version brought to the current one; steps only add."""
    if not 2 <= version <= SCHEMA_VERSION:
        raise SchemaVersionError(f"schema version {version} is not supported")
    spark = next(iter(tables.values())).sparkSession
    out = dict(tables)
    for step in range(version + 1, SCHEMA_VERSION + 1):
        new_tables, columns = ADDED[step]
        for t in new_tables:
            out.setdefault(t, spark.createDataFrame([], DDL[t]))
        for t in columns:
            if t in out:
                out[t] = conform(out[t], t)
    out = {t: conform(df, t) for t, df in out.items()}
    validate(out)
    return out


def link_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """child, child_key, parent, violations of links that don't hold."""
    from lodeworks.sources.columns import foreign_key_violations

    links = [(c, k, p, "id") for c, k, p in LINKS if c in tables and p in tables]
    return foreign_key_violations(tables, links).where("violations > 0")


def duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, repeated: how many unique keys occur more than once."""
    parts = []
    for t, keys in UNIQUE.items():
        if t in tables:
            more = tables[t].groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
            parts.append(more.agg(F.count("*").alias("repeated")).select(F.lit(t).alias("table_name"), "repeated"))
    return reduce(DataFrame.unionByName, parts)
