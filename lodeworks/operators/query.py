"""Questions asked of a workspace: read-only SQL, search, and the canned relationship queries.

Every canned query is a function of the tables it needs; ``EntityQuery`` binds them to a
workspace. All are plain joins, filters and aggregations, left to Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions.markdown import CELL_CHARS, SHOWN_ROWS
from lodeworks.functions.text import blank
from lodeworks.operators import textsearch

#: Tables whose rows are counted by ``stats`` (run and key-value tables are not).
COUNTED = ("files", "binaries", "daemons", "entitlements", "sandbox_profiles", "sandbox_rules", "kexts", "frameworks", "observations", "atoms", "bags", "bag_atoms", "resolution_event_log", "match_candidates", "mach_services")
#: Tables that can be the subject of observations or of a search.
ENTITY_TABLES = ("files", "binaries", "daemons", "entitlements", "sandbox_profiles", "sandbox_rules", "kexts", "frameworks", "mach_services")
SEARCHABLE = {"files": ["path", "filename", "file_type"], "daemons": ["label", "program", "mach_services", "sandbox_profile"], "atoms": ["entity_type", "source_key", "properties"]}
_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
#: First words of statements that only read.
_READING = ("select", "with", "values", "from", "table", "show", "describe", "desc", "explain")
_WRITING_PLANS = re.compile(r"^(Insert|Create|Drop|Alter|Replace|Merge|Update|Delete|Truncate|Overwrite|Append|Set|Reset|Add|Load|Cache|Uncache|Refresh|Repair|Analyze|Rename|Use)")


#: Functions that call into the JVM.
_CODE = re.compile(r"(?i)\b(?:try_)?(?:reflect|java_method)`?\s*\(")


class ReadOnlyViolation(PermissionError):
    """A statement that would write was given to the read-only engine."""


def valid_identifier(name: str, allowed: tuple[str, ...] | None = None) -> str:
    if not _IDENTIFIER.match(name) or (allowed is not None and name not in allowed):
        raise ValueError(f"invalid table or column: {name!r}")
    return name


def guard_reading(spark: SparkSession, sql: str) -> None:
    """Raise ReadOnlyViolation unless the statement only reads; it is parsed, never run."""
    bare = re.sub(r"(?s)/\*.*?\*/|--[^\n]*", " ", sql).strip().lstrip("(").strip()
    unquoted = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", bare)
    if _CODE.search(unquoted):
        raise ReadOnlyViolation("functions that run code are not allowed")
    word = re.split(r"\W+", bare.lower(), maxsplit=1)[0] if bare else ""
    if word not in _READING:
        raise ReadOnlyViolation(f"only reading statements are allowed, not {word.upper() or 'nothing'}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:  # a syntax error is reported when the statement runs
        return
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if _WRITING_PLANS.match(name):
            raise ReadOnlyViolation(f"only reading statements are allowed, not {name}")
        children = node.children()
        stack += [children.apply(i) for i in range(children.length())]


class QueryResult:
    """A lazy result with its presenters."""

    def __init__(self, frame: DataFrame, query_name: str = "query") -> None:
        self.frame, self.query_name = frame, query_name

    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    def count(self) -> int:
        return self.frame.count()

    def as_dicts(self) -> list[dict]:
        return [r.asDict() for r in self.frame.collect()]

    def to_markdown(self) -> str:
        """A table of at most 100 rows; long cells are cut, nulls are empty."""

        def show(value: object) -> str:
            text = "" if value is None else str(value)
            return text if len(text) <= CELL_CHARS else text[: CELL_CHARS - 3] + "..."

        rows = self.frame.limit(SHOWN_ROWS + 1).collect()
        lines = ["| " + " | ".join(self.columns) + " |", "|" + "---|" * len(self.columns)]
        lines += ["| " + " | ".join(show(v) for v in row) + " |" for row in rows[:SHOWN_ROWS]]
        if len(rows) > SHOWN_ROWS:
            lines.append(f"... and {self.count() - SHOWN_ROWS} more rows")
        return "\n".join(lines)


# Canned queries


def root_daemons(daemons: DataFrame) -> DataFrame:
    """Services of root or of no named user that no sandbox profile confines."""
    return daemons.where((F.col("user_name").isNull() | (F.col("user_name") == "root")) & blank(F.col("sandbox_profile"))).orderBy("label")


def top_holders(grants: DataFrame, key: str = "key", limit: int = 50) -> DataFrame:
    """The most frequent keys with the number of their holders; ties by key."""
    return grants.groupBy(key).agg(F.count("*").alias("holders")).orderBy(F.desc("holders"), key).limit(limit)


def grants_of(grants: DataFrame, holders: DataFrame, places: DataFrame, keys: list[str], holder_id: str, place_id: str, key: str = "key") -> DataFrame:
    """Holders of listed keys with the place of each: a three-way join."""
    return grants.where(F.col(key).isin(*keys)).join(holders, holder_id).join(places, place_id)


def service_map(daemons: DataFrame) -> DataFrame:
    return daemons.where(F.col("mach_services").isNotNull()).select("label", "mach_services", "sandbox_profile", "user_name").orderBy("label")


def service_owners(services: DataFrame, daemons: DataFrame, pattern: str | None = None) -> DataFrame:
    """service_name with label, user and sandbox profile of its daemon, by name; ``pattern`` is LIKE without regard to case."""
    joined = services.select("service_name", "daemon_id").join(daemons.select(F.col("id").alias("daemon_id"), "label", "user_name", "sandbox_profile"), "daemon_id")
    if pattern is not None:
        joined = joined.where(F.ilike(F.col("service_name"), F.lit(pattern)))
    return joined.select("service_name", "label", "user_name", "sandbox_profile").orderBy("service_name", "label")


def daemons_with(grants: DataFrame, binaries: DataFrame, daemons: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    """Daemons whose binary holds a key like ``pattern`` (LIKE without regard to case), with the grant's value where it has one."""
    held = grants.where(F.ilike(F.col(key), F.lit(pattern))).select("binary_id", key, *[c for c in grants.columns if c == "value"])
    return daemons.join(binaries.select(F.col("id").alias("binary_id"), "executable_name"), "binary_id").join(held, "binary_id")


def kernel_surface(kexts: DataFrame) -> DataFrame:
    return kexts.where(F.col("has_user_client") == 1)


def test_binaries(binaries: DataFrame, files: DataFrame) -> DataFrame:
    """Binaries that look like test or debug builds by path or bundle id."""
    joined = binaries.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    looks = [F.ilike(F.col(c), F.lit(p)) for c, p in (("path", "%/test%"), ("path", "%/debug%"), ("bundle_id", "%test%"), ("bundle_id", "%debug%"))]
    return joined.where(looks[0] | looks[1] | looks[2] | looks[3]).select("path", "bundle_id", "executable_name")


def escape_surface(daemons: DataFrame, grants: DataFrame, key: str = "key") -> DataFrame:
    """Unconfined daemons that offer services, with the keys their binaries hold, joined in order."""
    loose = daemons.where(blank(F.col("sandbox_profile")) & F.col("mach_services").isNotNull())
    held = loose.join(grants.select("binary_id", F.col(key).alias("_key")), "binary_id")
    return held.groupBy("id", "label", "program", "mach_services", "sandbox_profile", "user_name").agg(F.expr("listagg(_key, ', ') WITHIN GROUP (ORDER BY _key)").alias("privileged_entitlements"))


def observations_for(observations: DataFrame, table: str, entity_id: int) -> DataFrame:
    return observations.where((F.col("entity_table") == table) & (F.col("entity_id") == entity_id)).orderBy("observed_at")


def pattern_of_life(observations: DataFrame, table: str, entity_id: int, start: str, end: str) -> DataFrame:
    """Observations of one entity within a window of time texts, both ends included."""
    return observations_for(observations, table, entity_id).where(F.col("observed_at").between(start, end))


def first_seen(observations: DataFrame) -> DataFrame:
    """The earliest observation of every entity; ties go to the smallest id."""
    best = F.min(F.struct("observed_at", "id", "event_type")).alias("b")
    return observations.groupBy("entity_table", "entity_id").agg(best).select("entity_table", "entity_id", F.col("b.observed_at").alias("observed_at"), F.col("b.id").alias("id"), F.col("b.event_type").alias("event_type"))


def cross_graph(entities: DataFrame, observations: DataFrame, table: str, event_type: str | None = None, entity_id: str = "id") -> DataFrame:
    """Entities of a table with their observations, by time."""
    own = observations.where(F.col("entity_table") == table)
    if event_type is not None:
        own = own.where(F.col("event_type") == event_type)
    return entities.join(own.withColumnRenamed("id", "observation_id"), F.col(entity_id) == F.col("entity_id")).orderBy("observed_at")


def new_observations(observations: DataFrame, v1: Column, v2: Column) -> DataFrame:
    """Observations of version two that version one has no like of."""
    keys = ["entity_table", "entity_id", "event_type", "observed_at"]
    return observations.where(v2).join(observations.where(v1).select(*keys).distinct(), keys, "left_anti").orderBy("entity_table", "entity_id")


def stats(tables: Mapping[str, DataFrame], names: tuple[str, ...] = COUNTED) -> DataFrame:
    """table_name and rows per table; a missing table counts 0."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "table_name string, rows long")
    for name in names:
        counted = tables[name].agg(F.count("*").alias("rows")) if name in tables else spark.range(1).select(F.lit(0).cast("long").alias("rows"))
        out = out.unionByName(counted.select(F.lit(name).alias("table_name"), "rows"))
    return out


def largest(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.desc("size"), "id").limit(n)


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def cross_source_bags(bags: DataFrame, bag_atoms: DataFrame, atoms: DataFrame) -> DataFrame:
    """Bags whose atoms come from two or more versions, best score first."""
    spread = bag_atoms.join(atoms.select(F.col("id").alias("atom_id"), "source_version_id"), "atom_id").groupBy("bag_id").agg(F.count_distinct("source_version_id").alias("sources"), F.count("*").alias("atoms"))
    wide = spread.where("sources >= 2")
    return bags.join(wide, bags["id"] == wide["bag_id"]).drop("bag_id").orderBy(F.desc("score"), "id")


def canonical_counts(bag_atoms: DataFrame, atoms: DataFrame) -> DataFrame:
    """canonical, cross_source: bags in all, and those of two or more versions, in one aggregation."""
    spread = bag_atoms.join(atoms.select(F.col("id").alias("atom_id"), "source_version_id"), "atom_id").groupBy("bag_id").agg(F.count_distinct("source_version_id").alias("sources"))
    return spread.agg(F.count("*").alias("canonical"), F.coalesce(F.sum((F.col("sources") >= 2).cast("long")), F.lit(0)).alias("cross_source"))


def merge_audit(candidates: DataFrame, n: int) -> DataFrame:
    """The best-scored candidate pairs."""
    return candidates.where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(n)


class EntityQuery:
    """Read-only engine over the tables of a workspace."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], sanitization: str = "unknown", allow_unverified: bool = False) -> None:
        if sanitization == "failed" and not allow_unverified:
            raise PermissionError("sanitization of this workspace failed; reading it needs an explicit override")
        self.spark, self.tables = spark, dict(tables)
        for name, frame in self.tables.items():
            frame.createOrReplaceTempView(valid_identifier(name))

    def execute(self, sql: str, params: list | dict | None = None) -> QueryResult:
        guard_reading(self.spark, sql)
        return QueryResult(self.spark.sql(sql, args=params) if params is not None else self.spark.sql(sql), "sql")

    def search(self, query: str, table: str = "files") -> QueryResult:
        if table not in SEARCHABLE:
            raise ValueError(f"can't search table {table!r}")
        return QueryResult(textsearch.search(self.tables[table], query, SEARCHABLE[table]), "search")

    def root_daemons(self) -> QueryResult:
        return QueryResult(root_daemons(self.tables["daemons"]).select("label", "program", "mach_services"), "root_daemons")

    def privileged_entitlements(self, keys: list[str] | None = None) -> QueryResult:
        grants = self.tables["entitlements"]
        if not keys:
            return QueryResult(top_holders(grants), "privileged_entitlements")
        binaries = self.tables["binaries"].select(F.col("id").alias("binary_id"), "bundle_id", "executable_name", "file_id")
        files = self.tables["files"].select(F.col("id").alias("file_id"), "path")
        held = grants_of(grants.select("binary_id", "key", "value"), binaries, files, keys, "binary_id", "file_id")
        return QueryResult(held.select("key", "value", "bundle_id", "path").orderBy("key", "bundle_id"), "privileged_entitlements")

    def service_map(self) -> QueryResult:
        return QueryResult(service_map(self.tables["daemons"]), "service_map")

    def mach_service_owners(self, pattern: str | None = None) -> QueryResult:
        return QueryResult(service_owners(self.tables["mach_services"], self.tables["daemons"], pattern), "mach_service_owners")

    def daemons_with_entitlement(self, pattern: str) -> QueryResult:
        found = daemons_with(self.tables["entitlements"], self.tables["binaries"], self.tables["daemons"], pattern)
        return QueryResult(found.select("label", "key", "value", "sandbox_profile", "user_name").orderBy("label", "key"), "daemons_with_entitlement")

    def kernel_surface(self) -> QueryResult:
        return QueryResult(kernel_surface(self.tables["kexts"]), "kernel_surface")

    def test_binaries(self) -> QueryResult:
        return QueryResult(test_binaries(self.tables["binaries"], self.tables["files"]), "test_binaries")

    def escape_surface(self) -> QueryResult:
        return QueryResult(escape_surface(self.tables["daemons"], self.tables["entitlements"]), "escape_surface")

    def observations_for(self, table: str, entity_id: int) -> QueryResult:
        return QueryResult(observations_for(self.tables["observations"], valid_identifier(table, ENTITY_TABLES), entity_id), "observations_for")

    def pattern_of_life(self, table: str, entity_id: int, start: str, end: str) -> QueryResult:
        return QueryResult(pattern_of_life(self.tables["observations"], valid_identifier(table, ENTITY_TABLES), entity_id, start, end), "pattern_of_life")

    def first_seen(self, table: str, entity_id: int) -> QueryResult:
        own = self.tables["observations"].where((F.col("entity_table") == valid_identifier(table, ENTITY_TABLES)) & (F.col("entity_id") == entity_id))
        return QueryResult(own.orderBy("observed_at", "id").limit(1), "first_seen")

    def cross_graph_query(self, table: str, event_type: str | None = None) -> QueryResult:
        valid_identifier(table, ENTITY_TABLES)
        return QueryResult(cross_graph(self.tables[table], self.tables["observations"], table, event_type), "cross_graph_query")

    def observation_diff(self, v1: int, v2: int) -> QueryResult:
        return QueryResult(new_observations(self.tables["observations"], F.col("version_id") == v1, F.col("version_id") == v2), "observation_diff")

    def stats(self) -> dict[str, int]:
        return {r["table_name"]: r["rows"] for r in stats(self.tables).collect()}


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")
