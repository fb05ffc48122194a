"""Version-diff queries over all consecutive snapshots: D01-D18, K06."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.markdown import sanitize_column
from lodeworks.functions.text import hash_value
from lodeworks.operators import diff
from lodeworks.operators.snapshot_changes import snapshot_sequence
from lodeworks.session import cut_lineage, discard, table

FILE_COLUMNS = ("path", "filename", "size", "sha256", "file_type", "id")
DAEMON_COLUMNS = ("label", "program", "plist_path", "user_name", "group_name", "session_type", "sandbox_profile", "run_at_load", "id", "binary_id", "observed_time")


def sides(spark: SparkSession, sf: str, name: str, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(old, new) rows of every consecutive pair of snapshots, the pair named by its new version."""
    runs = snapshot_sequence(table(spark, sf, "versions")).where(F.col("prev_id").isNotNull())
    rows = table(spark, sf, name).select("source_version_id", *columns)
    if "sha256" in columns:
        rows = rows.withColumn("sha256", hash_value(F.col("sha256")))
    old = rows.join(runs.select(F.col("version_id").alias("pair_id"), F.col("prev_id").alias("source_version_id")), "source_version_id")
    new = rows.join(runs.select(F.col("version_id").alias("pair_id"), F.col("version_id").alias("source_version_id")), "source_version_id")
    return old.drop("source_version_id"), new.drop("source_version_id")


def d01_added(spark, sf):
    old, new = sides(spark, sf, "files", FILE_COLUMNS)
    return diff.added_entities(old, new, ["pair_id", "path"]).select("pair_id", "path", "id")


def d02_removed(spark, sf):
    old, new = sides(spark, sf, "files", FILE_COLUMNS)
    return diff.removed_entities(old, new, ["pair_id", "path"]).select("pair_id", "path", "id")


def d03_changed(spark, sf):
    old, new = sides(spark, sf, "files", FILE_COLUMNS)
    keep = [F.col("id")]
    old, new = (diff.first_wins(x, ["pair_id", "path"], keep) for x in (old, new))
    return diff.changed_entities(old, new, ["pair_id", "path"], "size")


def d04_new_grants(spark, sf):
    old, new = sides(spark, sf, "daemons", DAEMON_COLUMNS)
    keys = ["pair_id", "sandbox_profile", "user_name", "session_type"]
    return diff.added_entities(old, new, keys).select(*keys, "id")


def d05_dangerous_grants(spark, sf):
    old, new = sides(spark, sf, "daemons", DAEMON_COLUMNS)
    return diff.dangerous_grants(old, new, "sandbox_profile", "user_name", ["root", "daemon"], ["pair_id"]).select("pair_id", "sandbox_profile", "user_name", "id")


def d06_moved_binaries(spark, sf):
    old, new = (x.where(F.col("file_type").isin("macho", "elf", "pe")) for x in sides(spark, sf, "files", FILE_COLUMNS))
    return diff.structural_diff(old, new, ["pair_id", "filename"], F.col("path"))


def d07_reassigned_rules(spark, sf):
    old, new = sides(spark, sf, "daemons", DAEMON_COLUMNS)
    return diff.structural_diff(old, new, ["pair_id", "program", "session_type"], F.col("sandbox_profile"))


def d08_reassigned_grants(spark, sf):
    old, new = sides(spark, sf, "daemons", DAEMON_COLUMNS)
    owner = F.coalesce(F.col("sandbox_profile"), F.col("user_name"), F.concat(F.lit("path:"), F.col("plist_path")))
    return diff.structural_diff(old, new, ["pair_id", "plist_path", "program"], owner)


def _observed(rows: DataFrame) -> DataFrame:
    """Daemon rows as observations about the binary they run, if any, else about an unknown table."""
    return rows.select("pair_id", F.when(F.col("binary_id").isNotNull(), "binaries").otherwise("loose").alias("entity_table"), F.coalesce("binary_id", "id").alias("entity_id"), F.col("session_type").alias("event_type"), F.col("observed_time").alias("observed_at"))


def d09_observation_diff(spark, sf):
    old, new = (_observed(x) for x in sides(spark, sf, "daemons", DAEMON_COLUMNS))
    subjects = [diff.Subject("binaries", table(spark, sf, "binaries"), "id", "executable_name")]
    old, new = (diff.keyed_observations(x, subjects, ("pair_id",)) for x in (old, new))
    return diff.observation_diff(old, new, ("pair_id",))


def d10_files_changed(spark, sf):
    old, new = sides(spark, sf, "files", FILE_COLUMNS)
    old, new = (diff.first_wins(x, ["pair_id", "path"], [F.col("id")]) for x in (old, new))
    return diff.files_changed(old, new, ["pair_id", "path"])


def d11_binaries_diff(spark, sf):
    old, new = (x.where(F.col("file_type").isin("macho", "elf", "pe")) for x in sides(spark, sf, "files", FILE_COLUMNS))
    return diff.natural_diff(old, new, ["pair_id", "path"])


def d12_entitlements_diff(spark, sf):
    return diff.natural_diff(*sides(spark, sf, "daemons", DAEMON_COLUMNS), ["pair_id", "program", "user_name", "group_name"])


def d13_rules_diff(spark, sf):
    return diff.natural_diff(*sides(spark, sf, "daemons", DAEMON_COLUMNS), ["pair_id", "sandbox_profile", "user_name", "group_name", "session_type", "run_at_load"])


def d14_services_diff(spark, sf):
    return diff.natural_diff(*sides(spark, sf, "daemons", DAEMON_COLUMNS), ["pair_id", "label", "program"])


def _bags(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pair_id", F.col("file_type").alias("entity_type"), F.lower("filename").alias("canonical_key")).agg(F.min("id").alias("id"), F.count("*").alias("atom_count"), F.max("size").cast("double").alias("score"))


def d15_resolution_diff(spark, sf):
    old, new = (_bags(x.where(F.col("file_type").isNotNull())) for x in sides(spark, sf, "files", FILE_COLUMNS))
    return diff.resolution_diff(old, new, ["pair_id"])


def d18_diff_summary(spark, sf):
    old, new = sides(spark, sf, "files", FILE_COLUMNS)
    d_old, d_new = sides(spark, sf, "daemons", DAEMON_COLUMNS)
    files = [diff.first_wins(x, ["pair_id", "path"], [F.col("id")]) for x in (old, new)]
    daemons = [diff.first_wins(x, ["pair_id", "label"], [F.col("id")]) for x in (d_old, d_new)]
    return diff.Differ({"files": files[0], "daemons": daemons[0]}, {"files": files[1], "daemons": daemons[1]}, ("pair_id",)).summary()


#: Added to every id of the newer side, so that no id means the same on both.
SHIFT = 1_000_000_000_000


def workspaces(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Two workspaces per pair of snapshots, made of files and daemons, with unrelated ids.

    Programs are binaries of their files, profiles and rules come from the daemons' profiles,
    services and grants from their programs, observations are the daemons' sessions, bags
    are files of one name.
    """
    out = []
    for shift, files, daemons in zip((0, SHIFT), sides(spark, sf, "files", FILE_COLUMNS), sides(spark, sf, "daemons", DAEMON_COLUMNS)):
        f = cut_lineage(diff.first_wins(files, ["pair_id", "path"], [F.col("id")]).withColumn("id", F.col("id") + shift))
        d = cut_lineage(diff.first_wins(daemons, ["pair_id", "label"], [F.col("id")]).withColumn("id", F.col("id") + shift))
        binaries = f.where(F.col("file_type").isin("macho", "elf", "pe")).select("pair_id", (F.col("id") * 2 + 1).alias("id"), F.col("id").alias("file_id"), F.lit(None).cast("string").alias("bundle_id"), F.col("filename").alias("executable_name"))
        profiles = d.where("sandbox_profile IS NOT NULL").groupBy("pair_id", F.col("sandbox_profile").alias("name")).agg(F.min("id").alias("id"))
        rules = d.where("sandbox_profile IS NOT NULL").join(profiles.select("pair_id", F.col("name").alias("sandbox_profile"), F.col("id").alias("profile_id")), ["pair_id", "sandbox_profile"])
        programs = f.join(binaries.select("pair_id", F.col("file_id").alias("id"), F.col("id").alias("binary_id")), ["pair_id", "id"]).select("pair_id", F.col("path").alias("program"), "binary_id")
        out.append({
            "files": f,
            "daemons": d,
            "binaries": binaries,
            "sandbox_profiles": profiles,
            "sandbox_rules": rules.select("pair_id", "profile_id", F.col("label").alias("operation"), F.col("user_name").alias("action"), F.col("group_name").alias("filter_type"), F.col("session_type").alias("filter_value")),
            "mach_services": d.select("pair_id", F.col("id").alias("daemon_id"), F.col("program").alias("service_name")),
            "entitlements": d.drop("binary_id").join(programs, ["pair_id", "program"]).select("pair_id", "binary_id", F.col("label").alias("key"), F.col("user_name").alias("value")),
            "observations": d.select("pair_id", F.lit("daemons").alias("entity_table"), F.col("id").alias("entity_id"), F.col("session_type").alias("event_type"), F.col("plist_path").alias("observed_at")),
            "bags": _bags(f.where(F.col("file_type").isNotNull())),
        })
    return out[0], out[1]


def d16_full_diff(spark, sf):
    old, new = workspaces(spark, sf)
    changes = diff.Differ(old, new, ("pair_id",)).unified(staged=True)
    discard(*(side[name] for side in (old, new) for name in ("files", "daemons")))
    return changes


def k06_markdown_sanitize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sanitize_column(F.col("text")).alias("safe"))


QUERIES = {f.__name__: f for f in (d01_added, d02_removed, d03_changed, d04_new_grants, d05_dangerous_grants, d06_moved_binaries, d07_reassigned_rules, d08_reassigned_grants, d09_observation_diff, d10_files_changed, d11_binaries_diff, d12_entitlements_diff, d13_rules_diff, d14_services_diff, d15_resolution_diff, d16_full_diff, d18_diff_summary, k06_markdown_sanitize)}

_RUNS = """
runs AS (SELECT id AS n, lag(id) OVER (PARTITION BY source_path ORDER BY started_at, id) AS o FROM versions
         WHERE completed_at IS NOT NULL AND trim(completed_at) <> '' AND source_path IS NOT NULL AND started_at IS NOT NULL),
pairs AS (SELECT n, o FROM runs WHERE o IS NOT NULL),
f AS (SELECT * REPLACE (nullif(regexp_replace(lower(trim(sha256)), '^sha256:', ''), '') AS sha256) FROM files),
fo AS (SELECT p.n AS pair_id, f.* FROM f JOIN pairs p ON f.source_version_id = p.o),
fn AS (SELECT p.n AS pair_id, f.* FROM f JOIN pairs p ON f.source_version_id = p.n),
dold AS (SELECT p.n AS pair_id, d.* FROM daemons d JOIN pairs p ON d.source_version_id = p.o),
dnew AS (SELECT p.n AS pair_id, d.* FROM daemons d JOIN pairs p ON d.source_version_id = p.n),
fo1 AS (SELECT * FROM fo QUALIFY row_number() OVER (PARTITION BY pair_id, path ORDER BY id) = 1),
fn1 AS (SELECT * FROM fn QUALIFY row_number() OVER (PARTITION BY pair_id, path ORDER BY id) = 1)
"""


def _anti(side: str, other: str, keys: list[str], out: str, plain: tuple[str, ...] = (), where: str = "true") -> str:
    test = " AND ".join(f"x.{k} = y.{k}" if k in plain else f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in keys)
    return f"SELECT {out} FROM {side} x WHERE {where} AND NOT EXISTS (SELECT 1 FROM {other} y WHERE {test})"


def _natural(old: str, new: str, keys: list[str], where: str = "true") -> str:
    cols = ", ".join("x." + k for k in keys)
    return f"WITH {_RUNS} {_anti(new, old, keys, 'CAST(' + chr(39) + 'added' + chr(39) + ' AS VARCHAR) AS side, ' + cols, where=where)} UNION ALL {_anti(old, new, keys, chr(39) + 'removed' + chr(39) + ', ' + cols, where=where)}"


def _moved(old: str, new: str, keys: list[str], value: str, where: str = "true") -> str:
    cols = ", ".join(keys)
    test = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys)
    return f"""WITH {_RUNS},
b AS (SELECT {cols}, any_value({value}) AS v, count({value}) AS c FROM {old} WHERE {where} GROUP BY {cols} HAVING count(*) = 1),
a AS (SELECT {cols}, any_value({value}) AS v, count({value}) AS c FROM {new} WHERE {where} GROUP BY {cols} HAVING count(*) = 1)
SELECT {', '.join('a.' + k for k in keys)}, b.v AS old_value, a.v AS new_value FROM a JOIN b ON {test} WHERE a.v IS DISTINCT FROM b.v"""


_PROGRAM = "x.file_type IN ('macho','elf','pe')"
_OBS = """
obs AS (
  SELECT side, pair_id, CASE WHEN d.binary_id IS NOT NULL THEN 'binaries' ELSE 'loose' END AS entity_table, d.binary_id IS NOT NULL AND b.id IS NOT NULL AS resolved,
         CASE WHEN b.id IS NOT NULL THEN b.executable_name ELSE 'id:' || CAST(coalesce(d.binary_id, d.id) AS VARCHAR) END AS natural_key,
         d.session_type AS event_type, d.observed_time AS observed_at
  FROM (SELECT 'added' AS side, * FROM dnew UNION ALL SELECT 'removed', * FROM dold) d LEFT JOIN binaries b ON b.id = d.binary_id
  WHERE b.id IS NULL OR b.executable_name IS NOT NULL)
"""


def _spaces() -> str:
    """The workspaces of d16 side by side (o, n) and the changes of all comparisons, without ids of any kind in the comparisons."""
    parts = []
    for x, f, d in (("o", "fo1", "dold"), ("n", "fn1", "dnew")):
        parts += [
            f"wf{x} AS (SELECT * FROM {f})",
            f"wd{x} AS (SELECT * FROM {d} QUALIFY row_number() OVER (PARTITION BY pair_id, label ORDER BY id) = 1)",
            f"wb{x} AS (SELECT pair_id, path AS owner, CAST(NULL AS VARCHAR) AS bundle_id, filename AS executable_name FROM wf{x} WHERE file_type IN ('macho','elf','pe'))",
            f"wr{x} AS (SELECT pair_id, sandbox_profile AS owner, label AS operation, user_name AS action, group_name AS filter_type, session_type AS filter_value FROM wd{x} WHERE sandbox_profile IS NOT NULL)",
            f"ws{x} AS (SELECT pair_id, label AS owner, program AS service_name FROM wd{x})",
            f"wp{x} AS (SELECT DISTINCT pair_id, sandbox_profile AS name FROM wd{x} WHERE sandbox_profile IS NOT NULL)",
            f"we{x} AS (SELECT d.pair_id, b.bundle_id AS owner, d.label AS key, d.user_name AS value, coalesce(b.executable_name, 'path:' || b.owner) AS held FROM wd{x} d JOIN wb{x} b ON b.pair_id = d.pair_id AND b.owner = d.program)",
            f"wv{x} AS (SELECT DISTINCT pair_id, label AS natural_key, session_type AS event_type, plist_path AS observed_at FROM wd{x} WHERE label IS NOT NULL)",
            f"wg{x} AS (SELECT pair_id, file_type AS entity_type, lower(filename) AS canonical_key, count(*) AS c, max(CAST(size AS DOUBLE)) AS s FROM wf{x} WHERE file_type IS NOT NULL AND filename IS NOT NULL GROUP BY ALL)",
        ]

    def key(*columns: str, of: str = "x") -> str:
        return "concat_ws('|', " + ", ".join(f"coalesce(CAST({of}.{c} AS VARCHAR), '')" for c in ("pair_id", *columns)) + ")"

    def row(result: str, category: str, k: str, old: str = "NULL", new: str = "NULL", rest: str = "") -> str:
        return f"SELECT '{result}' AS result, '{category}' AS category, {k} AS key, CAST({old} AS VARCHAR) AS old_value, CAST({new} AS VARCHAR) AS new_value FROM {rest}"

    rows = []
    for name, letter, keys in (("files", "f", ("path",)), ("daemons", "d", ("label",)), ("sandbox_profiles", "p", ("name",)), ("binaries", "b", ("owner", "bundle_id", "executable_name")), ("entitlements", "e", ("owner", "key", "value")), ("sandbox_rules", "r", ("owner", "operation", "action", "filter_type", "filter_value")), ("mach_services", "s", ("owner", "service_name")), ("observations", "v", ("natural_key", "event_type", "observed_at"))):
        test = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in ("pair_id", *keys))
        shown = key(*keys).replace("'|', coalesce(CAST(x.pair_id AS VARCHAR), ''), ", "'|', coalesce(CAST(x.pair_id AS VARCHAR), ''), 'daemons', ") if name == "observations" else key(*keys)
        for suffix, category, mine, other in (("_added", "addition", "n", "o"), ("_removed", "deletion", "o", "n")):
            rows.append(row(name + (suffix if letter in "fdp" else ""), category, shown, rest=f"w{letter}{mine} x WHERE NOT EXISTS (SELECT 1 FROM w{letter}{other} y WHERE {test})"))
    changed = "CASE WHEN x.sha256 IS NOT NULL AND y.sha256 IS NOT NULL THEN x.sha256 <> y.sha256 ELSE x.size IS DISTINCT FROM y.size END"
    rows.append(row("files_changed", "property_change", key("path"), new="CASE WHEN x.sha256 IS NOT NULL AND y.sha256 IS NOT NULL THEN 'sha256' ELSE 'size' END", rest=f"wfn x JOIN wfo y ON x.pair_id = y.pair_id AND x.path IS NOT DISTINCT FROM y.path WHERE {changed}"))
    for kind, table, keys, owner, entity in (("binary_file_moved", "b", ("executable_name",), "owner", "x.executable_name"), ("sandbox_rule_reassigned", "r", ("operation", "action"), "owner", "x.operation || ':' || x.action"), ("entitlement_reassigned", "e", ("key", "value"), "held", "x.key")):
        once = lambda s: f"(SELECT pair_id, {', '.join(keys)}, any_value({owner}) AS w FROM w{table}{s} WHERE {' AND '.join(k + ' IS NOT NULL' for k in keys)} GROUP BY pair_id, {', '.join(keys)} HAVING count(*) = 1)"  # noqa: B023,E731
        rows.append(row("structural", "structural", f"x.pair_id || '|{kind}|' || {entity}", "x.w", "y.w", f"{once('o')} x JOIN {once('n')} y USING (pair_id, {', '.join(keys)}) WHERE x.w IS DISTINCT FROM y.w"))
    told = lambda a: f"concat_ws('|', CAST({a}.c AS VARCHAR), CAST(CAST({a}.s AS DECIMAL(38,6)) AS VARCHAR))"
    whole = "coalesce(x.pair_id, y.pair_id) || '|' || coalesce(x.entity_type, y.entity_type) || '|' || coalesce(x.canonical_key, y.canonical_key)"
    rows.append(row("resolution", "resolution", whole, told("x"), told("y"), "wgo x FULL OUTER JOIN wgn y ON x.pair_id = y.pair_id AND x.entity_type = y.entity_type AND x.canonical_key = y.canonical_key WHERE x.c IS DISTINCT FROM y.c OR x.s IS DISTINCT FROM y.s"))
    once = lambda s: f"(SELECT pair_id, sha256, any_value(path) AS w FROM wf{s} WHERE sha256 IS NOT NULL GROUP BY pair_id, sha256 HAVING count(*) = 1)"
    rows.append(row("files_moved", "structural", "x.pair_id || '|' || x.sha256", "x.w", "y.w", f"{once('o')} x JOIN {once('n')} y USING (pair_id, sha256) WHERE x.w IS DISTINCT FROM y.w"))
    return ", ".join(parts) + ", u AS (" + " UNION ALL ".join(rows) + ")"


_SPACES = _spaces()

ORACLE = {
    "d01_added": f"WITH {_RUNS} " + _anti("fn", "fo", ["pair_id", "path"], "x.pair_id, x.path, x.id"),
    "d02_removed": f"WITH {_RUNS} " + _anti("fo", "fn", ["pair_id", "path"], "x.pair_id, x.path, x.id"),
    "d03_changed": f"WITH {_RUNS} SELECT n.pair_id, n.path, o.size AS old_value, n.size AS new_value FROM fn1 n JOIN fo1 o ON n.pair_id = o.pair_id AND n.path IS NOT DISTINCT FROM o.path WHERE o.size IS DISTINCT FROM n.size",
    "d04_new_grants": f"WITH {_RUNS} " + _anti("dnew", "dold", ["pair_id", "sandbox_profile", "user_name", "session_type"], "x.pair_id, x.sandbox_profile, x.user_name, x.session_type, x.id"),
    "d05_dangerous_grants": f"WITH {_RUNS} " + _anti("dnew", "dold", ["pair_id", "sandbox_profile", "user_name"], "x.pair_id, x.sandbox_profile, x.user_name, x.id", plain=("sandbox_profile",), where="x.user_name IN ('root','daemon')"),
    "d06_moved_binaries": _moved("fo", "fn", ["pair_id", "filename"], "path", "file_type IN ('macho','elf','pe')"),
    "d07_reassigned_rules": _moved("dold", "dnew", ["pair_id", "program", "session_type"], "sandbox_profile"),
    "d08_reassigned_grants": _moved("dold", "dnew", ["pair_id", "plist_path", "program"], "coalesce(sandbox_profile, user_name, 'path:' || plist_path)"),
    "d09_observation_diff": f"""WITH {_RUNS}, {_OBS}
SELECT DISTINCT side, pair_id, entity_table, natural_key, event_type, observed_at FROM obs x
WHERE NOT resolved OR NOT EXISTS (SELECT 1 FROM obs y WHERE y.resolved AND y.side <> x.side AND y.pair_id = x.pair_id AND y.entity_table = x.entity_table AND y.natural_key = x.natural_key
  AND y.event_type IS NOT DISTINCT FROM x.event_type AND y.observed_at IS NOT DISTINCT FROM x.observed_at)""",
    "d10_files_changed": f"""WITH {_RUNS} SELECT n.pair_id, n.path,
CASE WHEN n.sha256 IS NOT NULL AND o.sha256 IS NOT NULL THEN 'sha256' ELSE 'size' END AS change_basis,
CASE WHEN n.sha256 IS NOT NULL AND o.sha256 IS NOT NULL THEN 0 ELSE 1 END AS content_unknown
FROM fn1 n JOIN fo1 o ON n.pair_id = o.pair_id AND n.path IS NOT DISTINCT FROM o.path
WHERE CASE WHEN n.sha256 IS NOT NULL AND o.sha256 IS NOT NULL THEN n.sha256 <> o.sha256 ELSE n.size IS DISTINCT FROM o.size END""",
    "d11_binaries_diff": _natural("(SELECT * FROM fo x WHERE " + _PROGRAM + ")", "(SELECT * FROM fn x WHERE " + _PROGRAM + ")", ["pair_id", "path"]),
    "d12_entitlements_diff": _natural("dold", "dnew", ["pair_id", "program", "user_name", "group_name"]),
    "d13_rules_diff": _natural("dold", "dnew", ["pair_id", "sandbox_profile", "user_name", "group_name", "session_type", "run_at_load"]),
    "d14_services_diff": _natural("dold", "dnew", ["pair_id", "label", "program"]),
    "d15_resolution_diff": f"""WITH {_RUNS},
o AS (SELECT pair_id, file_type AS entity_type, lower(filename) AS canonical_key, count(*) AS c, max(CAST(size AS DOUBLE)) AS s FROM fo WHERE file_type IS NOT NULL AND filename IS NOT NULL GROUP BY ALL),
n AS (SELECT pair_id, file_type AS entity_type, lower(filename) AS canonical_key, count(*) AS c, max(CAST(size AS DOUBLE)) AS s FROM fn WHERE file_type IS NOT NULL AND filename IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' ELSE 'changed' END AS kind, pair_id, entity_type, canonical_key, o.c AS old_count, n.c AS new_count, o.s AS old_score, n.s AS new_score
FROM o FULL OUTER JOIN n USING (pair_id, entity_type, canonical_key) WHERE o.c IS DISTINCT FROM n.c OR o.s IS DISTINCT FROM n.s""",
    "d16_full_diff": f"WITH {_RUNS}, {_SPACES} SELECT result, category, key, old_value, new_value FROM u",
    "d18_diff_summary": f"WITH {_RUNS}, {_SPACES} SELECT result, category, count(*) AS changes FROM u WHERE result LIKE 'files%' OR result LIKE 'daemons%' GROUP BY ALL",
    "k06_markdown_sanitize": "SELECT doc_id, " + "".join(["replace(" for _ in range(68)]) + "coalesce(text, '?'), '\\', '\\\\'), '`', '\\x60'), '|', '\\|')" + "".join(f", chr({c}), '\\x{c:02x}')" for c in [*range(1, 32), *range(127, 160)]) + ", chr(0), '\\x00') AS safe FROM documents",
}
