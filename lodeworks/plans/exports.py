"""Sanitizer, STIX, JSON, hash, entropy, provenance and detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.operators import sanitize, stix
from lodeworks.plans.diffs import _RUNS, _SPACES
from lodeworks.schema import DDL
from lodeworks.session import table
from lodeworks.sources import columns as source_columns
from lodeworks.sources import registry

NOW = "2026-02-01T00:00:00Z"

def h02_column_scope(spark, sf):
    rows = [(t, c, n) for t, c in (("files", "path"), ("observations", "properties"), ("versions", "metadata"), ("daemons", "label"), ("documents", "text")) for n in sanitize.patterns_for(t, c)]
    return spark.createDataFrame(rows, "table_name string, column_name string, pattern string")


def h03_redact_files(spark, sf):
    files = table(spark, sf, "files")
    return sanitize.redact(files, "files").select("id", *sanitize.text_columns(files))


def h03_redact_records(spark, sf):
    return table(spark, sf, "sample_records").select("raw_id", F.md5(sanitize.redact_column(F.col("body"), sanitize.patterns_for("sample_records", "body"))).alias("digest"))


def h04_scan_files(spark, sf):
    return sanitize.scan(table(spark, sf, "files"), "files")


def h04_fingerprints(spark, sf):
    return sanitize.fingerprints(table(spark, sf, "files").select("path"), "files", "path", b"fixture-key")


def h05_sanitize_daemons(spark, sf):
    clean, _ = sanitize.sanitize_output({"daemons": table(spark, sf, "daemons")})
    return clean["daemons"].select("id", *sanitize.text_columns(clean["daemons"]))


def x01_stix_ids(spark, sf):
    return table(spark, sf, "files").select("id", stix.object_id("file", F.lit("files"), F.col("id")).alias("stix_id"))


def x02_stix_files(spark, sf):
    return stix.files(table(spark, sf, "files"), NOW).select("id", "source_id", F.get_json_object("json", "$.name").alias("name"), F.get_json_object("json", "$.size").alias("size"), F.get_json_object("json", "$.hashes.SHA-256").alias("sha256"))


def x03_timestamps(spark, sf):
    return table(spark, sf, "daemons").select("id", stix.timestamp(F.col("observed_time"), NOW).alias("at"))


def x04_export(spark, sf):
    seen = table(spark, sf, "daemons").where("binary_id IS NOT NULL").select("id", F.lit("binaries").alias("entity_table"), F.col("binary_id").alias("entity_id"), F.col("observed_time").alias("observed_at"), F.col("session_type").alias("event_type"))
    tables = {"daemons": table(spark, sf, "daemons"), "binaries": table(spark, sf, "binaries"), "observations": seen}
    return stix.export(tables, NOW, ("daemons", "observations")).groupBy("type", "source_table").agg(F.count("*").alias("n"))


def x06_diff_notes(spark, sf):
    from lodeworks.plans.diffs import FILE_COLUMNS, sides

    from lodeworks.operators import diff

    one = [diff.first_wins(x, ["pair_id", "path"], [F.col("id")]) for x in sides(spark, sf, "files", FILE_COLUMNS)]
    unified = diff.Differ({"files": one[0]}, {"files": one[1]}, ("pair_id",)).unified()
    return stix.diff_notes(unified, NOW).groupBy("type").agg(F.count("*").alias("n"))


def s04_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", source_columns.content_hash(F.encode("text", "utf-8"), F.length(F.encode("text", "utf-8"))).alias("sha256"))


def s09_exec_start(spark, sf):
    unit = F.concat(F.lit("[Service]\nType=simple\n ExecStart = -@"), F.coalesce("program", F.lit("")), F.lit(" --flag\nRestart=no\n"))
    return table(spark, sf, "daemons").select("id", source_columns.exec_start(unit).alias("program"))


def s03_normal_path(spark, sf):
    return table(spark, sf, "files").select("id", source_columns.rooted_path(F.col("path")).alias("path"))


def s22_json_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", source_columns.json_keys(F.col("props")).alias("keys"))


def s22_json_property(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def s26_entropy(spark, sf):
    return source_columns.entropy(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("content"))).select("id", F.round("shannon_entropy", 4).alias("shannon_entropy"))


def s27_daemon_binary(spark, sf):
    files = table(spark, sf, "files").select("id", "path")
    programs = table(spark, sf, "files").where("file_type IN ('macho','elf','pe')").select(F.col("id").alias("id"), F.col("id").alias("file_id"))
    return source_columns.link_daemons(table(spark, sf, "daemons").select("id", "program", "binary_id"), programs, files)


def s20_event_dedup(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("observed_at"), "event_type")
    return source_columns.dedup_events(e, ["user_id", "observed_at", "event_type"], "event_id").select("event_id", "user_id", "observed_at", "event_type")


def s29_detect_contest(spark, sf):
    return registry.contest(spark.createDataFrame(registry.SPECIFICITY, "name string, specificity int, confidence double"))


def p04_provenance(spark, sf):
    runs = table(spark, sf, "versions").select(F.col("id").alias("source_version_id"), "started_at")
    stamped = table(spark, sf, "binaries").join(runs, "source_version_id", "left")
    return stamped.select("id", "source_version_id", F.coalesce("observed_time", "started_at").alias("observed_time"))


def p06_fk_check(spark, sf):
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "part", "supplier", "customer", "nation", "region", "daemons", "binaries", "versions", "files")}
    links = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("daemons", "binary_id", "binaries", "id"), ("daemons", "source_version_id", "versions", "id"), ("files", "source_version_id", "versions", "id"), ("binaries", "file_id", "files", "id")]
    return source_columns.foreign_key_violations(t, links)


QUERIES = {f.__name__: f for f in (h02_column_scope, h03_redact_files, h03_redact_records, h04_scan_files, h04_fingerprints, h05_sanitize_daemons, x01_stix_ids, x02_stix_files, x03_timestamps, x04_export, x06_diff_notes, s03_normal_path, s04_content_hash, s09_exec_start, s20_event_dedup, s22_json_keys, s22_json_property, s26_entropy, s27_daemon_binary, s29_detect_contest)}
# Names that begin with p and a digit belong to the training-data problems.
QUERIES |= {"pipeline_provenance": p04_provenance, "pipeline_fk_check": p06_fk_check}


def _q(text: str) -> str:
    return text.replace("'", "''")


def _redacted(column: str, names) -> str:
    out = column
    for n in names:
        out = f"regexp_replace({out}, '{_q(sanitize.PATTERNS[n])}', '{sanitize.MARK.format(n.upper())}', 'g')"
    return out


_FILE_TEXTS = [c for c, t in (x.split() for x in DDL["files"].split(", ")) if t == "string"]
_DAEMON_TEXTS = [c for c, t in (x.split() for x in DDL["daemons"].split(", ")) if t == "string"]
_NS = stix.NAMESPACE.hex
_U5 = "substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', CAST(('0x' || substr(h,17,1)) AS INT) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12)"
_FK = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("daemons", "binary_id", "binaries", "id"), ("daemons", "source_version_id", "versions", "id"), ("files", "source_version_id", "versions", "id"), ("binaries", "file_id", "files", "id")]

_KEY = b"fixture-key".ljust(64, b"\0")
_INNER, _OUTER = (bytes(x ^ y for x in _KEY).hex() for y in (0x36, 0x5C))

ORACLE = {
    "h04_fingerprints": f"SELECT DISTINCT pattern, substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(m)))), 1, 16) AS fingerprint FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern, unnest(regexp_extract_all(path, '{_q(sanitize.PATTERNS[n])}')) AS m FROM files" for n in sanitize.PATH_SAFE) + ") ORDER BY pattern, fingerprint LIMIT 100",
    "h02_column_scope": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{n}')" for t, c in (("files", "path"), ("observations", "properties"), ("versions", "metadata"), ("daemons", "label"), ("documents", "text")) for n in (sanitize.PATTERNS if (t, c) in sanitize.VALUE_COLUMNS or t == "documents" else sanitize.PATH_SAFE)) + ") t(table_name, column_name, pattern)",
    "h03_redact_files": "SELECT id, " + ", ".join(f"{_redacted(c, sanitize.PATH_SAFE)} AS {c}" for c in _FILE_TEXTS) + " FROM files",
    "h03_redact_records": f"SELECT raw_id, md5({_redacted('body', sanitize.PATTERNS)}) AS digest FROM sample_records",
    "h05_sanitize_daemons": "SELECT id, " + ", ".join(f"{_redacted(c, sanitize.PATH_SAFE)} AS {c}" for c in _DAEMON_TEXTS) + " FROM daemons",
    "h04_scan_files": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column, '{n}' AS pattern, CAST(coalesce(sum(len(regexp_extract_all({c}, '{_q(sanitize.PATTERNS[n])}'))), 0) AS BIGINT) AS findings FROM files" for c in _FILE_TEXTS for n in sanitize.PATH_SAFE) + ") WHERE findings > 0",
    "x06_diff_notes": f"WITH {_RUNS}, {_SPACES} SELECT 'software' AS type, 1::BIGINT AS n UNION ALL SELECT 'note', count(*) FROM (SELECT DISTINCT * FROM u WHERE result LIKE 'files%')",
    "x01_stix_ids": f"SELECT id, 'file--' || {_U5} AS stix_id FROM (SELECT id, sha1(unhex('{_NS}') || encode('file:[\"files\",' || CAST(id AS VARCHAR) || ']')) AS h FROM files)",
    "x02_stix_files": f"SELECT 'file--' || {_U5} AS id, id AS source_id, filename AS name, CASE WHEN size > 0 THEN CAST(size AS VARCHAR) END AS size, nullif(sha256, '') AS sha256 FROM (SELECT *, sha1(unhex('{_NS}') || encode('file:[\"files\",' || CAST(id AS VARCHAR) || ']')) AS h FROM files)",
    "x03_timestamps": f"SELECT id, CASE WHEN trim(coalesce(observed_time, '')) = '' THEN '{NOW}' ELSE strftime(CAST(replace(replace(observed_time, 'T', ' '), 'Z', '') AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') END AS at FROM daemons",
    "x04_export": "SELECT 'infrastructure' AS type, 'daemons' AS source_table, count(*) AS n FROM daemons UNION ALL SELECT 'file', 'binaries', count(DISTINCT binary_id) FROM daemons WHERE binary_id IS NOT NULL UNION ALL SELECT 'observed-data', 'observations', count(*) FROM daemons WHERE binary_id IS NOT NULL",
    "s03_normal_path": "SELECT id, '/' || ltrim(replace(path, '\\', '/'), '/') AS path FROM files",
    "s04_content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "s09_exec_start": "SELECT id, split_part(ltrim(ltrim('-@' || coalesce(program, '') || ' --flag', '-@+!:')), ' ', 1) AS program FROM daemons",
    "s20_event_dedup": "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H') AS observed_at, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d %H'), event_type ORDER BY event_id) = 1",
    "s22_json_keys": "SELECT event_id, CAST(to_json(list_sort(json_keys(props))[1:20]) AS VARCHAR) AS keys FROM events",
    "s22_json_property": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "s26_entropy": "WITH b AS (SELECT doc_id AS id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS v FROM documents WHERE text <> ''), c AS (SELECT id, v, count(*)::DOUBLE AS n FROM b GROUP BY ALL), t AS (SELECT id, sum(n) AS t FROM c GROUP BY id) SELECT d.doc_id AS id, e.h AS shannon_entropy FROM documents d LEFT JOIN (SELECT id, round(-sum(n / t * log2(n / t)), 4) + 0.0 AS h FROM c JOIN t USING (id) GROUP BY id) e ON e.id = d.doc_id",
    "s27_daemon_binary": "WITH p AS (SELECT path, min(id) AS b FROM files WHERE file_type IN ('macho','elf','pe') GROUP BY path) SELECT d.id, d.program, coalesce(d.binary_id, CASE WHEN d.program <> '' THEN p.b END) AS binary_id FROM daemons d LEFT JOIN p ON p.path = d.program",
    "s29_detect_contest": "SELECT 'cloud_aws_cloudtrail' AS name, 5 AS specificity, 0.95::DOUBLE AS confidence",
    "pipeline_provenance": "SELECT b.id, b.source_version_id, coalesce(b.observed_time, v.started_at) AS observed_time FROM binaries b LEFT JOIN versions v ON v.id = b.source_version_id",
    "pipeline_fk_check": " UNION ALL ".join(f"SELECT '{c}' AS child, '{k}' AS child_key, '{p}' AS parent, count(*) AS violations FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})" for c, k, p, pk in _FK),
}
