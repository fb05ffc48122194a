"""Core queries of the training-data problems: p1, p2, p5 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.text import canonical_label, canonical_path, hash_value
from lodeworks.operators import nested, packed, snapshot_changes, timestamps
from lodeworks.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    sequence = snapshot_changes.snapshot_sequence(table(spark, sf, "versions"))
    files = table(spark, sf, "files").select(F.col("source_version_id").alias("version_id"), canonical_path(F.col("path")).alias("natural_key"), hash_value(F.col("sha256")).alias("digest"), "size")
    daemons = table(spark, sf, "daemons").select(F.col("source_version_id").alias("version_id"), canonical_label(F.col("label")).alias("natural_key"))
    parts = [snapshot_changes.snapshot_changes(s, sequence).withColumn("entity_table", F.lit(name)) for name, s in (("files", files), ("daemons", daemons))]
    return parts[0].unionByName(parts[1]).select("entity_table", "natural_key", "old_version_id", "new_version_id", "change_kind")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.array_items(table(spark, sf, "sample_records"))


#: What is known of the tables: every true instant lies in these years.
TRUE_SPAN = timestamps.span("2023-01-01", "2027-01-01")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    files = timestamps.file_instants(table(spark, sf, "files"), table(spark, sf, "versions"), true_span=TRUE_SPAN)
    return files.unionByName(timestamps.record_instants(table(spark, sf, "sample_records"), true_span=TRUE_SPAN))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    daemons = packed.unpack(table(spark, sf, "daemons"), "daemons", ("mach_services", "program_arguments"))
    return daemons.unionByName(packed.unpack(table(spark, sf, "binaries"), "binaries", ("linked_dylibs", "rpaths"), colon_fields=("rpaths",)))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p6_found": p6_found}

_P1 = r"""
WITH runs AS (
  SELECT id, source_path, started_at, lead(id) OVER (PARTITION BY source_path ORDER BY started_at, id) AS next_id
  FROM versions WHERE completed_at IS NOT NULL AND trim(completed_at) <> '' AND source_path IS NOT NULL AND started_at IS NOT NULL
), states AS (
  SELECT source_version_id AS v, 'files' AS entity_table,
         nfc_normalize(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g')) AS k,
         max(nullif(regexp_replace(lower(trim(sha256)), '^sha256:', ''), '')) AS h, max(size) AS z
  FROM files WHERE path IS NOT NULL AND path <> '' GROUP BY ALL
  UNION ALL
  SELECT DISTINCT source_version_id, 'daemons', nfc_normalize(regexp_replace(label, '^\s+|\s+$', '', 'g')), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)
  FROM daemons WHERE label IS NOT NULL AND trim(label) <> ''
), pairs AS (SELECT id AS o, next_id AS n FROM runs WHERE next_id IS NOT NULL)
SELECT n.entity_table, n.k AS natural_key, p.o AS old_version_id, p.n AS new_version_id, 'added' AS change_kind
FROM pairs p JOIN states n ON n.v = p.n
WHERE NOT EXISTS (SELECT 1 FROM states x WHERE x.v = p.o AND x.entity_table = n.entity_table AND x.k = n.k)
UNION ALL
SELECT o.entity_table, o.k, p.o, p.n, 'removed' FROM pairs p JOIN states o ON o.v = p.o
WHERE NOT EXISTS (SELECT 1 FROM states x WHERE x.v = p.n AND x.entity_table = o.entity_table AND x.k = o.k)
UNION ALL
SELECT o.entity_table, o.k, p.o, p.n, 'changed'
FROM pairs p JOIN states o ON o.v = p.o JOIN states n ON n.v = p.n AND n.entity_table = o.entity_table AND n.k = o.k
WHERE CASE WHEN o.h IS NOT NULL AND n.h IS NOT NULL THEN o.h <> n.h ELSE o.z IS DISTINCT FROM n.z END
"""

_NAMES = ("eventVersion", "userIdentity", "eventTime", "eventSource", "eventName", "requestParameters", "responseElements")
_IS_RECORD = "coalesce(" + ", ".join(f"json_type({{0}}, '$.{n}')" for n in _NAMES) + ") IS NOT NULL"
_BARE = "ltrim({0}, chr(65279) || ' ' || chr(9) || chr(10) || chr(13))"
#: Records out of their wrappings one step at a time (but for one record per line, which these tables don't have), then every array element of their sides.
_P2 = f"""
WITH RECURSIVE un AS (
  SELECT raw_id, CAST({_BARE.format("body")} AS JSON) AS j FROM sample_records WHERE json_valid({_BARE.format("body")})
  UNION ALL
  SELECT raw_id, n FROM (SELECT raw_id, CASE
      WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid({_BARE.format("(j->>'$')")}) THEN CAST({_BARE.format("(j->>'$')")} AS JSON) END
      WHEN json_type(j) <> 'OBJECT' THEN NULL
      WHEN json_type(j, '$.Records') IN ('ARRAY', 'VARCHAR') THEN j->'$.Records'
      WHEN {_IS_RECORD.format("j")} THEN NULL
      WHEN json_type(j, '$.detail') IS NOT NULL THEN j->'$.detail' END AS n FROM un) WHERE n IS NOT NULL
), elements AS (
  SELECT raw_id, unnest(CAST(j AS JSON[])) AS e, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS record_pos FROM un WHERE json_type(j) = 'ARRAY'
  UNION ALL
  SELECT raw_id, j, 0 FROM un WHERE json_type(j) = 'OBJECT' AND {_IS_RECORD.format("j")} AND coalesce(json_type(j, '$.Records'), '') NOT IN ('ARRAY', 'VARCHAR')
), records AS (
  SELECT raw_id, record_pos, CASE WHEN json_type(e) = 'OBJECT' AND NOT ({_IS_RECORD.format("e")}) AND json_type(e, '$.detail') = 'OBJECT' THEN e->'$.detail' ELSE e END AS r FROM elements
), sides AS (
  SELECT raw_id, record_pos, CASE WHEN json_type(r, '$.userIdentity.arn') = 'VARCHAR' THEN r->>'$.userIdentity.arn' ELSE '' END AS arn, side,
    CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN left({_BARE.format("(v->>'$')")}, 1) IN ('{{', '[') AND json_valid({_BARE.format("(v->>'$')")}) THEN CAST({_BARE.format("(v->>'$')")} AS JSON) END ELSE v END AS v
  FROM (SELECT *, 'requestParameters' AS side, r->'$.requestParameters' AS v FROM records UNION ALL SELECT *, 'responseElements', r->'$.responseElements' FROM records)
)
SELECT raw_id, record_pos, arn, side, ltrim(regexp_replace(replace(t.path, '$', ''), '"([^"]*)"', '\\1', 'g'), '.') AS array_path, CAST(t.key AS BIGINT) AS item_pos
FROM sides, json_tree(sides.v) AS t WHERE sides.v IS NOT NULL AND regexp_matches(t.fullkey, '[[][0-9]+[]]$')
"""

ORACLE = {"p1_found": _P1, "p2_found": _P2}
