"""Queries of the llm problems: p3, p4, p7, p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import components, leakage, linkage, mixing, mojibake
from lodeworks.session import table


#: Which image each inventory lists (what is known of the tables).
INVENTORIES = {"/inventory/signing": "/images/orchid-desktop"}


def p3_links(spark: SparkSession, sf: str, image_of: dict[str, str] = INVENTORIES) -> DataFrame:
    return linkage.match_inventory(table(spark, sf, "binaries"), table(spark, sf, "files"), table(spark, sf, "versions"), image_of)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_links(spark, sf).select("binary_id", "path")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return components.linked_groups(table(spark, sf, "match_candidates"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    leaks = leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return leaks.where(F.col("run_words") >= leakage.Plan.run).select("item_id", "doc_id")


def p7_passages(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    chosen, shares = mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    return chosen.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf, "documents"))


QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p7_found": p7_found, "p7_passages": p7_passages, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_restored": p9_restored}

_P4 = """
WITH RECURSIVE links AS (
  SELECT DISTINCT entity_type, atom_a AS a, atom_b AS b FROM match_candidates WHERE score >= 0.85 AND atom_a <> atom_b AND NOT isnan(score)
  UNION SELECT DISTINCT entity_type, atom_b, atom_a FROM match_candidates WHERE score >= 0.85 AND atom_a <> atom_b AND NOT isnan(score)
), reach AS (
  SELECT entity_type, a AS v, a AS w FROM links
  UNION
  SELECT r.entity_type, r.v, l.b FROM reach r JOIN links l ON l.entity_type = r.entity_type AND l.a = r.w
)
SELECT entity_type, min(w) AS group_id, v AS atom_id FROM reach GROUP BY entity_type, v
"""

_P7 = r"""
WITH words AS (
  SELECT 'i' AS side, item_id AS id, list_filter(list_transform(regexp_split_to_array(lower(nfc_normalize(regexp_replace(text, '\p{Cf}', '', 'g'))), '[\s\p{Z}]+'),
         lambda w: nfc_normalize(regexp_replace(w, '[^\p{L}\p{N}\p{M}]', '', 'g'))), lambda w: w <> '') AS w FROM benchmark
  UNION ALL
  SELECT 'd', doc_id, list_filter(list_transform(regexp_split_to_array(lower(nfc_normalize(regexp_replace(text, '\p{Cf}', '', 'g'))), '[\s\p{Z}]+'),
         lambda w: nfc_normalize(regexp_replace(w, '[^\p{L}\p{N}\p{M}]', '', 'g'))), lambda w: w <> '') FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT side, id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, len(w) - 10)) AS k FROM words WHERE len(w) >= 12)
)
SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM grams i JOIN grams d ON i.g = d.g AND i.side = 'i' AND d.side = 'd'
"""

ORACLE = {"p4_found": _P4, "p7_found": _P7}
