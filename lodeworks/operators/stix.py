"""Export of entities, observations and version differences as STIX 2.1 objects.

Every object is one row (id, type, json), so a bundle of any size is written by the
executors; ``bundle_id`` hashes the ids in order by a digest of digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Namespace of all ids made here: a fixed value of this engine.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "lodeworks.stix")
SPEC = "2.1"


class ReferenceError_(ValueError):
    """An object refers to something that is not exported."""


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Version-5 UUID of a text, from its SHA-1 with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.substring(variant, nibble + 1, F.lit(1)), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def object_id(kind: str, table: Column, row_id: Column) -> Column:
    """``kind--uuid`` seeded by table and row id."""
    seed = F.concat(F.lit(f"{kind}:"), F.lit('["'), table, F.lit('",'), row_id.cast("string"), F.lit("]"))
    return F.concat(F.lit(f"{kind}--"), uuid5(seed))


def timestamp(text: Column, otherwise: str) -> Column:
    """RFC 3339 in UTC with the given digits kept; null and empty become ``otherwise``, garbage is an error."""
    clean = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(otherwise)).otherwise(F.trim(text))
    at = F.to_timestamp(F.regexp_replace(clean, "^(\\d{4}-\\d{2}-\\d{2})T", "$1 "))
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    digits = F.date_format(at, "SSSSSS")
    return F.concat(whole, F.when(digits == "000000", "").otherwise(F.concat(F.lit("."), F.regexp_replace(digits, "0+$", ""))), F.lit("Z"))


def _rows(df: DataFrame, kind: str, table: str, fields: list[Column], now: str, domain: bool) -> DataFrame:
    own = object_id(kind, F.lit(table), F.col("id"))
    common = [F.lit(kind).alias("type"), F.lit(SPEC).alias("spec_version"), own.alias("id")]
    at = timestamp(F.col(when), now) if (when := "observed_at" if table == "observations" else "observed_time") in df.columns else F.lit(now)
    times = [at.alias("created"), at.alias("modified")] if domain else []
    return df.select(own.alias("id"), F.lit(kind).alias("type"), F.lit(table).alias("source_table"), F.col("id").alias("source_id"), F.to_json(F.struct(*common, *times, *fields)).alias("json"))


def _hashes(digest: Column) -> Column:
    return F.when(digest.isNotNull() & (digest != ""), F.struct(digest.alias("SHA-256"))).alias("hashes")


def files(df: DataFrame, now: str) -> DataFrame:
    size = F.when(F.col("size") > 0, F.col("size")).alias("size")
    return _rows(df, "file", "files", [F.col("filename").alias("name"), size, _hashes(F.col("sha256")), F.col("path").alias("x_path"), F.col("file_type").alias("x_file_type")], now, False)


def binaries(df: DataFrame, now: str) -> DataFrame:
    extra = F.struct(F.col("arch"), F.col("bundle_id")).alias("x_binary")
    return _rows(df, "file", "binaries", [F.coalesce("executable_name", F.lit("unknown")).alias("name"), extra], now, False)


def daemons(df: DataFrame, now: str) -> DataFrame:
    return _rows(df, "infrastructure", "daemons", [F.col("label").alias("name"), F.array(F.lit("hosting-target")).alias("infrastructure_types"), F.col("program").alias("x_program"), F.col("user_name").alias("x_user_name"), F.col("mach_services").alias("x_mach_services")], now, True)


def entitlements(df: DataFrame, now: str) -> DataFrame:
    return _rows(df, "course-of-action", "entitlements", [F.col("key").alias("name"), F.coalesce(F.col("value").cast("string"), F.lit("None")).alias("description")], now, True)


#: Kind of the object an observation of each table refers to.
TARGETS = {"files": "file", "binaries": "file", "daemons": "infrastructure", "entitlements": "course-of-action"}


def observations(df: DataFrame, now: str) -> DataFrame:
    """observed-data about files and binaries, sightings of anything else."""
    data = F.col("entity_table").isin("files", "binaries")
    target = F.lit(None).cast("string")
    for table, kind in TARGETS.items():
        target = F.when(F.col("entity_table") == table, object_id(kind, F.lit(table), F.col("entity_id"))).otherwise(target)
    at = timestamp(F.col("observed_at"), now)
    seen = _rows(df.where(data).withColumn("_t", target), "observed-data", "observations", [at.alias("first_observed"), at.alias("last_observed"), F.lit(1).alias("number_observed"), F.array("_t").alias("object_refs"), F.col("event_type").alias("x_event_type")], now, True)
    sighted = _rows(df.where(~data).withColumn("_t", target), "sighting", "observations", [at.alias("first_seen"), at.alias("last_seen"), F.lit(1).alias("count"), F.col("_t").alias("sighting_of_ref"), F.col("event_type").alias("x_event_type")], now, True)
    return seen.unionByName(sighted)


MAPPERS = {"files": files, "binaries": binaries, "daemons": daemons, "entitlements": entitlements}


def export(tables: dict[str, DataFrame], now: str, include: tuple[str, ...] = ("files", "binaries", "daemons", "entitlements", "observations")) -> DataFrame:
    """All objects as (id, type, source_table, source_id, json), ids unique.

    Targets of exported observations come along even if their table is not included; an
    observation of an unsupported table or a missing row is an error, and so are two
    objects of one id that differ.
    """
    parts = [MAPPERS[t](tables[t], now) for t in include if t in MAPPERS and t in tables]
    if "observations" in include and "observations" in tables:
        seen = tables["observations"]
        if not seen.where(~F.coalesce(F.col("entity_table").isin(*TARGETS), F.lit(False))).isEmpty():
            raise ReferenceError_("an observation is about a table that can't be exported")
        for name in TARGETS:
            ids = seen.where(F.col("entity_table") == name).select(F.col("entity_id").alias("id")).distinct()
            if name not in tables:
                if not ids.isEmpty():
                    raise ReferenceError_(f"an observation is about a row of {name} that isn't there")
                continue
            if not ids.join(tables[name], "id", "left_anti").isEmpty():
                raise ReferenceError_(f"an observation is about a row of {name} that isn't there")
            if name not in include:
                parts.append(MAPPERS[name](tables[name].join(ids, "id", "left_semi"), now))
        parts.append(observations(seen, now))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.distinct()
    if not out.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("two different objects have one id")
    return out


def bundle_id(objects: DataFrame) -> str:
    """Id of the bundle: a UUID of its objects, whatever their order and partitioning.

    Each object's SHA-256 enters in four parts of 60 bits, each summed without loss.
    """
    digest = F.sha2(F.concat_ws("\n", "id", "json"), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)) for i in range(4)]
    row = objects.agg(F.count("*"), *sums).first()
    return f"bundle--{uuid.uuid5(NAMESPACE, ':'.join(map(str, row)))}"


def diff_notes(unified: DataFrame, now: str) -> DataFrame:
    """One note per change of a unified comparison, all about one software object.

    Equal changes collapse. The software object comes as the first kind of row.
    """
    software = f"software--{uuid.uuid5(NAMESPACE, 'comparison')}"
    seed = F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in ("category", "result", "key", "old_value", "new_value")]))
    own = F.concat(F.lit("note--"), uuid5(F.concat(F.lit("note:"), seed)))
    content = F.concat(F.col("category"), F.lit(" "), F.coalesce("key", F.lit("?")), F.lit(" ("), F.coalesce("old_value", F.lit("?")), F.lit(" -> "), F.coalesce("new_value", F.lit("?")), F.lit(")"))
    note = F.to_json(F.struct(F.lit("note").alias("type"), F.lit(SPEC).alias("spec_version"), own.alias("id"), F.lit(now).alias("created"), F.lit(now).alias("modified"), F.col("result").alias("abstract"), content.alias("content"), F.array(F.lit(software)).alias("object_refs")))
    notes = unified.select(own.alias("id"), F.lit("note").alias("type"), note.alias("json")).distinct()
    spark = unified.sparkSession
    head = spark.range(1).select(F.lit(software).alias("id"), F.lit("software").alias("type"), F.to_json(F.struct(F.lit("software").alias("type"), F.lit(SPEC).alias("spec_version"), F.lit(software).alias("id"), F.lit("compared versions").alias("name"))).alias("json"))
    return head.unionByName(notes)


def write_bundle(objects: DataFrame, path: str) -> str:
    """The objects as a bundle; returns its id.

    A path that ends in ``.json`` becomes one file with the bundle object, its objects in
    order of id; it is written partition by partition, so the driver holds one at a time. Any
    other path becomes a folder of JSON lines, one file per task, for what one file is too
    small for.
    """
    own = bundle_id(objects)
    if not path.endswith(".json"):
        objects.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
        return own
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'{{"type":"bundle","id":"{own}","objects":[')
        for n, row in enumerate(objects.orderBy("id").select("json").toLocalIterator()):
            out.write(("," if n else "") + "\n" + row["json"])
        out.write("\n]}\n")
    return own
