"""Entity resolution over atoms: bags, their events, exact and scored resolution.

All state is DataFrames: atoms (id, source_version_id, entity_type, source_key, properties),
bags (id, entity_type, canonical_key, atom_count, score), bag_atoms (bag_id, atom_id) and
events (event_type, bag_id, atom_ids, reason, confidence, operator). Operations return new
ones; nothing is changed in place.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.text import blank
from lodeworks.operators import cluster, matching
from lodeworks.session import cut_lineage

THRESHOLD = 0.85
BAGS = "id long, entity_type string, canonical_key string, atom_count long, score double"
MEMBERS = "bag_id long, atom_id long"
EVENTS = "event_type string, bag_id long, atom_ids array<long>, reason string, confidence double, operator string"


@dataclass
class Resolution:
    """State of a resolution and what its last step did."""

    bags: DataFrame
    bag_atoms: DataFrame
    events: DataFrame
    candidates: DataFrame | None = None
    counts: dict[str, int] | None = None
    #: Atoms in buckets too large to be paired in full.
    overflow: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> Resolution:
        return Resolution(spark.createDataFrame([], BAGS), spark.createDataFrame([], MEMBERS), spark.createDataFrame([], EVENTS))


def stored(done: Resolution, kind: str, at: str) -> dict[str, DataFrame]:
    """What a resolution leaves in the tables of a workspace."""
    scored = done.candidates.withColumns({"id": F.abs(F.xxhash64("atom_a", "atom_b")), "entity_type": F.lit(kind)})
    events = done.events.withColumns({"id": F.abs(F.xxhash64("event_type", "bag_id")), "atom_ids": F.to_json("atom_ids"), "timestamp": F.lit(at)})
    return {"bags": done.bags, "bag_atoms": done.bag_atoms, "match_candidates": scored, "resolution_event_log": events}


def _event(members: DataFrame, kind: str, reason: str, confidence=None) -> DataFrame:
    """One event per bag of (bag_id, atom_id), listing its atoms in order."""
    return members.groupBy("bag_id").agg(F.array_sort(F.collect_list("atom_id")).alias("atom_ids")).select(F.lit(kind).alias("event_type"), "bag_id", "atom_ids", F.lit(reason).alias("reason"), F.lit(confidence).cast("double").alias("confidence"), F.lit("auto").alias("operator"))


def ingest_atom(atoms: DataFrame, version: int, entity_type: str, source_key: str, properties: str) -> DataFrame:
    """Atoms with one more; ValueError if its (version, type, key) is there already."""
    same = atoms.where((F.col("source_version_id") == version) & (F.col("entity_type") == entity_type) & (F.col("source_key") == source_key))
    if not same.isEmpty():
        raise ValueError(f"atom exists: {version}, {entity_type}, {source_key}")
    top = atoms.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    spark = atoms.sparkSession
    one = spark.createDataFrame([(top + 1, version, entity_type, source_key, properties)], "id long, source_version_id long, entity_type string, source_key string, properties string")
    return atoms.unionByName(one)


def create_bag(state: Resolution, entity_type: str, atom_ids: list[int], canonical_key: str | None = None, reason: str = "manual") -> Resolution:
    """A new bag of the given atoms; an atom may be in several bags."""
    spark = state.bags.sparkSession
    bag = state.bags.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    members = spark.createDataFrame([(bag, a) for a in atom_ids], MEMBERS)
    row = spark.createDataFrame([(bag, entity_type, canonical_key, len(atom_ids), None)], BAGS)
    return replace(state, bags=state.bags.unionByName(row), bag_atoms=state.bag_atoms.unionByName(members), events=state.events.unionByName(_event(members, "create", reason)))


def merge_bags(state: Resolution, merges: DataFrame, reason: str = "merge") -> Resolution:
    """Bags folded into survivors: ``merges`` has (survivor, loser).

    Members are united and an atom in both stays once; losers and their claim on events go
    to the survivor; one ``merge`` event per survivor.
    """
    to = merges.where("survivor <> loser").select(F.col("loser").alias("_l"), F.col("survivor").alias("_s")).distinct()
    moved = state.bag_atoms.join(to, F.col("bag_id") == F.col("_l"), "left").select(F.coalesce("_s", "bag_id").alias("bag_id"), "atom_id").distinct()
    sizes = moved.groupBy("bag_id").agg(F.count("*").alias("n"))
    kept = state.bags.join(to, F.col("id") == F.col("_l"), "left_anti").join(sizes, F.col("id") == F.col("bag_id"), "left").select("id", "entity_type", "canonical_key", F.coalesce("n", F.lit(0)).alias("atom_count"), "score")
    events = state.events.join(to, F.col("bag_id") == F.col("_l"), "left").withColumn("bag_id", F.coalesce("_s", "bag_id")).drop("_l", "_s")
    merged = _event(moved.join(to.select(F.col("_s").alias("bag_id")).distinct(), "bag_id", "left_semi"), "merge", reason)
    return replace(state, bags=kept, bag_atoms=moved, events=events.unionByName(merged))


def split_bag(state: Resolution, bag_id: int, atom_ids: list[int], reason: str = "split") -> Resolution:
    """The given atoms of a bag moved to a new bag without canonical key."""
    fresh = state.bags.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    goes = (F.col("bag_id") == bag_id) & F.col("atom_id").isin(*atom_ids)
    members = state.bag_atoms.withColumn("bag_id", F.when(goes, F.lit(fresh)).otherwise(F.col("bag_id")).cast("long"))
    sizes = members.groupBy("bag_id").agg(F.count("*").alias("n"))
    origin = state.bags.where(F.col("id") == bag_id).select(F.lit(fresh).cast("long").alias("id"), "entity_type", F.lit(None).cast("string").alias("canonical_key"), F.lit(0).cast("long").alias("atom_count"), F.lit(None).cast("double").alias("score"))
    bags = state.bags.unionByName(origin).join(sizes, F.col("id") == F.col("bag_id"), "left").select("id", "entity_type", "canonical_key", F.coalesce("n", F.lit(0)).alias("atom_count"), "score")
    return replace(state, bags=bags, bag_atoms=members, events=state.events.unionByName(_event(members.where(F.col("bag_id") == fresh), "split", reason)))


def unresolved_atoms(atoms: DataFrame, bag_atoms: DataFrame) -> DataFrame:
    return atoms.join(bag_atoms.select(F.col("atom_id").alias("id")), "id", "left_anti")


def canonical_key(keys: list[str]):
    """Normalised non-blank values joined by bars; null if there is none."""
    parts = [F.when(~blank(matching.normal(F.col(k))), matching.normal(F.col(k))) for k in keys]
    joined = F.concat_ws("|", *parts)
    return F.when(joined != "", joined)


def resolve(atoms: DataFrame, keys: list[str], entity_type: str) -> Resolution:
    """Exact resolution of atoms that carry their properties as columns.

    Atoms of one canonical key share a bag named by its smallest atom; an atom alone gets a
    bag without key; an atom without any key value stays unresolved. counts: merges (bags of
    two or more) and atoms_resolved.
    """
    keyed = atoms.select("id", canonical_key(keys).alias("ck")).where("ck IS NOT NULL")
    bags = keyed.groupBy("ck").agg(F.min("id").alias("id"), F.count("*").alias("atom_count"))
    members = keyed.join(bags.select("ck", F.col("id").alias("bag_id")), "ck").select("bag_id", F.col("id").alias("atom_id"))
    rows = bags.select("id", F.lit(entity_type).alias("entity_type"), F.when(F.col("atom_count") > 1, F.col("ck")).alias("canonical_key"), "atom_count", F.lit(None).cast("double").alias("score"))
    got = rows.agg(F.coalesce(F.sum((F.col("atom_count") > 1).cast("long")), F.lit(0)), F.coalesce(F.sum("atom_count"), F.lit(0))).first()
    return Resolution(rows, members, _event(members, "create", "exact"), counts={"merges": got[0], "atoms_resolved": got[1]})


def resolve_scored(atoms: DataFrame, entity_type: str, threshold: float = THRESHOLD, resolved: DataFrame | None = None, blocking: list[list[str]] | None = None, tokens: bool = True, hot: bool = True) -> Resolution:
    """Block, score, cluster and merge atoms that carry their fields as columns.

    Candidates come from the blocking fields and, unless ``tokens`` is off, from token search.
    Buckets of more than ``matching.BUCKET_CAP`` atoms are not paired in full: unless ``hot`` is
    off, their equal atoms are linked to the first of them and the rest within sub-buckets;
    ``overflow`` of the result counts the atoms of such buckets.
    Only atoms without a bag take part (buckets are sized over all). ``candidates`` has every
    scored pair and is computed where it is read; pairs at or above the threshold link, and are
    found without it; a cluster is a bag whose key is the source
    key of its smallest atom and whose score is the mean of its links, with a ``create`` and
    a ``resolve`` event; atoms left over are bags of one. counts: clusters, merges (links)
    and atoms_resolved.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    if tokens and not {"entity_type", "properties"} <= set(atoms.columns):
        fields = sorted(r.field for r in matching.SCORING_SPECS[entity_type])
        atoms = atoms.withColumns({"entity_type": F.lit(entity_type), "properties": F.to_json(F.struct(*fields))})
    blocking = blocking or matching.BLOCKING[entity_type]
    heavy = matching.hot_fields(entity_type, atoms.columns) if hot else None
    pairs = matching.candidate_pairs(atoms, blocking, tokens, heavy)
    free = unresolved_atoms(atoms, resolved) if resolved is not None else atoms
    if resolved is not None:
        ids = free.select("id")
        pairs = pairs.join(ids.withColumnRenamed("id", "atom_a"), "atom_a", "left_semi").join(ids.withColumnRenamed("id", "atom_b"), "atom_b", "left_semi")
    scored = matching.score_pairs(pairs, atoms, entity_type)
    large = [cut_lineage(matching.bucket_overflow(atoms, fields)) for fields in blocking]
    links = matching.linking_pairs(atoms, blocking, entity_type, threshold, tokens, heavy, large)
    if resolved is not None:
        links = links.join(ids.withColumnRenamed("id", "atom_a"), "atom_a", "left_semi").join(ids.withColumnRenamed("id", "atom_b"), "atom_b", "left_semi")
    links = cut_lineage(links)
    groups = cluster.cluster(links)
    members = groups.select(F.col("cluster_id").alias("bag_id"), "atom_id")
    of_link = links.join(members.select(F.col("atom_id").alias("atom_a"), "bag_id"), "atom_a").groupBy("bag_id").agg(F.avg("score").alias("score"))
    sized = members.groupBy("bag_id").agg(F.count("*").alias("atom_count")).join(of_link, "bag_id")
    named = sized.join(atoms.select(F.col("id").alias("bag_id"), F.col("source_key").alias("canonical_key")), "bag_id")
    bags = named.select(F.col("bag_id").alias("id"), F.lit(entity_type).alias("entity_type"), "canonical_key", "atom_count", "score")
    alone = free.join(members.select(F.col("atom_id").alias("id")), "id", "left_anti").select("id")
    singles = alone.select("id", F.lit(entity_type).alias("entity_type"), F.lit(None).cast("string").alias("canonical_key"), F.lit(1).cast("long").alias("atom_count"), F.lit(None).cast("double").alias("score"))
    all_members = members.unionByName(alone.select(F.col("id").alias("bag_id"), F.col("id").alias("atom_id")))
    created = _event(all_members, "create", "scored")
    resolved_events = _event(members, "resolve", "scored").drop("confidence").join(sized.select("bag_id", F.col("score").alias("confidence")), "bag_id").select(*created.columns)
    found = members.agg(F.count_distinct("bag_id"), F.count("*")).first()
    counts = {"clusters": found[0], "merges": links.count(), "atoms_resolved": found[1]}
    overflow = sum(over.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for over in large)
    return Resolution(bags.unionByName(singles), all_members, created.unionByName(resolved_events), scored, counts, overflow)
