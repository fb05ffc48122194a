"""Entity resolution building blocks: atoms, blocking, comparators and pair scores.

Scale: candidates come from equi-joins on bounded lists. A bucket is joined with itself only
while it holds at most ``BUCKET_CAP`` atoms (larger ones are reported and can be refined by
further fields, which is exact); a token's posting list is cut after the hits that can
still be among an atom's first ``HIT_CAP``, which loses none of them. Where only the pairs at
or above a threshold are asked for, ``linking_pairs`` finds them without listing the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from lodeworks.functions.text import blank
from lodeworks.operators.textsearch import token_list
from lodeworks.session import cut_lineage

BUCKET_CAP = HIT_CAP = 200

#: Source key and properties of each entity type (fixed values of the data model).
PROJECTIONS = {
    "binaries": ("executable_name", ("executable_name", "arch", "path", "sha256")),
    "daemons": ("label", ("label", "program", "plist_path")),
    "frameworks": ("path", ("path", "name", "bundle_id", "version")),
    "kexts": ("bundle_id", ("bundle_id", "name", "version")),
    "files": ("path", ("path", "filename", "extension", "size", "sha256", "file_type")),
}


def atomize(rows: DataFrame, entity_type: str, version: str = "source_version_id", order: str = "id") -> DataFrame:
    """source_version_id, entity_type, source_key, properties: one atom per version and key.

    Rows without source key (null or blank) make none; of equal keys the first by ``order``
    counts. properties is JSON of the fields that are there, keys in alphabetical order.
    """
    key, fields = PROJECTIONS[entity_type]
    present = [f for f in sorted(fields) if f in rows.columns]
    properties = F.to_json(F.struct(*[F.col(f) for f in present]))
    keyed = rows.where(~blank(F.trim(F.col(key))))
    first = F.min(F.struct(F.col(order), properties.alias("p"))).alias("b")
    return keyed.groupBy(F.col(version).alias("source_version_id"), F.col(key).alias("source_key")).agg(first).select("source_version_id", F.lit(entity_type).alias("entity_type"), "source_key", F.col("b.p").alias("properties"))


def new_atoms(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming atoms whose (version, type, key) is not there yet."""
    return incoming.join(existing.select("source_version_id", "entity_type", "source_key"), ["source_version_id", "entity_type", "source_key"], "left_anti")


# Blocking


def normal(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def bucket_key(fields: list[str]) -> Column:
    """Normalised values joined by bars, blanks included; null if all are blank."""
    parts = [F.coalesce(normal(F.col(f)), F.lit("")) for f in fields]
    some = reduce(lambda x, y: x | y, [p != "" for p in parts])
    return F.when(some, F.concat_ws("|", *parts))


def bucket_sizes(atoms: DataFrame, fields: list[str]) -> DataFrame:
    keyed = atoms.select("id", bucket_key(fields).alias("bucket")).where("bucket IS NOT NULL")
    return keyed.groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_overflow(atoms: DataFrame, fields: list[str], cap: int = BUCKET_CAP) -> DataFrame:
    """Buckets too large to be paired, with their sizes."""
    return bucket_sizes(atoms, fields).where(F.col("n") > cap)


def bucket_pairs(atoms: DataFrame, fields: list[str], cap: int = BUCKET_CAP, refine: list[str] | None = None) -> DataFrame:
    """(atom_a, atom_b), a < b, of atoms in one bucket of 2 to ``cap``; distinct.

    ``refine`` names further fields by which larger buckets are split again.
    """
    keyed = atoms.select("id", bucket_key(fields).alias("bucket")).where("bucket IS NOT NULL")
    usable = bucket_sizes(atoms, fields).where(F.col("n").between(2, cap)).select("bucket")
    members = keyed.join(usable, "bucket")
    pairs = members.select("bucket", F.col("id").alias("atom_a")).join(members.select("bucket", F.col("id").alias("atom_b")), "bucket").where("atom_a < atom_b").select("atom_a", "atom_b")
    if refine:
        large = bucket_overflow(atoms, fields, cap).select("bucket")
        rest = atoms.withColumn("bucket", bucket_key(fields)).join(large, "bucket", "left_semi").drop("bucket")
        pairs = pairs.unionByName(bucket_pairs(rest, [*fields, *refine], cap))
    return pairs.distinct()


def hot_pairs(atoms: DataFrame, fields: list[str], scored: list[str], refine: list[str], cap: int = BUCKET_CAP, large: DataFrame | None = None) -> DataFrame:
    """(atom_a, atom_b) within buckets above ``cap``, linear in their rows.

    Atoms equal in all ``scored`` fields form a class and are linked to its smallest; the
    smallest of the classes are paired in sub-buckets by each further field of ``refine`` of 2 to
    ``cap``. What a sub-bucket still has too many of ``bucket_overflow`` reports. ``large``: those
    buckets, if they are known.
    """
    large = (bucket_overflow(atoms, fields, cap) if large is None else large).select("bucket")
    hot = atoms.withColumn("bucket", bucket_key(fields)).join(large, "bucket", "left_semi")
    equal = ["bucket", *scored]
    classes = hot.groupBy(*equal).agg(F.min("id").alias("first"))
    same = hot.alias("h").join(classes.alias("c"), reduce(lambda x, y: x & y, [F.col(f"h.{c}").eqNullSafe(F.col(f"c.{c}")) for c in equal])).where("first < id")
    out = same.select(F.col("first").alias("atom_a"), F.col("id").alias("atom_b"))
    firsts = classes.withColumnRenamed("first", "id")
    for more in refine:
        out = out.unionByName(bucket_pairs(firsts, ["bucket", more], cap))
    return out.distinct()


def _indexed(atoms: DataFrame) -> DataFrame:
    return atoms.select("id", F.explode(F.array_distinct(token_list(F.concat_ws(" ", "entity_type", "source_key", "properties")))).alias("token"))


def _asked(atoms: DataFrame) -> DataFrame:
    return atoms.select("source_key").distinct().select("source_key", F.explode(F.array_distinct(token_list(F.col("source_key")))).alias("token"))


def _first(indexed: DataFrame, cap: int) -> DataFrame:
    """(token, hit, _n): of each token the first ``cap`` + 1 ids, counted from 1."""
    return indexed.withColumn("_n", F.row_number().over(Window.partitionBy("token").orderBy("id"))).where(F.col("_n") <= cap + 1).select("token", F.col("id").alias("hit"), "_n")


def token_pairs(atoms: DataFrame, cap: int = HIT_CAP) -> DataFrame:
    """(atom_a, atom_b) by shared tokens: those of an atom's source_key against all indexed text.

    Of an atom's hits the first ``cap`` by id count; a pair holds if either side keeps it.
    An atom's first hits are among the first of each of its tokens, so longer posting lists
    are cut there.
    """
    postings = _first(_indexed(atoms), cap)
    # Atoms of one source key ask the same: one list for all, long enough that each may leave itself out.
    asked = _asked(atoms)
    hits = asked.join(postings, "token").groupBy("source_key").agg(F.slice(F.array_sort(F.collect_set("hit")), 1, cap + 1).alias("hits"))
    kept = atoms.select("id", "source_key").join(hits, "source_key").select("id", F.explode(F.slice(F.filter("hits", lambda h: h != F.col("id")), 1, cap)).alias("hit"))
    return kept.select(F.least("id", "hit").alias("atom_a"), F.greatest("id", "hit").alias("atom_b")).distinct()


def candidate_pairs(atoms: DataFrame, bucket_fields: list[list[str]], tokens: bool = True, hot: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Pairs by buckets and, unless off, by tokens; with ``hot`` (scored fields, refining fields) large buckets too."""
    parts = [bucket_pairs(atoms, fields) for fields in bucket_fields]
    if hot:
        parts += [hot_pairs(atoms, fields, *hot) for fields in bucket_fields]
    if tokens:
        parts.append(token_pairs(atoms))
    return reduce(DataFrame.unionByName, parts).distinct()


# Comparators: (a, b) -> [0, 1], 0 where either is null


def _both(a: Column, b: Column, score: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(score)


def _flag(test: Column) -> Column:
    return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))


def exact(a: Column, b: Column) -> Column:
    return _both(a, b, _flag(a.cast("string") == b.cast("string")))


def norm_equal(a: Column, b: Column) -> Column:
    return _both(a, b, _flag(normal(a) == normal(b)))


def _last(path: Column) -> Column:
    return F.lower(F.substring_index(F.rtrim(F.translate(path, "\\", "/"), F.lit("/")), "/", -1))


def path_suffix(a: Column, b: Column) -> Column:
    """Whether the last components agree, regardless of case and kind of slash.

    Empty components don't count, so a trailing slash changes nothing; a path of slashes
    only, or an empty one, agrees with none.
    """
    return _both(a, b, _flag((_last(a) != "") & (_last(a) == _last(b))))


def numeric_close(a: Column, b: Column) -> Column:
    """1 - difference relative to the larger value, at least 0; unreadable numbers give 0."""
    x, y = a.try_cast("double"), b.try_cast("double")
    top = F.greatest(F.abs(x), F.abs(y))
    score = F.when(x == y, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(x - y) / top))
    return F.coalesce(F.when(x.isNull() | y.isNull(), F.lit(0.0)).otherwise(score), F.lit(0.0))


def token_jaccard(a: Column, b: Column) -> Column:
    from lodeworks.functions.text import tokens

    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return _both(a, b, F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union))


def ratio(a: Column, b: Column) -> Column:
    """Matching-blocks similarity of two texts, in Arrow batches."""

    @arrow_udf(DoubleType())
    def compare(xs: pa.Array, ys: pa.Array) -> pa.Array:
        from difflib import SequenceMatcher

        return pa.array([0.0 if x is None or y is None else SequenceMatcher(None, x.strip().lower(), y.strip().lower()).ratio() for x, y in zip(xs.to_pylist(), ys.to_pylist())], pa.float64())

    return compare(a, b)


COMPARATORS = {"exact": exact, "norm_equal": norm_equal, "path_suffix": path_suffix, "numeric_close": numeric_close, "token_jaccard": token_jaccard, "ratio": ratio}


@dataclass(frozen=True)
class FieldRule:
    field: str
    comparator: str
    weight: float


def _rules(*rules: tuple[str, str, float]) -> tuple[FieldRule, ...]:
    return tuple(FieldRule(*r) for r in rules)


#: Fields, comparators and weights per entity type (fixed values).
SCORING_SPECS = {
    "binaries": _rules(("sha256", "exact", 3.0), ("executable_name", "norm_equal", 2.0), ("path", "path_suffix", 1.0), ("arch", "exact", 0.5)),
    "daemons": _rules(("label", "norm_equal", 3.0), ("program", "path_suffix", 2.0), ("plist_path", "path_suffix", 1.0)),
    "frameworks": _rules(("bundle_id", "norm_equal", 3.0), ("name", "norm_equal", 2.0), ("path", "path_suffix", 1.0), ("version", "exact", 0.5)),
    "kexts": _rules(("bundle_id", "norm_equal", 3.0), ("name", "norm_equal", 2.0), ("version", "exact", 1.0)),
    "files": _rules(("sha256", "exact", 3.0), ("filename", "norm_equal", 1.5), ("path", "path_suffix", 1.0), ("size", "numeric_close", 0.5), ("file_type", "exact", 0.5)),
}
#: Default blocking field per entity type (fixed values).
BLOCKING = {"binaries": [["executable_name"]], "daemons": [["label"]], "frameworks": [["name"]], "kexts": [["bundle_id"]], "files": [["filename"]]}
#: Blocking that also proposes what shares a content or stands in too large a bucket of a name.
WIDE_BLOCKING = {"binaries": [["sha256"], ["executable_name"], ["executable_name", "arch"]], "daemons": [["label"], ["program"]], "frameworks": [["bundle_id"], ["name"]], "kexts": [["bundle_id"]], "files": [["sha256"], ["filename"], ["filename", "size"]]}


def score_columns(entity_type: str, a: str = "a_", b: str = "b_") -> tuple[Column, Column]:
    """(score, features) of a pair whose fields carry the prefixes.

    The score is the weighted mean over fields that both sides have, 0 if there is none;
    features is JSON of the compared fields.
    """
    if entity_type not in SCORING_SPECS:
        raise KeyError(f"no scoring rules for {entity_type!r}")
    top, bottom, features = F.lit(0.0), F.lit(0.0), []
    for rule in sorted(SCORING_SPECS[entity_type], key=lambda r: r.field):
        x, y = F.col(a + rule.field), F.col(b + rule.field)
        there = x.isNotNull() & y.isNotNull()
        value = COMPARATORS[rule.comparator](x, y)
        top = top + F.when(there, rule.weight * value).otherwise(0.0)
        bottom = bottom + F.when(there, F.lit(rule.weight)).otherwise(0.0)
        features.append(F.when(there, F.round(value, 6)).alias(rule.field))
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0)), F.to_json(F.struct(*features))


def score_pairs(pairs: DataFrame, atoms: DataFrame, entity_type: str) -> DataFrame:
    """atom_a, atom_b, score, features of every pair; ``atoms`` has the fields as columns."""
    fields = [r.field for r in SCORING_SPECS[entity_type]]
    side = lambda p: atoms.select(F.col("id").alias(f"atom_{p}"), *[F.col(f).alias(f"{p}_{f}") for f in fields])
    score, features = score_columns(entity_type)
    joined = pairs.join(side("a"), "atom_a").join(side("b"), "atom_b")
    return joined.select("atom_a", "atom_b", score.alias("score"), features.alias("features"))


def hot_fields(entity_type: str, present: list[str]) -> tuple[list[str], list[str]]:
    """What ``hot_pairs`` needs: the scored fields, and those of them heavy enough to refine a bucket by."""
    rules = [r for r in SCORING_SPECS[entity_type] if r.field in present]
    return [r.field for r in rules], [r.field for r in rules if r.weight >= 1.0]


# Links: the pairs at or above a threshold, without the list of all pairs


#: What of a field is compared, so that it is made once an atom and not once a pair.
_PREPARED = {"exact": lambda c: c.cast("string"), "norm_equal": normal, "path_suffix": _last}


def decisive(entity_type: str, threshold: float) -> list[FieldRule]:
    """Fields so heavy that a pair which has them on both sides, unequal, stays below the threshold."""
    rules = SCORING_SPECS[entity_type]
    total = sum(r.weight for r in rules)
    return [r for r in rules if r.comparator in _PREPARED and r.weight / total > 1 - threshold + 1e-9]


def _prepared(rows: DataFrame, p: str, entity_type: str, *more: str) -> DataFrame:
    """id and scored fields under the prefix, the latter as ``_linked`` compares them."""
    fields = [_PREPARED.get(r.comparator, lambda c: c)(F.col(r.field)).alias(p + r.field) for r in SCORING_SPECS[entity_type]]
    return rows.select(F.col("id").alias(f"{p}id"), *more, *fields)


def _linked(entity_type: str, threshold: float) -> Column:
    """The score of prepared fields, as ``score_columns`` sums it up, where it can reach the threshold; else null."""
    able, top, bottom = F.lit(True), F.lit(0.0), F.lit(0.0)
    for rule in sorted(SCORING_SPECS[entity_type], key=lambda r: r.field):
        x, y = F.col(f"a_{rule.field}"), F.col(f"b_{rule.field}")
        there = x.isNotNull() & y.isNotNull()
        if rule.comparator == "path_suffix":
            value = _flag((x != "") & (x == y))
        else:
            value = _flag(x == y) if rule.comparator in _PREPARED else COMPARATORS[rule.comparator](x, y)
        top = top + F.when(there, rule.weight * value).otherwise(0.0)
        bottom = bottom + F.when(there, F.lit(rule.weight)).otherwise(0.0)
        if rule in decisive(entity_type, threshold):
            able = able & (x.isNull() | y.isNull() | (x == y))
    return F.when(able, F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0)))


def _link(*more: Column | str) -> list:
    return [F.least("a_id", "b_id").alias("atom_a"), F.greatest("a_id", "b_id").alias("atom_b"), *more]


def bucket_links(atoms: DataFrame, fields: list[str], large: DataFrame, entity_type: str, threshold: float) -> DataFrame:
    """(atom_a, atom_b, score) of the pairs of ``bucket_pairs`` that link; ``large``: the buckets above the cap."""
    rows = atoms.withColumn("bucket", bucket_key(fields)).where("bucket IS NOT NULL").join(large.select("bucket"), "bucket", "left_anti")
    a, b = (_prepared(rows, p, entity_type, "bucket") for p in ("a_", "b_"))
    score = _linked(entity_type, threshold)
    return a.join(b, "bucket").where((F.col("a_id") < F.col("b_id")) & (score >= threshold)).select(*_link(score.alias("score")))


def token_links(atoms: DataFrame, entity_type: str, threshold: float, field: str | None = None, hot: DataFrame | None = None, cap: int = HIT_CAP) -> DataFrame:
    """(atom_a, atom_b, score) of the pairs of ``token_pairs`` that link.

    ``field``: a decisive field whose buckets, but for those of the atoms ``hot``, are paired
    elsewhere. Two atoms of such buckets either share one or can't link, so pairs of them are left
    out.

    Postings are joined by token and scored on the spot. An atom keeps its first ``cap`` hits, so
    none of them lies beyond the last of a full posting list of its tokens; whether a linking
    hit is really among them is counted over the hits up to it. Those of full lists are merged
    once for all source keys that have the same of them.
    """
    if field is None:
        sides, asking = [(atoms, atoms)], atoms
    else:
        key = bucket_key([field])
        sides, asking = [(hot, hot)], hot
        blank_there = atoms.where(key.isNull())
        if not blank_there.select("id").limit(1).isEmpty():
            paired = atoms.where(key.isNotNull()).join(hot.select("id"), "id", "left_anti")
            free = hot.unionByName(blank_there)
            sides, asking = [(free, free), (blank_there, paired), (paired, blank_there)], atoms
    asked, indexed = _asked(asking), _indexed(atoms)
    # Tokens that are full among the first atoms need no later ones.
    edge = atoms.select("id").orderBy("id").limit(50 * cap).agg(F.max("id")).first()[0]
    full = [r.token for r in indexed.where(F.col("id") <= edge).groupBy("token").count().where(F.col("count") > cap).collect()] if edge is not None else []
    if full:
        indexed = indexed.where((F.col("id") <= edge) | ~F.col("token").isin(full))
    posted = cut_lineage(_first(indexed.join(asked.select("token").distinct().hint("shuffle_hash"), "token", "left_semi"), cap))
    ends = posted.where(F.col("_n") == cap + 1).select("token", F.col("hit").alias("_last"))
    posted, of_key = posted.drop("_n"), Window.partitionBy("source_key")
    lists = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_last").isNotNull(), F.col("token"))).over(of_key)), " ")
    asked = cut_lineage(asked.join(ends, "token", "left").withColumns({"_lists": lists, "_end": F.min("_last").over(of_key)}))

    score = _linked(entity_type, threshold)
    within = (F.col("a_id") != F.col("b_id")) & (F.col("b_id") <= F.coalesce("_end", "b_id"))
    near = []
    for asks, hit in sides:
        a = asked.drop("_last").join(_prepared(asks, "a_", entity_type, "source_key"), "source_key")
        b = posted.join(_prepared(hit, "b_", entity_type), F.col("hit") == F.col("b_id")).drop("hit")
        near.append(a.join(b, "token").where(within & (score >= threshold)).select("source_key", "_lists", "a_id", "b_id", score.alias("score")))
    near = cut_lineage(reduce(DataFrame.unionByName, near).distinct())
    first = lambda hits, by, to: hits.groupBy(by).agg(F.array_sort(F.collect_set("hit")).alias(to))
    common = first(asked.where("_last IS NOT NULL").select("_lists", "token", "_end").distinct().join(posted, "token").where("hit <= _end"), "_lists", "_common").withColumn("_common", F.slice("_common", 1, cap + 1))
    farthest = near.groupBy("source_key").agg(F.max("b_id").alias("_far"))
    rare = first(asked.where("_last IS NULL").join(farthest, "source_key").join(posted, "token").where(F.col("hit") <= F.least("_end", "_far")), "source_key", "_rare")
    none = F.array().cast("array<bigint>")
    hits = F.when(F.col("_rare").isNull(), F.col("_common")).otherwise(F.array_sort(F.array_union(F.coalesce("_common", none), "_rare")))
    place = F.array_position(hits, F.col("b_id"))
    own = ((F.col("a_id") < F.col("b_id")) & F.array_contains(hits, F.col("a_id"))).cast("int")
    return near.join(common, "_lists", "left").join(rare, "source_key", "left").where((place > 0) & (place - own <= cap)).select(*_link("score"))


def linking_pairs(atoms: DataFrame, bucket_fields: list[list[str]], entity_type: str, threshold: float, tokens: bool = True, hot: tuple[list[str], list[str]] | None = None, large: list[DataFrame] | None = None) -> DataFrame:
    """(atom_a, atom_b, score) of the ``candidate_pairs`` that score ``threshold`` or more; distinct.

    ``large``: the buckets above the cap of each of ``bucket_fields``, if they are known.
    """
    weighty = decisive(entity_type, threshold)
    if not weighty:
        return score_pairs(candidate_pairs(atoms, bucket_fields, tokens, hot), atoms, entity_type).where(F.col("score") >= threshold).drop("features")
    named = [r.field for r in weighty if r.comparator != "path_suffix"]
    covered: tuple = (None, None)
    buckets, others = [], []
    for fields, over in zip(bucket_fields, large or [cut_lineage(bucket_overflow(atoms, fields)) for fields in bucket_fields], strict=True):
        buckets.append(bucket_links(atoms, fields, over, entity_type, threshold))
        there = cut_lineage(atoms.withColumn("bucket", bucket_key(fields)).join(over.select("bucket"), "bucket", "left_semi").drop("bucket"))
        if hot:
            others.append(score_pairs(hot_pairs(there, fields, *hot, large=over), there, entity_type).where(F.col("score") >= threshold).drop("features"))
        if covered == (None, None) and len(fields) == 1 and fields[0] in named:
            covered = (fields[0], there)
    if tokens:
        others.append(token_links(atoms, entity_type, threshold, *covered))
    alone = len(buckets) == 1 and (not tokens or covered[0] is not None)
    # Links within the only paired buckets occur once and in none of the other lists.
    if alone:
        return reduce(DataFrame.unionByName, [*buckets, *([reduce(DataFrame.unionByName, others).distinct()] if others else [])])
    return reduce(DataFrame.unionByName, [*buckets, *others]).distinct()
