"""Comparison of two versions of entity tables on natural keys.

Surrogate ids are never compared. Every operator takes two DataFrames and the key columns;
to compare many pairs of versions at once, put the pair's id among the key columns. Keys
are matched null-safe unless said otherwise, and rows that repeat a key stay repeated.

Scale: anti joins and equi-joins on the keys only; uniqueness is established by an
aggregation with map-side combine before anything is joined, so an ambiguous key never
multiplies rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.session import cut_lineage


class Category(str, Enum):
    ADDITION = "addition"
    DELETION = "deletion"
    CHANGE = "property_change"
    STRUCTURAL = "structural"
    RESOLUTION = "resolution"


def _null_safe(left: list[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in left])


def without_match(rows: DataFrame, other: DataFrame, keys: list[str], plain: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose key the other side lacks. Columns in ``plain`` compare with ``=``, so a null there matches nothing."""
    held = other.select(*[F.col(c).alias("_o_" + c) for c in keys]).distinct()
    tests = [(F.col(c) == F.col("_o_" + c)) if c in plain else F.col(c).eqNullSafe(F.col("_o_" + c)) for c in keys]
    return rows.join(held, reduce(lambda x, y: x & y, tests), "left_anti")


def added_entities(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return without_match(new, old, keys)


def removed_entities(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return without_match(old, new, keys)


def changed_entities(old: DataFrame, new: DataFrame, keys: list[str], compare: str) -> DataFrame:
    """keys, old_value, new_value where the key is on both sides and ``compare`` differs (null-safe)."""
    before = old.select(*[F.col(c).alias("_o_" + c) for c in keys], F.col(compare).alias("old_value"))
    after = new.select(*keys, F.col(compare).alias("new_value"))
    both = after.join(before, _null_safe(keys, "_o_"))
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*keys, "old_value", "new_value")


def natural_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """side (added or removed) and the key of every row the other side lacks; duplicates stay."""
    gone = removed_entities(old, new, keys).select(F.lit("removed").alias("side"), *keys)
    return added_entities(old, new, keys).select(F.lit("added").alias("side"), *keys).unionByName(gone)


def dangerous_grants(old: DataFrame, new: DataFrame, owner: str, key: str, dangerous: list[str], pair: list[str]) -> DataFrame:
    """New grants of listed keys whose owner did not hold the key; a null owner is always new."""
    return without_match(new.where(F.col(key).isin(*dangerous)), old, [*pair, owner, key], plain=(owner,))


def only_once(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys and value of the keys that occur in exactly one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(value).alias("value")).where("_n = 1").drop("_n")


def structural_diff(old: DataFrame, new: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys unique on both sides whose owner or place differs: keys, old_value, new_value."""
    before = only_once(old, keys, value).select(*[F.col(c).alias("_o_" + c) for c in keys], F.col("value").alias("old_value"))
    after = only_once(new, keys, value)
    moved = after.join(before, _null_safe(keys, "_o_"))
    return moved.where(~F.col("old_value").eqNullSafe(F.col("value"))).select(*keys, "old_value", F.col("value").alias("new_value"))


def files_changed(old: DataFrame, new: DataFrame, keys: list[str], digest: str = "sha256", size: str = "size") -> DataFrame:
    """keys, change_basis, content_unknown: digests differ where both exist, else sizes differ."""
    before = old.select(*[F.col(c).alias("_o_" + c) for c in keys], F.col(digest).alias("_od"), F.col(size).alias("_os"))
    both = new.join(before, _null_safe(keys, "_o_"))
    known = F.col(digest).isNotNull() & F.col("_od").isNotNull()
    changed = F.when(known, F.col(digest) != F.col("_od")).otherwise(~F.col(size).eqNullSafe(F.col("_os")))
    return both.where(changed).select(*keys, F.when(known, "sha256").otherwise("size").alias("change_basis"), F.when(known, 0).otherwise(1).alias("content_unknown"))


@dataclass(frozen=True)
class Subject:
    """How the observations of one table find the natural key of what they are about."""

    table: str
    rows: DataFrame
    id: str
    key: str


def keyed_observations(observations: DataFrame, subjects: list[Subject], pair: tuple[str, ...] = ()) -> DataFrame:
    """pair columns, entity_table, natural_key, event_type, observed_at, resolved per observation.

    An observation whose table is unknown or whose subject is missing keeps ``id:<n>``; one
    whose subject has a null key is left out.
    """
    parts = []
    for s in subjects:
        own = observations.where(F.col("entity_table") == s.table)
        # Where the subjects come in pairs of versions too, an id counts within its pair.
        within = [c for c in pair if c in s.rows.columns]
        subject = s.rows.select(F.col(s.id).alias("_id"), F.col(s.key).alias("_key"), *[F.col(c).alias("_p_" + c) for c in within])
        tests = [F.col("entity_id") == F.col("_id"), *[F.col(c).eqNullSafe(F.col("_p_" + c)) for c in within]]
        joined = own.join(subject, reduce(lambda x, y: x & y, tests), "left")
        joined = joined.where(F.col("_id").isNull() | F.col("_key").isNotNull())
        parts.append(joined.select(*pair, "entity_table", F.coalesce(F.col("_key").cast("string"), F.concat(F.lit("id:"), F.col("entity_id").cast("string"))).alias("natural_key"), "event_type", "observed_at", F.col("_id").isNotNull().alias("resolved")))
    other = observations.where(~F.coalesce(F.col("entity_table").isin(*[s.table for s in subjects]), F.lit(False)))
    parts.append(other.select(*pair, "entity_table", F.concat(F.lit("id:"), F.col("entity_id").cast("string")).alias("natural_key"), "event_type", "observed_at", F.lit(False).alias("resolved")))
    return reduce(DataFrame.unionByName, parts)


def observation_diff(old: DataFrame, new: DataFrame, pair: tuple[str, ...] = ()) -> DataFrame:
    """side, pair columns, entity_table, natural_key, event_type, observed_at over keyed observations, distinct.

    Each pair of versions is compared by itself. Unresolved observations can't be compared and are listed on the side they come from.
    """
    keys = [*pair, "entity_table", "natural_key", "event_type", "observed_at"]
    out = []
    for side, mine, other in (("added", new, old), ("removed", old, new)):
        known = without_match(mine.where("resolved"), other.where("resolved"), keys).select(*keys)
        out.append(known.unionByName(mine.where("NOT resolved").select(*keys)).distinct().select(F.lit(side).alias("side"), *keys))
    return out[0].unionByName(out[1])


def resolution_diff(old: DataFrame, new: DataFrame, pair: list[str] | None = None) -> DataFrame:
    """kind, keys, old and new atom_count and score of bags by (entity_type, canonical_key).

    Bags without canonical key are invisible; of equal keys the bag with the largest id counts.
    """
    keys = [*(pair or []), "entity_type", "canonical_key"]

    def last(bags: DataFrame, side: str) -> DataFrame:
        known = bags.where(F.col("canonical_key").isNotNull())
        return known.groupBy(*keys).agg(F.max_by(F.struct("atom_count", "score"), "id").alias(side))

    both = last(old, "o").join(last(new, "n"), keys, "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o.atom_count").eqNullSafe(F.col("n.atom_count")) | ~F.col("o.score").eqNullSafe(F.col("n.score")), "changed")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", *keys, F.col("o.atom_count").alias("old_count"), F.col("n.atom_count").alias("new_count"), F.col("o.score").alias("old_score"), F.col("n.score").alias("new_score"))


@dataclass
class DiffResult:
    """One comparison; its DataFrames are lazy. ``keys`` are the columns of the natural key."""

    table: str
    keys: tuple[str, ...]
    added: DataFrame | None = None
    removed: DataFrame | None = None
    changed: DataFrame | None = None
    structural: DataFrame | None = None
    category: Category | None = None
    pair: tuple[str, ...] = ()

    @property
    def key_column(self) -> str:
        return self.keys[0]

    def parts(self) -> list[tuple[DataFrame, Category]]:
        """The comparisons there are, each with what it says; a resolution result says so in all of them."""
        told = ((self.added, Category.ADDITION), (self.removed, Category.DELETION), (self.changed, Category.CHANGE), (self.structural, Category.STRUCTURAL))
        return [(part, self.category or category) for part, category in told if part is not None]

    def unified(self, name: str) -> DataFrame:
        """Rows (result, category, key, old_value, new_value) of all parts.

        The key is its columns joined by bars, led by the pair, if any; nulls are empty.
        """
        text = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*self.pair, *self.keys)])
        out = [part.select(F.lit(name).alias("result"), F.lit(category.value).alias("category"), key.alias("key"), text(part, "old_value").alias("old_value"), text(part, "new_value").alias("new_value")) for part, category in self.parts()]
        return reduce(DataFrame.unionByName, out)

    def total_changes(self) -> int:
        return sum(part.count() for part, _ in self.parts())


class Differ:
    """Full comparison of two workspaces given as tables by name.

    Only natural keys are compared: rows that name their owner by a surrogate id are joined
    with it first. A comparison takes place if both sides have all the tables it needs.
    Where the tables hold many pairs of versions, ``pair`` names the columns that tell the
    pairs apart; ids need only be unique within a pair.
    """

    #: Tables with a natural key of their own.
    PLAIN = {"files": "path", "daemons": "label", "kexts": "bundle_id", "frameworks": "path", "sandbox_profiles": "name"}
    #: (table, link to the owner, owner, the owner's natural key, own part of the key).
    OWNED = (
        ("binaries", "file_id", "files", "path", ("bundle_id", "executable_name")),
        ("entitlements", "binary_id", "binaries", "bundle_id", ("key", "value")),
        ("sandbox_rules", "profile_id", "sandbox_profiles", "name", ("operation", "action", "filter_type", "filter_value")),
        ("mach_services", "daemon_id", "daemons", "label", ("service_name",)),
    )

    def __init__(self, old: dict[str, DataFrame], new: dict[str, DataFrame], pair: tuple[str, ...] = ()) -> None:
        self.old, self.new, self.pair = old, new, pair

    def _there(self, *tables: str) -> bool:
        return all(t in self.old and t in self.new for t in tables)

    def _with_owner(self, rows: DataFrame, link: str, owners: DataFrame, key: Column) -> DataFrame:
        """Rows with the owner's key as ``owner``; rows whose owner is missing are left out."""
        held = owners.select(*[F.col(c).alias("_p_" + c) for c in self.pair], F.col("id").alias("_id"), key.alias("owner"))
        tests = [F.col(link) == F.col("_id"), *[F.col(c).eqNullSafe(F.col("_p_" + c)) for c in self.pair]]
        return rows.join(held, reduce(lambda x, y: x & y, tests)).drop("_id", *["_p_" + c for c in self.pair])

    def _owned(self, side: dict[str, DataFrame], table: str, link: str, owner: str, key: str) -> DataFrame:
        return self._with_owner(side[table], link, side[owner], F.col(key))

    def _named_binaries(self, side: dict[str, DataFrame]) -> DataFrame:
        """Binaries with the steadiest name they have as ``name``: bundle, executable, else the path."""
        placed = self._owned(side, "binaries", "file_id", "files", "path")
        return placed.withColumn("name", F.coalesce("bundle_id", "executable_name", F.concat(F.lit("path:"), F.col("owner"))))

    def _reassigned(self, kind: str, table: str, keys: list[str], link: str, owners: tuple[DataFrame, DataFrame], owner_key: str, entity: Column) -> DataFrame:
        """Rows whose key is in one row on each side, under another owner: pair, type, entity, old_value, new_value."""
        sides = []
        for side, owner, name in ((self.old, owners[0], "old_value"), (self.new, owners[1], "new_value")):
            known = side[table].where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys]))
            once = known.groupBy(*self.pair, *keys).agg(F.count("*").alias("_n"), F.first(link).alias("_link")).where("_n = 1")
            sides.append(self._with_owner(once, "_link", owner, F.col(owner_key)).select(*self.pair, *keys, F.col("owner").alias(name)))
        moved = sides[0].join(sides[1], [*self.pair, *keys]).where(~F.col("old_value").eqNullSafe(F.col("new_value")))
        return moved.select(*self.pair, F.lit(kind).alias("type"), entity.alias("entity"), "old_value", "new_value")

    def structural(self) -> DataFrame | None:
        """Executables in another file, rules of another profile, grants of another binary."""
        parts = []
        if self._there("binaries", "files"):
            parts.append(self._reassigned("binary_file_moved", "binaries", ["executable_name"], "file_id", (self.old["files"], self.new["files"]), "path", F.col("executable_name")))
        if self._there("sandbox_rules", "sandbox_profiles"):
            parts.append(self._reassigned("sandbox_rule_reassigned", "sandbox_rules", ["operation", "action"], "profile_id", (self.old["sandbox_profiles"], self.new["sandbox_profiles"]), "name", F.concat_ws(":", "operation", "action")))
        if self._there("entitlements", "binaries", "files"):
            parts.append(self._reassigned("entitlement_reassigned", "entitlements", ["key", "value"], "binary_id", tuple(self._named_binaries(s) for s in (self.old, self.new)), "name", F.col("key")))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def observations(self) -> DataFrame | None:
        """observation_diff over the subjects' natural keys; a binary's is its file's path."""
        if not self._there("observations"):
            return None
        sides = []
        for side in (self.old, self.new):
            subjects = [Subject(t, side[t], "id", k) for t, k in self.PLAIN.items() if self._there(t)]
            if self._there("binaries", "files"):
                subjects.append(Subject("binaries", self._owned(side, "binaries", "file_id", "files", "path"), "id", "owner"))
            sides.append(keyed_observations(side["observations"], subjects, self.pair))
        return observation_diff(*sides, self.pair)

    def full_diff(self) -> dict[str, DiffResult]:
        out: dict[str, DiffResult] = {}
        pair = self.pair
        for table, key in self.PLAIN.items():
            if self._there(table):
                old, new, keys = self.old[table], self.new[table], [*pair, key]
                out[f"{table}_added"] = DiffResult(table, (key,), added=added_entities(old, new, keys), pair=pair)
                out[f"{table}_removed"] = DiffResult(table, (key,), removed=removed_entities(old, new, keys), pair=pair)
                if table == "files":
                    changes = files_changed(old, new, keys).withColumnRenamed("change_basis", "new_value")
                    out["files_changed"] = DiffResult(table, (key,), changed=changes, pair=pair)
        for table, link, owner, owner_key, own in self.OWNED:
            if self._there(table, owner):
                old, new = (self._owned(s, table, link, owner, owner_key) for s in (self.old, self.new))
                keys = ("owner", *own)
                out[table] = DiffResult(table, keys, added_entities(old, new, [*pair, *keys]), removed_entities(old, new, [*pair, *keys]), pair=pair)
        if (moved := self.structural()) is not None:
            out["structural"] = DiffResult("cross_table", ("type", "entity"), structural=moved, pair=pair)
        if (seen := self.observations()) is not None:
            out["observations"] = DiffResult("observations", ("entity_table", "natural_key", "event_type", "observed_at"), seen.where("side = 'added'"), seen.where("side = 'removed'"), pair=pair)
        if self._there("bags"):
            value = lambda side: F.concat_ws("|", F.col(f"{side}_count").cast("string"), F.col(f"{side}_score").cast("decimal(38,6)").cast("string"))
            bags = resolution_diff(self.old["bags"], self.new["bags"], list(pair)).withColumns({"old_value": value("old"), "new_value": value("new")})
            parts = [bags.where(F.col("kind") == k) for k in ("added", "removed", "changed")]
            out["resolution"] = DiffResult("bags", ("entity_type", "canonical_key"), *parts, category=Category.RESOLUTION, pair=pair)
        if self._there("files"):
            # An extension: contents that stand once on both sides, under another path.
            known = (t["files"].where("sha256 IS NOT NULL") for t in (self.old, self.new))
            out["files_moved"] = DiffResult("files", ("sha256",), structural=structural_diff(*known, [*pair, "sha256"], F.col("path")), pair=pair)
        return out

    def _plain_changes(self, table: str, key: str) -> DataFrame:
        """The unified rows of a table's added, removed and changed results from one join of both sides.

        The join is a plain equality, which keeps a partitioning by the key that the sides
        may already have; the rows without a key are compared by themselves.
        """
        keys = [*self.pair, key]
        values = ["sha256", "size"] if table == "files" else []
        side = lambda rows, p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in (*keys, *values)], F.lit(True).alias(f"{p}_there"))
        tests = [F.col(f"o_{c}") == F.col(f"n_{c}") for c in keys]
        keyed = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in keys])
        both = side(self.old[table].where(keyed), "o").join(side(self.new[table].where(keyed), "n"), reduce(lambda x, y: x & y, tests), "full_outer")
        one = lambda p, suffix, category, value: F.struct(F.lit(f"{table}_{suffix}").alias("result"), F.lit(category.value).alias("category"), F.concat_ws("|", *[F.coalesce(F.col(f"{p}_{c}").cast("string"), F.lit("")) for c in keys]).alias("key"), F.lit(None).cast("string").alias("old_value"), value.alias("new_value"))
        none = F.lit(None).cast("string")
        change = F.when(F.col("o_there").isNull(), one("n", "added", Category.ADDITION, none)).when(F.col("n_there").isNull(), one("o", "removed", Category.DELETION, none))
        if values:
            known = F.col("o_sha256").isNotNull() & F.col("n_sha256").isNotNull()
            differs = F.when(known, F.col("o_sha256") != F.col("n_sha256")).otherwise(~F.col("o_size").eqNullSafe(F.col("n_size")))
            change = change.when(differs, one("n", "changed", Category.CHANGE, F.when(known, "sha256").otherwise("size")))
        out = both.select(change.alias("c")).where("c IS NOT NULL").select("c.*")
        bare = Differ({table: self.old[table].where(~keyed)}, {table: self.new[table].where(~keyed)}, self.pair).full_diff()
        return reduce(DataFrame.unionByName, [bare[n].unified(n) for n in bare if n != "files_moved"], out)

    def _owned_changes(self, table: str, link: str, owner: str, owner_key: str, own: tuple[str, ...]) -> DataFrame:
        """The unified rows of a table with owners, by counting each key on both sides in one aggregation."""
        keys = [*self.pair, "owner", *own]
        sides = [self._owned(t, table, link, owner, owner_key).select(*keys, F.lit(o).alias("o"), F.lit(n).alias("n")) for t, o, n in ((self.old, 1, 0), (self.new, 0, 1))]
        counted = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.sum("o").alias("o"), F.sum("n").alias("n")).where("o = 0 OR n = 0")
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
        category = F.when(F.col("o") == 0, Category.ADDITION.value).otherwise(Category.DELETION.value)
        none = F.lit(None).cast("string")
        # Rows that repeat a key stay repeated.
        times = F.explode(F.sequence(F.lit(1), F.greatest("o", "n").cast("int"))).alias("time")
        return counted.select(F.lit(table).alias("result"), category.alias("category"), key.alias("key"), none.alias("old_value"), none.alias("new_value"), times).drop("time")

    def unified(self, staged: bool = False) -> DataFrame:
        """All changes of all results in one frame; tables with a key of their own are compared in one join each, those with owners in one aggregation.

        ``staged`` writes each result before the next is planned: for whole workspaces, whose
        comparisons together make a plan of a size that the driver should not hold.
        """
        joined = {t: k for t, k in self.PLAIN.items() if self._there(t)}
        covered = {f"{t}_{suffix}" for t in joined for suffix in ("added", "removed", "changed")}
        parts = [self._plain_changes(t, k) for t, k in joined.items()]
        owned = [spec for spec in self.OWNED if self._there(spec[0], spec[2])]
        parts += [self._owned_changes(*spec) for spec in owned]
        covered |= {spec[0] for spec in owned}
        parts += [r.unified(name) for name, r in self.full_diff().items() if name not in covered]
        if staged:
            parts = [cut_lineage(p) for p in parts]
        return reduce(DataFrame.unionByName, parts)

    def summary(self) -> DataFrame:
        return self.unified().groupBy("result", "category").agg(F.count("*").alias("changes"))

    def generate_report(self, per_section: int = 50) -> str:
        """Markdown of every non-empty comparison, at most ``per_section`` items each."""
        from lodeworks.functions.markdown import sanitize

        lines = ["# Version comparison", ""]
        for name, result in self.full_diff().items():
            frame = result.unified(name)
            rows = frame.orderBy("category", "key").limit(per_section + 1).collect()
            if not rows:
                continue
            lines.append(f"## {sanitize(name)}")
            for row in rows[:per_section]:
                change = f": {sanitize(row['old_value'])} -> {sanitize(row['new_value'])}" if row["old_value"] is not None or row["new_value"] is not None else ""
                lines.append(f"- {row['category']} {sanitize(row['key'])}{change}")
            if len(rows) > per_section:
                lines.append(f"- and {frame.count() - per_section} more")
            lines.append("")
        return "\n".join(lines)


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; what an insert-or-ignore keeps."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def upsert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows plus the first incoming row of every new key; a null key is always new."""
    fresh = without_match(incoming, existing, keys, plain=tuple(keys))
    keyed = fresh.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys]))
    loose = fresh.where(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys]))
    return existing.unionByName(first_wins(keyed, keys, order)).unionByName(loose)
