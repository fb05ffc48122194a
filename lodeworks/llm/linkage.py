"""Matching entities across sources without keys, by soft logic.

Candidate pairs come from several blocking keys (content prefix, application name with one
letter missing or two cut off, vendor with name, executable name, and combinations). Each
pair has a truth value y in [0, 1] and weighted rules about it, all hinges:

* the contents agree / the name agrees / vendor and name agree / the executable agrees
  -> the pair matches, each weighted by the similarity (a * max(0, 1 - y)^2);
* contents, vendor, name or executable contradict each other, or nothing speaks for it
  -> the pair doesn't match (b * max(0, y)^2);
* a combination of them agrees that fewer files share -> the pair matches;
* exclusivity: the pairs of one record sum to at most 1;
* transitivity: a record matches a file and describes the same thing as others -> that
  thing is the file (value q), and the thing is the file -> so is the record
  (w * max(0, y - q)^2 + w * max(0, q - y)^2). The thing stands between its records, so
  that n records need n rules each way and not one for every two of them.

That is a convex problem, solved by alternating directions: each record minimises its own
rules exactly over its pairs and its copies of q (a projection found by sorting its few
candidates), the copies of a thing are averaged, and multipliers carry the disagreement
on until no value moves; RuntimeError if that doesn't happen. The values are the
confidences.

Scale: a key that more than ``Rules.explicit`` files share is not expanded. It enters each of its
records as one class row that stands for all of its files: so many equal rivals, with the
key's evidence divided among them (as among the files of any key), which take part in exclusivity and can't be accepted
(they tie: with its share of all evidence together a pair of such a class stays below
acceptance). A pair inside a class is expanded where it has a second kind of evidence,
by the combined keys; those over the limit are classes again. All steps are equi-joins and
aggregations with map-side combine; groups are never listed pairwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import canonical_path, hash_value, nfc, trimmed
from lodeworks.session import cut_lineage, discard


@dataclass(frozen=True)
class Rules:
    """Weights of the rules and what the descriptions go by; other sources hand in their own.

    ``explicit``: files that may share a key and still be proposed one by one.
    ``hash_prefix``: hex digits that a cut-off content hash keeps at least. ``containers``:
    directories that hold things of any vendor. ``roles``: last parts of a bundle id that name
    a role, not a product. ``editions``: endings that mark another product.
    ``accept``, ``margin``: a match needs this confidence and this lead.
    """

    weights: dict[str, float] = field(default_factory=lambda: {"hash": 6.0, "name": 3.0, "vendor_name": 3.0, "exec": 1.5, "exec_shared": 0.3, "not_hash": 6.0, "not_vendor": 4.0, "not_name": 4.0, "not_exec": 1.5, "prior": 1.0, "same": 16.0})
    explicit: int = 20
    hash_prefix: int = 12
    containers: tuple[str, ...] = ("applications", "application support", "library", "system", "users", "shared", "utilities", "opt", "usr", "local", "bin", "sbin", "lib", "libexec")
    roles: tuple[str, ...] = ("app", "helper", "agent", "mac", "daemon", "xpc")
    editions: tuple[str, ...] = ("pro", "lite", "legacy", "plus", "mini", "max", "classic")
    accept: float = 0.5
    margin: float = 0.05


def _plain(text: Column) -> Column:
    """Lower case, letters and digits only; nothing left is null."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]", "")
    return F.when(bare != "", bare)


def _executable(name: Column) -> Column:
    """An executable's name without folder, deletion mark, suffix and version."""
    base = F.regexp_replace(trimmed(name), r" \(deleted\)$", "")
    base = F.try_element_at(F.split(base, r"[/\\]"), F.lit(-1))
    return _plain(F.regexp_replace(base, r"(?i)(\.bin|\.exe|-\d+(\.\d+)+)$", ""))


def describe_binaries(binaries: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """bid, digest, vendor, name, exec of inventory rows; what is missing is null."""
    bundle = trimmed(nfc(F.col("bundle_id")))
    # A team id in front and roles at the end go while two parts are left.
    bundle = F.regexp_replace(bundle, r"^(?=[0-9A-Z]*\d)[0-9A-Z]{8,10}[._]+(?=[^._]+[._]+[^._])", "")
    bundle = F.regexp_replace(bundle, r"(?i)^([^._]+[._]+[^._]+?.*?)(?:[._]+(?:" + "|".join(rules.roles) + "))+$", "$1")
    parts = F.filter(F.split(bundle, r"[._]+"), lambda p: p != "")
    rows = binaries.select(F.col("id").cast("long").alias("bid"), hash_value(F.col("sha256")).alias("d"), parts.alias("p"), _executable(nfc(F.col("executable_name"))).alias("exec")).where("bid IS NOT NULL")
    size = F.size("p")
    vendor = F.when(size >= 3, F.try_element_at("p", F.lit(2))).when(size == 2, F.try_element_at("p", F.lit(1)))
    product = F.when(size >= 3, F.array_join(F.slice("p", 3, 64), "")).when(size >= 1, F.try_element_at("p", F.lit(-1)))
    product = F.regexp_replace(product, r"(?i)[-_ ](beta|nightly|dev|canary)$", "")
    digest = F.when(F.col("d").rlike(f"^[0-9a-f]{{{rules.hash_prefix},}}$"), F.col("d"))
    return rows.select("bid", digest.alias("digest"), _plain(vendor).alias("vendor"), _plain(product).alias("name"), "exec").dropDuplicates(["bid"])


def describe_files(files: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """fid, path, digests, vendor, name, exec, own_exec of the executables among file rows.

    A file is its canonical path, with all contents it ever had. own_exec: whether the
    executable is named after its application and so says which one it is.
    """
    path = F.col("path")
    rows = files.select(canonical_path(path).alias("path"), hash_value(F.col("sha256")).alias("digest"), "file_type").where("path IS NOT NULL AND path <> ''")
    programs = rows.where(F.col("file_type").isin("macho", "elf", "pe") | F.col("path").contains(".app/Contents/MacOS/"))
    one = programs.groupBy("path").agg(F.collect_set("digest").alias("digests"))
    parts = F.split("path", "/")
    bundle = F.expr("filter(transform(split(path, '/'), (x, i) -> IF(endswith(x, '.app'), i, -1)), i -> i >= 0)")
    at = F.try_element_at(bundle, F.lit(-1))
    app = F.when(F.size(bundle) > 0, F.regexp_replace(F.get(parts, at), r"\.app$", "")).otherwise(F.try_element_at(parts, F.lit(-1)))
    above = F.when(F.size(bundle) > 0, F.get(parts, at - 1))
    vendor = F.when(~F.lower(above).isin(*rules.containers), _plain(above))
    told = one.select(F.unhex(F.md5(F.col("path"))).alias("fid"), "path", "digests", vendor.alias("vendor"), _plain(app).alias("name"), _executable(F.try_element_at(parts, F.lit(-1))).alias("exec"))
    own = F.coalesce((F.col("exec") == F.col("name")) | (F.col("exec") == F.concat("name", F.lit("d"))), F.lit(False))
    return told.withColumn("own_exec", own)


def _variants(word: Column) -> Column:
    """The word and all it becomes with one character missing."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1000))))
    return F.when(word.isNull(), F.array().cast("array<string>")).when(F.length(word) > 4, F.array_union(F.array(word), shorter)).otherwise(F.array(word))


def _tag(kind: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(kind + ":"), w))


def _keys(entity: DataFrame, side: str, rules: Rules) -> Column:
    """Blocking keys of a described record; both sides produce the same kinds.

    h content, n name, v vendor and name, e executable, c content with name or executable,
    x executable with name or vendor.
    """
    vendor, name, exe = F.col("vendor"), F.col("name"), F.col("exec")
    none = F.array().cast("array<string>")
    cut = F.lit(rules.hash_prefix)
    prefixes = F.filter(F.array(F.substring("digest", 1, rules.hash_prefix)), lambda d: d.isNotNull()) if side == "binary" else F.transform("digests", lambda d: F.substring(d, F.lit(1), cut))
    names = _variants(name)
    if side == "file":
        names = F.when(F.length(name) > 6, F.array_union(names, F.array(F.expr("left(name, length(name) - 2)")))).otherwise(names)
        execs = F.when(F.col("own_exec"), _variants(exe)).otherwise(none)
    else:
        execs = _variants(exe)
    with_vendor = F.when(vendor.isNotNull(), F.transform(names, lambda n: F.concat(vendor, F.lit("|"), n))).otherwise(none)
    with_hash = F.concat(F.transform(prefixes, lambda d: F.concat(d, F.lit("|n|"), name)), F.transform(prefixes, lambda d: F.concat(d, F.lit("|e|"), exe)))
    with_exec = F.array(F.concat(exe, F.lit("|n|"), name), F.concat(exe, F.lit("|v|"), vendor))
    there = lambda keys: F.filter(keys, lambda k: k.isNotNull())
    return F.array_distinct(F.concat(_tag("h", prefixes), _tag("n", names), _tag("v", with_vendor), _tag("e", execs), _tag("c", there(with_hash)), _tag("x", there(with_exec))))


def _proposals(binaries: DataFrame, files: DataFrame, rules: Rules) -> DataFrame:
    """bid, fid, joint of pairs to be scored, and class_a, mult of the classes too large to be expanded.

    joint is what the rarest combined key of a pair says, divided among the files that share
    it. A class row has the evidence of its kind of key, divided among its files; of a record's
    classes of one kind the strongest counts.
    """
    w = rules.weights
    of_files = files.select("fid", F.explode(_keys(files, "file", rules)).alias("key"))
    shared = of_files.groupBy("key").agg(F.count("*").alias("n"))
    # Both branches read the counted keys; a class is one row however many files it has.
    usable = of_files.join(shared.where(F.col("n") <= rules.explicit), "key").select("key", "fid", "n")
    of_binaries = binaries.select("bid", F.explode(_keys(binaries, "binary", rules)).alias("key"))
    kind = F.substring("key", 1, 1)
    evidence = F.when(kind == "h", w["hash"]).when(kind == "n", w["name"]).when(kind == "v", w["name"] + w["vendor_name"]).when(kind == "e", w["exec"]).when(kind == "c", w["hash"] + w["name"]).otherwise(w["name"] + w["exec"])
    joint = F.when(kind.isin("c", "x"), evidence / F.col("n")).otherwise(0.0)
    pairs = of_binaries.join(usable, "key").groupBy("bid", "fid").agg(F.max(joint).alias("joint"))
    large = of_binaries.join(shared.where(F.col("n") > rules.explicit), "key").select("bid", "n", (evidence / F.col("n")).alias("a"), kind.alias("kind"))
    classes = large.groupBy("bid", "kind").agg(F.max(F.struct("a", "n")).alias("c"))
    return pairs.select("bid", "fid", "joint", F.lit(None).cast("double").alias("class_a"), F.lit(1).cast("long").alias("mult")).unionByName(classes.select("bid", F.encode("kind", "utf-8").alias("fid"), F.lit(0.0).alias("joint"), F.col("c.a").alias("class_a"), F.col("c.n").alias("mult")))


def _similar(a: Column, b: Column, rules: Rules) -> Column:
    """1 for equal names, less for one slip of the pen or a cut-off end, little for another edition."""
    far = F.levenshtein(a, b)
    swapped = (far == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    digits = F.regexp_replace(a, r"\D", "") == F.regexp_replace(b, r"\D", "")
    ending = f"({'|'.join(rules.editions)})$"
    edition = (F.regexp_replace(a, ending, "") == b) | (F.regexp_replace(b, ending, "") == a)
    cut = F.startswith(b, a) & (F.length(b) - F.length(a) == 2)
    long = F.greatest(F.length(a), F.length(b)) > 4
    return F.when(a == b, 1.0).when(~digits | edition, 0.3).when(long & ((far == 1) | swapped | cut), 0.85).otherwise(0.0)


def score_pairs(binaries: DataFrame, files: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """bid, fid, path, grp, a, b, mult: every proposed pair with the weight for and against it.

    Class rows have no path and a mult above 1. grp is the thing a record describes: records
    that agree in vendor, name and executable describe the same; one that says too little
    to be told apart describes a thing of its own.
    """
    w = rules.weights
    shares = files.select("fid", F.explode("digests").alias("full")).groupBy("full").agg(F.count("*").alias("n"))
    spread = files.select("fid", F.explode_outer("digests").alias("full")).join(shares, "full", "left").groupBy("fid").agg(F.collect_list(F.struct("full", "n")).alias("contents"))
    told = files.drop("digests").join(spread, "fid", "left")
    # What several files share says as much less about each of them.
    for count, by in (("n_name", ["name"]), ("n_vendor", ["vendor", "name"]), ("n_exec", ["exec"])):
        told = told.join(files.where(F.col(by[0]).isNotNull()).groupBy(*by).agg(F.count("*").alias(count)), by, "left")
    right = told.select("fid", "path", "contents", "n_name", "n_vendor", "n_exec", *[F.col(c).alias(f"f_{c}") for c in ("vendor", "name", "exec", "own_exec")])
    pairs = _proposals(binaries, files, rules).join(binaries, "bid").join(right, "fid", "left")
    held = F.filter("contents", lambda c: c["full"].isNotNull() & F.startswith(c["full"], F.col("digest")))
    has = F.col("digest").isNotNull()
    agrees = has & (F.size(held) > 0)
    by_hash = F.when(agrees, w["hash"] / F.array_min(F.transform(held, lambda c: c["n"]))).otherwise(0.0)
    name = F.when(F.col("name").isNotNull() & F.col("f_name").isNotNull(), _similar(F.col("name"), F.col("f_name"), rules))
    exe = F.when(F.col("exec").isNotNull() & F.col("f_exec").isNotNull(), F.greatest(_similar(F.col("exec"), F.col("f_exec"), rules), F.when(F.concat("exec", F.lit("d")) == F.col("f_exec"), 1.0).otherwise(0.0)))
    vendor = F.when(F.col("vendor").isNotNull() & F.col("f_vendor").isNotNull(), _similar(F.col("vendor"), F.col("f_vendor"), rules))
    named = F.col("name").isNotNull() & F.col("vendor").isNotNull()
    group = F.md5(F.when(named, F.to_json(F.array("vendor", "name", F.coalesce("exec", F.lit(""))))).otherwise(F.concat(F.lit("alone:"), F.col("bid").cast("string"))))
    told = cut_lineage(pairs.select("bid", "fid", "path", "joint", "class_a", "mult", by_hash.alias("hash"), (has & ~agrees).alias("other_hash"), name.alias("n"), exe.alias("e"), vendor.alias("v"), "f_own_exec", "n_name", "n_vendor", "n_exec", group.alias("grp")))
    weight = lambda condition, value: F.when(condition, F.lit(value)).otherwise(F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    by_name = w["name"] * zero(F.col("n") / F.col("n_name"))
    by_vendor = w["vendor_name"] * F.greatest(F.lit(0.0), zero((F.col("n") + F.col("v") - 1) / F.col("n_vendor")))
    by_exec = F.when(F.col("f_own_exec"), F.lit(w["exec"])).otherwise(F.lit(w["exec_shared"])) * zero(F.col("e") / F.col("n_exec"))
    pro = F.greatest(F.col("hash") + by_name + by_vendor + by_exec, F.col("joint"))
    con = w["prior"] + weight(F.col("other_hash"), w["not_hash"]) + weight(F.col("v") < 0.5, w["not_vendor"]) + weight(F.col("n") < 0.2, w["not_name"]) + weight(F.col("e") < 0.5, w["not_exec"])
    single = F.col("class_a").isNull()
    return told.select("bid", "fid", "path", "grp", F.when(single, pro).otherwise(F.col("class_a")).alias("a"), F.when(single, con).otherwise(F.lit(w["prior"])).alias("b"), "mult")


def _own_part(pairs: DataFrame, pull: float) -> DataFrame:
    """Every record's exact minimiser: y of its pairs under sum(mult * y) <= 1.

    ``pull`` weighs the distance to z - u, what the thing says of the pair (classes have no
    such side). With multiplier m of the sum, y = (t - m)+ / h; m is the largest of the values
    that the first k pairs in order of t would need, if positive.
    """
    drawn = F.when(F.col("mult") == 1, F.lit(pull)).otherwise(F.lit(0.0))
    t = 2 * F.col("a") + 2 * drawn * (F.col("z") - F.col("u"))
    h = 2 * F.col("a") + 2 * F.col("b") + 2 * drawn
    order = Window.partitionBy("bid").orderBy(F.desc("t"), "fid").rowsBetween(Window.unboundedPreceding, 0)
    told = pairs.withColumn("t", t).withColumn("h", h)
    told = told.withColumn("need", (F.sum(F.col("mult") * F.col("t") / F.col("h")).over(order) - 1) / F.sum(F.col("mult") / F.col("h")).over(order))
    told = told.withColumn("m", F.greatest(F.lit(0.0), F.max("need").over(Window.partitionBy("bid"))))
    return told.withColumn("y", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("m")) / F.col("h")))).drop("t", "h", "need", "m")


def solve(pairs: DataFrame, same: float | None = None, rho: float = 16.0, rounds: int = 200, tolerance: float = 2e-3) -> DataFrame:
    """bid, fid, path, mult, confidence of every pair by alternating directions.

    ``same`` is the weight of transitivity. RuntimeError if values still move by
    ``tolerance`` after so many rounds. The first round starts from what each record says
    alone; with a copy q of its thing's value eliminated, a record is drawn towards it with
    the weight same * rho / (2 * same + rho).
    """
    same = Rules().weights["same"] if same is None else same
    pull = same * rho / (2 * same + rho)
    zero = F.lit(0.0)
    first = _own_part(pairs.withColumns({"z": zero, "u": zero}), 0.0)
    mean = first.where("mult = 1").groupBy("grp", "fid").agg(F.avg("y").alias("z_new"))
    state = cut_lineage(first.join(mean, ["grp", "fid"], "left").select("bid", "fid", "path", "grp", "a", "b", "mult", F.coalesce("z_new", "y").alias("z"), "u", "y"))
    for _ in range(rounds):
        solved = _own_part(state.withColumnRenamed("y", "y_old"), pull)
        copy = (2 * same * F.col("y") + rho * (F.col("z") - F.col("u"))) / (2 * same + rho)
        solved = solved.withColumn("q", F.when(F.col("mult") == 1, copy).otherwise(F.col("z")))
        mean = solved.where("mult = 1").groupBy("grp", "fid").agg(F.least(F.lit(1.0), F.greatest(zero, F.avg(F.col("q") + F.col("u")))).alias("z_new"))
        joined = solved.join(mean, ["grp", "fid"], "left").withColumn("z_new", F.coalesce("z_new", "z"))
        gap = F.greatest(F.abs(F.col("q") - F.col("z_new")), F.abs(F.col("z_new") - F.col("z")), F.abs(F.col("y") - F.col("y_old")))
        last, state = state, cut_lineage(joined.select("bid", "fid", "path", "grp", "a", "b", "mult", F.col("z_new").alias("z"), (F.col("u") + F.col("q") - F.col("z_new")).alias("u"), "y", gap.alias("gap")))
        discard(last)
        if (state.agg(F.max("gap")).first()[0] or 0.0) < tolerance:
            return state.select("bid", "fid", "path", "mult", F.col("y").alias("confidence"))
    raise RuntimeError("the confidences did not settle; raise rounds or change rho")


def match(binaries: DataFrame, files: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """binary_id, path, confidence: for each inventory row the file it is, if one stands out.

    The best pair counts if its confidence is at least ``rules.accept`` and leads the next by
    ``rules.margin``. Rows without id, files without path, and rows with nothing to compare have
    no match; repeated rows each have one; empty tables give none. Jobs run while the
    result is built.
    """
    # Both descriptions are read several times and are small next to the files they come from.
    told = cut_lineage(describe_binaries(binaries, rules)), cut_lineage(describe_files(files, rules))
    values = solve(score_pairs(*told, rules), rules.weights["same"])
    discard(*told)
    best = Window.partitionBy("bid").orderBy(F.desc("confidence"), "fid")
    ranked = values.withColumn("rank", F.row_number().over(best)).withColumn("next", F.coalesce(F.lead("confidence").over(best), F.lit(0.0)))
    kept = ranked.where((F.col("rank") == 1) & (F.col("mult") == 1) & (F.col("confidence") >= rules.accept) & (F.col("confidence") - F.col("next") >= rules.margin))
    return kept.select(F.col("bid").alias("binary_id"), "path", F.round("confidence", 4).alias("confidence"))


def match_inventory(binaries: DataFrame, files: DataFrame, versions: DataFrame, image_of: dict[str, str], rules: Rules = Rules()) -> DataFrame:
    """``match`` of the inventories' rows with the files of the images they list.

    ``image_of`` names the image (its source_path) of each inventory (its source_path);
    rows of other runs have no match.
    """
    out = None
    for inventory, image in sorted(image_of.items()):
        runs = lambda path: versions.where(F.col("source_path") == path).select(F.col("id").alias("source_version_id"))
        found = match(binaries.join(runs(inventory), "source_version_id", "left_semi"), files.join(runs(image), "source_version_id", "left_semi"), rules)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no inventory is named")
    return out
