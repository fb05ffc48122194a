"""How good a resolution is: perturbed copies with known clusters, pairwise metrics, thresholds.

Pairs are never listed: with n atoms per (true cluster, bag) cell, the pairs that agree are
sums of n * (n - 1) / 2 over cells, clusters and bags, three aggregations of the labelled
atoms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators import cluster

#: Mutations that use up a base atom, and those that add foreign ones.
CONSUMING = ("identical", "move", "recompile", "rename", "drop")
FOREIGN = ("new", "confusable", "confusable_strong")
#: Share of base atoms per mutation (fixed values), and which give way when there are too few.
RATIOS = {"identical": 0.30, "move": 0.20, "recompile": 0.20, "rename": 0.15, "drop": 0.05, "new": 0.10, "confusable": 0.10, "confusable_strong": 0.08}
GIVE_WAY = ("drop", "rename", "recompile", "move", "identical")


def default_plan(base: int) -> dict[str, int]:
    """At least one of each mutation, together not more than there are base atoms.

    The consuming ones give way in the order of ``GIVE_WAY``; those left with none are not listed.
    Without base atoms nothing can be confused with one.
    """
    plan = {m: max(1, round(base * r)) for m, r in RATIOS.items()}
    if base < 1:
        plan["confusable"] = 0
    excess = sum(plan[m] for m in CONSUMING) - base
    for m in GIVE_WAY:
        cut = min(plan[m], max(0, excess))
        plan[m] -= cut
        excess -= cut
    return {m: n for m, n in plan.items() if n}


def perturb(base: DataFrame, plan: dict[str, int], seed: int = 0) -> DataFrame:
    """Base atoms and their mutated copies: id, cluster_id, mutation, executable_name, arch, path, sha256.

    Base atoms are taken in an order that only the seed decides. A consuming mutation
    stays in its base atom's cluster; new and confusable atoms are clusters of their own.
    ValueError if the plan uses more base atoms than there are.
    """
    unknown = set(plan) - set(CONSUMING) - set(FOREIGN)
    if unknown:
        raise ValueError(f"unknown mutations: {sorted(unknown)}")
    used = sum(plan.get(m, 0) for m in CONSUMING)
    borrowed = max(plan.get("confusable", 0), plan.get("confusable_strong", 0))
    total = base.count()
    if used > total or borrowed > total:
        raise ValueError("the plan uses more base atoms than there are")
    fields = ("executable_name", "arch", "path", "sha256")
    lot = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")))
    # Numbered in the order of the lots: within buckets of their first digits, behind all earlier buckets.
    drawn = base.select("id", *fields, lot.alias("lot")).withColumn("bucket", F.substring("lot", 1, 4))
    earlier = F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = drawn.groupBy("bucket").agg(F.count("*").alias("size")).withColumn("before", earlier)  # at most 16^4 rows
    numbered = drawn.join(buckets, "bucket").withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("lot", "id")))
    placed = numbered.where(F.col("n") <= max(used, borrowed)).drop("bucket", "size", "before")
    out = base.select("id", F.col("id").alias("cluster_id"), F.lit("base").alias("mutation"), *fields)
    top = base.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1

    def add(rows: DataFrame, mutation: str, code: int, own_cluster: bool, change: dict[str, Column]) -> None:
        nonlocal out
        fresh = (F.lit(top) + F.col("n") * 10 + code).cast("long")
        new = rows.select(fresh.alias("id"), (fresh if own_cluster else F.col("id")).alias("cluster_id"), F.lit(mutation).alias("mutation"), *[change.get(f, F.col(f)).alias(f) for f in fields])
        out = out.unionByName(new)

    start = 0
    other_hash = F.sha2(F.concat_ws("|", "sha256", F.col("n").cast("string"), F.lit("other")), 256)
    changes = {
        "identical": {},
        "move": {"path": F.concat(F.lit("/moved"), F.col("path"))},
        "recompile": {"sha256": other_hash},
        "rename": {"executable_name": F.concat("executable_name", F.lit("_renamed")), "path": F.concat("path", F.lit("_renamed"))},
    }
    for code, mutation in enumerate(CONSUMING):
        count = plan.get(mutation, 0)
        if mutation != "drop" and count:
            add(placed.where(F.col("n").between(start + 1, start + count)), mutation, code, False, changes[mutation])
        start += count
    if count := plan.get("confusable", 0):
        add(placed.where(F.col("n") <= count), "confusable", 6, True, {"sha256": other_hash, "path": F.concat(F.lit("/elsewhere/"), F.col("n").cast("string"), F.lit("/x")), "arch": F.lit("other")})
    if count := plan.get("confusable_strong", 0):
        add(placed.where(F.col("n") <= count), "confusable_strong", 7, True, {"sha256": other_hash})
    if count := plan.get("new", 0):
        spark = base.sparkSession
        fresh = spark.range(1, count + 1).select(F.col("id").alias("n"), F.concat(F.lit("new_"), F.col("id").cast("string")).alias("executable_name"), F.lit("arm64").alias("arch"), F.concat(F.lit("/new/"), F.col("id").cast("string")).alias("path"), F.sha2(F.concat(F.lit(f"{seed}|new|"), F.col("id").cast("string")), 256).alias("sha256"))
        add(fresh.withColumn("id", F.col("n")), "new", 8, True, {})
    return out


def _pairs(n: Column) -> Column:
    return F.coalesce(F.sum(n * (n - 1) / 2).cast("long"), F.lit(0).cast("long"))


def pair_metrics(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of (atom_id, cluster_id, bag_id), per group ``by``.

    An atom without bag counts as a bag of its own. Precision and recall are 1 where there
    was nothing to get wrong, f1 is 0 where both are 0.
    """
    by = by or []
    bag = F.coalesce(F.concat(F.lit("b"), F.col("bag_id").cast("string")), F.concat(F.lit("a"), F.col("atom_id").cast("string")))
    cells = labelled.groupBy(*by, "cluster_id", bag.alias("bag")).agg(F.count("*").alias("n"))
    one = F.lit(1).alias("_one")

    def total(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*by, one).agg(_pairs(F.col("n")).alias(name))

    tp = total(cells, "tp")
    same_bag = total(cells.groupBy(*by, "bag").agg(F.sum("n").alias("n")), "in_bag")
    same_cluster = total(cells.groupBy(*by, "cluster_id").agg(F.sum("n").alias("n")), "in_cluster")
    keys = [*by, "_one"]
    both = tp.join(same_bag, keys).join(same_cluster, keys)
    fp, fn = F.col("in_bag") - F.col("tp"), F.col("in_cluster") - F.col("tp")
    precision = F.when(F.col("in_bag") > 0, F.col("tp") / F.col("in_bag")).otherwise(1.0)
    recall = F.when(F.col("in_cluster") > 0, F.col("tp") / F.col("in_cluster")).otherwise(1.0)
    told = both.select(*by, "tp", fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), recall.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return told.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def mutation_recall(labelled: DataFrame) -> DataFrame:
    """Per consuming mutation: copies, and how many share a bag with their base atom."""
    base = labelled.where("mutation = 'base'").select("cluster_id", F.col("bag_id").alias("base_bag"))
    copies = labelled.where(F.col("mutation").isin(*CONSUMING)).join(base, "cluster_id")
    return copies.groupBy("mutation").agg(F.count("*").alias("copies"), F.sum((F.col("bag_id") == F.col("base_bag")).cast("long")).alias("found"))


def false_merges(labelled: DataFrame) -> int:
    """Confusable atoms that ended in a bag with atoms of other clusters."""
    bags = labelled.where("bag_id IS NOT NULL").groupBy("bag_id").agg(F.count_distinct("cluster_id").alias("n"))
    return labelled.where(F.col("mutation").isin("confusable", "confusable_strong")).join(bags.where("n > 1"), "bag_id", "left_semi").count()


def sweep(labels: DataFrame, scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold and pair metrics: scored once, clustered for all thresholds in one run.

    labels: atom_id, cluster_id; scored: atom_a, atom_b, score.
    """
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    links = scored.select("atom_a", "atom_b", "score", at).where("score >= threshold")
    groups = cluster.cluster(links.withColumn("k", F.col("threshold").cast("string")), kind="k")
    every = labels.select("atom_id", "cluster_id", at).withColumn("kind", F.col("threshold").cast("string"))
    labelled = every.join(groups.withColumnRenamed("cluster_id", "bag_id"), ["kind", "atom_id"], "left").drop("kind")
    return pair_metrics(labelled, ["threshold"])


def recommend_threshold(metrics: DataFrame) -> DataFrame:
    """The threshold of the best f1, the higher one of equals."""
    return metrics.orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def calibrate_threshold(metrics: DataFrame, min_precision: float = 0.95) -> DataFrame:
    """The lowest threshold that reaches the precision, else the most precise (higher of equals)."""
    reaches = F.col("precision") >= min_precision
    return metrics.orderBy(F.desc(reaches), F.when(reaches, F.col("threshold")), F.desc("precision"), F.desc("threshold")).limit(1)
