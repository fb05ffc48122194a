"""Connected components of scored pairs, by alternating large and small stars.

A large-star step links every larger neighbour of a vertex to its smallest neighbour, a
small-star step links a vertex and its smaller neighbours to the smallest of them. The
edges turn into stars around the smallest id of each component after a logarithmic number
of rounds. Each step is one window over the vertex; lineage is cut by a
reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.session import cut_lineage, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (k, u, v), u > v."""
    near = edges.unionByName(edges.select("k", F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    seen = near.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("k", "u"))))
    if large:
        return seen.where("v > u").select("k", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # The smallest neighbour's own edge is the vertex's.
    return seen.select("k", F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def cluster(pairs: DataFrame, a: str = "atom_a", b: str = "atom_b", kind: str | None = None, rounds: int = 60) -> DataFrame:
    """(kind, cluster_id, atom_id) of every atom in a component of two or more; the id is its smallest atom.

    Pairs with a null end or with equal ends link nothing.
    """
    k = F.col(kind).cast("string") if kind else F.lit("")
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut_lineage(known.select(k.alias("k"), F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("k IS NOT NULL"))
    before = None
    for _ in range(rounds):
        last, edges = edges, cut_lineage(_star(_star(edges, True), False))
        discard(last)
        # Order-free fingerprint of the edges: equal twice in a row means settled.
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("k", "u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle; raise rounds")
    leaves = edges.select("k", F.col("v").alias("cluster_id"), F.col("u").alias("atom_id"))
    roots = edges.select("k", F.col("v").alias("cluster_id"), F.col("v").alias("atom_id")).distinct()
    return leaves.unionByName(roots).withColumnRenamed("k", "kind")
