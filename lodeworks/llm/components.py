"""One group identifier for every record linked directly or through others.

Each round lets every vertex take the smallest label among itself and its neighbours
(minimum-label propagation), shortens the resulting chains of labels by pointer jumping
until they are stars, and contracts the edges to the labels. The label map and the
contracted edges are written every round; the loop ends when no edge is left, that is, when
no label would change. Labels only ever fall and chains only ever shorten, so both loops end.

Scale: all steps are aggregations with map-side combine and equi-joins. A hub that holds
a third of all pairs is one row per map task after the partial minimum; on the join sides
its copies are spread by the other endpoint (``distinct`` after contraction removes most)
and adaptive execution splits what is left: in every join the label side has one row per
vertex, so that the hot side may be split without repeating more than that row. Nothing but
counters reaches the driver, and they come with the writes, without jobs of their own.
The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodeworks.session import cut_lineage, discard

#: Hops along a chain that one written table takes.
HOPS = 3


def _written(df: DataFrame, count: Column) -> tuple[DataFrame, int]:
    """The rows as a written table, and how many of them ``count`` holds for."""
    seen = Observation()
    frame = cut_lineage(df.observe(seen, F.coalesce(F.sum(count.cast("long")), F.lit(0)).alias("n")))
    return frame, seen.get["n"]


def _jump(labels: DataFrame) -> DataFrame:
    """Pointer jumping: (kind, v, l, moved) with l replaced by the label of l until nothing changes."""
    while True:
        target = labels.where(F.col("v") != F.col("l")).select(F.col("kind").alias("_k"), F.col("v").alias("_v"), F.col("l").alias("_l"))
        stepped = labels.select("kind", "v", F.col("l").alias("first"), "l")
        for _ in range(HOPS):
            joined = stepped.join(target, (F.col("kind") == F.col("_k")) & (F.col("l") == F.col("_v")), "left")
            stepped = joined.select("kind", "v", "first", F.coalesce("_l", "l").alias("l"))
        moved = F.col("first") != F.col("l")
        last = labels
        labels, changes = _written(stepped.select("kind", "v", "l", moved.alias("moved")), F.col("moved"))
        discard(last)
        if not changes:
            return labels


def _relabel(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``column`` replaced by its label where it has one."""
    to = labels.select(F.col("kind").alias("_k"), F.col("v").alias("_v"), F.col("l").alias("_l"))
    joined = df.join(to, (F.col("kind") == F.col("_k")) & (F.col(column) == F.col("_v")), "left")
    return joined.select(*[F.coalesce("_l", column).alias(c) if c == column else F.col(c) for c in df.columns])


def connected_components(pairs: DataFrame, a: str = "atom_a", b: str = "atom_b", kind: str | None = "entity_type") -> DataFrame:
    """(kind, group_id, atom_id) of every record in a group of two or more.

    group_id is the smallest id of the group, which is listed too. Kinds never mix. Pairs
    in either order, repeated pairs and pairs of a record with itself change nothing; a
    null id or kind makes no pair. No pairs give an empty result. Jobs run while the result
    is built; what is left of them is one written table, which ``discard`` deletes.
    """
    kinds = F.col(kind) if kind else F.lit("")
    known = pairs.select(kinds.cast("string").alias("kind"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("kind IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b")
    every = F.lit(True)
    edges, left = _written(known.select("kind", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), every)
    maps: list[DataFrame] = []
    while left:
        both = edges.unionByName(edges.select("kind", F.col("y").alias("x"), F.col("x").alias("y")))
        smallest = both.groupBy("kind", F.col("x").alias("v")).agg(F.min("y").alias("m"))
        labels = _jump(cut_lineage(smallest.select("kind", "v", F.least("v", "m").alias("l"))))
        maps.append(labels)
        moved = _relabel(_relabel(edges, "x", labels), "y", labels).where(F.col("x") != F.col("y"))
        last = edges
        edges, left = _written(moved.select("kind", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), every)
        discard(last)
    if not maps:
        return edges.select("kind", F.col("x").alias("group_id"), F.col("y").alias("atom_id"))
    # Later maps speak of labels of earlier ones, so they are followed from first to last.
    final = reduce(lambda done, later: _relabel(done, "l", later), maps[1:], maps[0])
    if len(maps) > 1:
        final = cut_lineage(final)
        discard(*maps)
    discard(edges)
    groups = final.select("kind", F.col("l").alias("group_id"), F.col("v").alias("atom_id"))
    groups._lodeworks_path = final._lodeworks_path
    return groups


def linked_groups(candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """entity_type, group_id, atom_id over the scored pairs at or above ``threshold``.

    A pair stored several times links if any of its scores suffices; null and NaN scores
    do not link.
    """
    score = F.col("score")
    strong = candidates.where(score.isNotNull() & ~F.isnan(score) & (score >= threshold))
    return connected_components(strong).select(F.col("kind").alias("entity_type"), "group_id", "atom_id")
