"""P4 operator: against union-find, with chains, stars and dirt."""

import random

from lodeworks.llm.components import connected_components, linked_groups

PAIRS = "entity_type string, atom_a long, atom_b long"


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, a, b in pairs:
        if k is not None and a is not None and b is not None and a != b:
            x, y = find((k, a)), find((k, b))
            parent[max(x, y)] = min(x, y)
    return {(k, find((k, v))[1], v) for k, v in parent}


def run(spark, pairs):
    rows = [tuple(r) for r in connected_components(spark.createDataFrame(pairs, PAIRS)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_shapes(spark):
    rng = random.Random(11)
    chain = list(range(200))
    rng.shuffle(chain)
    pairs = [("c", a, b) for a, b in zip(chain, chain[1:])]
    pairs += [("up", i, i + 1) for i in range(150)] + [("star", 999, i) for i in range(300)] + [("low", 0, i) for i in range(1, 50)]
    pairs += [("r", rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    pairs += [("r", 5, 5), ("r", None, 3), (None, 1, 2), ("c", chain[0], chain[1]), ("c", chain[1], chain[0])]
    assert run(spark, pairs) == union_find(pairs)


def test_empty_and_self_pairs(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", 1, 1), ("a", None, None)]) == set()
    assert run(spark, [("a", -3, 2**40)]) == {("a", -3, -3), ("a", -3, 2**40)}


def test_scores(spark):
    rows = [("a", 1, 2, 0.85, "x"), ("a", 2, 3, 0.8499, "x"), ("a", 4, 3, None, "x"), ("a", 3, 2, float("nan"), "x"), ("a", 5, 6, 0.1, "x"), ("a", 6, 5, 0.9, "x"), ("b", 1, 9, 0.99, "x")]
    df = spark.createDataFrame(rows, PAIRS + ", score double, kind string")
    assert {tuple(r) for r in linked_groups(df).collect()} == {("a", 1, 1), ("a", 1, 2), ("a", 5, 5), ("a", 5, 6), ("b", 1, 1), ("b", 1, 9)}
