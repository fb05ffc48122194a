"""P1 operator: against brute force, and its edge cases."""

import random

from lodeworks.operators.snapshot_changes import snapshot_changes, snapshot_sequence

STATES = "version_id long, natural_key string, digest string, size long"
VERSIONS = "id long, source_path string, started_at string, completed_at string"


def brute(states, versions):
    runs = {}
    for v, source, start, end in versions:
        if end and end.strip() and source and start:
            runs.setdefault(source, []).append((start, v))
    held = {}
    for v, key, digest, size in states:
        if key:
            d, s = held.setdefault(v, {}).get(key, (None, None))
            held[v][key] = (max(filter(None, (d, digest)), default=None), max((x for x in (s, size) if x is not None), default=None))
    out = set()
    for chain in runs.values():
        order = [v for _, v in sorted(chain)]
        for old, new in zip(order, order[1:]):
            a, b = held.get(old, {}), held.get(new, {})
            out |= {(k, old, new, "added") for k in b.keys() - a.keys()} | {(k, old, new, "removed") for k in a.keys() - b.keys()}
            for k in a.keys() & b.keys():
                (d1, s1), (d2, s2) = a[k], b[k]
                if (d1 != d2) if d1 and d2 else s1 != s2:
                    out.add((k, old, new, "changed"))
    return out


def run(spark, states, versions, partitions=3):
    df = snapshot_changes(spark.createDataFrame(states, STATES), snapshot_sequence(spark.createDataFrame(versions, VERSIONS)), partitions)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark):
    rng = random.Random(7)
    versions = [(i, rng.choice(["a", "b"]), f"2025-01-{i:02d}T00:00:00Z", None if i == 4 else "x") for i in range(1, 10)]
    states = [(rng.randint(1, 10), f"k{rng.randint(0, 40)}", rng.choice([None, "d1", "d2"]), rng.choice([None, 0, 5])) for _ in range(900)]
    assert run(spark, states, versions) == brute(states, versions)


def test_many_batches(spark):
    versions = [(1, "a", "2025-01-01T00:00:00Z", "x"), (2, "a", "2025-01-02T00:00:00Z", "x")]
    states = [(v, f"k{i:05d}", "d", i + (v if i % 3 == 0 else 0)) for i in range(3000) for v in (1, 2) if i % (4 + v)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run(spark, states, versions, 2) == brute(states, versions)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    versions = [(1, "a", "2025-01-01T00:00:00Z", "x"), (2, "a", "2025-01-02T00:00:00Z", "x"), (3, "a", "2025-01-03T00:00:00Z", " ")]
    assert run(spark, [], versions) == set()
    assert run(spark, [(1, None, None, None), (1, "", "d", 1), (3, "z", "d", 1), (99, "z", "d", 1)], versions) == set()
    hot = [(1, "hot", "d", 1)] * 500 + [(2, "hot", "e", 1)] * 500
    assert run(spark, hot, versions) == {("hot", 1, 2, "changed")}
    long = "x" * 50_000
    assert run(spark, [(2, long, None, None)], versions) == {(long, 1, 2, "added")}
    assert run(spark, [(1, "n", None, None), (2, "n", None, 0)], versions) == {("n", 1, 2, "changed")}


def test_extra_columns_with_clashing_names(spark):
    versions = spark.createDataFrame([(1, "a", "2025-01-01T00:00:00Z", "x", "q"), (2, "a", "2025-01-02T00:00:00Z", "x", "q")], VERSIONS + ", seq string")
    states = spark.createDataFrame([(1, "k", 5, "s", "p")], "version_id long, natural_key string, seq int, series_id string, prev_id string")
    assert [tuple(r) for r in snapshot_changes(states, snapshot_sequence(versions)).collect()] == [("k", 1, 2, "removed")]
