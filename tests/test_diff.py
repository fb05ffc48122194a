"""Version comparison: natural keys, nulls, duplicates, order."""

import random

from pyspark.sql import functions as F

from lodeworks.functions.markdown import cell, sanitize, sanitize_column
from lodeworks.operators import diff

KEYED = "id long, k string, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_added_removed_changed(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "n")], KEYED)
    new = spark.createDataFrame([(9, "a", "y"), (8, "b", None), (7, "c", "z"), (6, "c", "z"), (5, None, "n")], KEYED)
    assert rows(diff.added_entities(old, new, ["k"])) == [(6, "c", "z"), (7, "c", "z")]
    assert rows(diff.removed_entities(old, new, ["k"])) == []
    assert rows(diff.changed_entities(old, new, ["k"], "v")) == [("a", "x", "y")]
    assert rows(diff.natural_diff(old, new, ["k"])) == [("added", "c"), ("added", "c")]
    none = old.limit(0)
    assert diff.added_entities(none, new, ["k"]).count() == 5 and diff.removed_entities(none, new, ["k"]).count() == 0


def test_dangerous_is_plain_on_owner(spark):
    old = spark.createDataFrame([(1, 1, None, "root"), (1, 1, "o", "root")], "pair long, id long, owner string, key string")
    got = diff.dangerous_grants(old, old, "owner", "key", ["root"], ["pair"])
    assert [r.owner for r in got.collect()] == [None]


def test_structural_needs_unique_keys(spark):
    old = spark.createDataFrame([(1, "a", "p1"), (2, "b", "q1"), (3, "b", "q2"), (4, "c", "same")], KEYED)
    new = spark.createDataFrame([(5, "a", "p2"), (6, "b", "q3"), (7, "c", "same")], KEYED)
    assert rows(diff.structural_diff(old, new, ["k"], F.col("v"))) == [("a", "p1", "p2")]


def test_files_changed_basis(spark):
    ddl = "path string, sha256 string, size long"
    old = spark.createDataFrame([("hash", "h1", 1), ("same", "h", 1), ("size", None, 1), ("link", None, 5), ("big", "h", 7)], ddl)
    new = spark.createDataFrame([("hash", "h2", 1), ("same", "h", 2), ("size", "h", 2), ("link", None, 5), ("big", None, 7)], ddl)
    assert rows(diff.files_changed(old, new, ["path"])) == [("hash", "sha256", 0), ("size", "size", 1)]


def test_observations(spark):
    subject = spark.createDataFrame([(1, "one"), (2, None)], "id long, label string")
    ddl = "entity_table string, entity_id long, event_type string, observed_at string"
    old = spark.createDataFrame([("t", 1, "e", "1"), ("t", 7, "e", "1"), ("u", 1, "e", "1"), ("t", 2, "e", "1")], ddl)
    new = spark.createDataFrame([("t", 1, "e", "1"), ("t", 1, "e", "2"), ("t", 1, "e", "2"), ("t", 7, "e", "1")], ddl)
    keyed = [diff.keyed_observations(x, [diff.Subject("t", subject, "id", "label")]) for x in (old, new)]
    assert rows(diff.observation_diff(*keyed)) == [("added", "t", "id:7", "e", "1"), ("added", "t", "one", "e", "2"), ("removed", "t", "id:7", "e", "1"), ("removed", "u", "id:1", "e", "1")]


def test_observations_of_each_pair(spark):
    subject = spark.createDataFrame([(1, "one")], "id long, label string")
    ddl = "pair_id long, entity_table string, entity_id long, event_type string, observed_at string"
    # Snapshots 1, 2, 3 of which only the middle one has the observation: it comes in pair 2 and goes in pair 3.
    old = spark.createDataFrame([(3, "t", 1, "e", "1")], ddl)
    new = spark.createDataFrame([(2, "t", 1, "e", "1")], ddl)
    keyed = [diff.keyed_observations(x, [diff.Subject("t", subject, "id", "label")], ("pair_id",)) for x in (old, new)]
    assert rows(diff.observation_diff(*keyed, ("pair_id",))) == [("added", 2, "t", "one", "e", "1"), ("removed", 3, "t", "one", "e", "1")]


def test_observation_query_compares_within_pairs(spark, tmp_path):
    from lodeworks.plans.diffs import d09_observation_diff

    runs = "id long, source_path string, started_at string, completed_at string"
    spark.createDataFrame([(i, "img", f"2026-01-0{i}", "done") for i in (1, 2, 3)], runs).write.parquet(str(tmp_path / "versions.parquet"))
    spark.createDataFrame([(7, "tool")], "id long, executable_name string").write.parquet(str(tmp_path / "binaries.parquet"))
    daemons = spark.createDataFrame([(1, 2, 7, "boot", "t")], "id long, source_version_id long, binary_id long, session_type string, observed_time string")
    for c in ("label", "program", "plist_path", "user_name", "group_name", "sandbox_profile", "run_at_load"):
        daemons = daemons.withColumn(c, F.lit("x"))
    daemons.write.parquet(str(tmp_path / "daemons.parquet"))
    assert rows(d09_observation_diff(spark, str(tmp_path)).select("side", "pair_id", "natural_key")) == [("added", 2, "tool"), ("removed", 3, "tool")]


def test_resolution(spark):
    ddl = "id long, entity_type string, canonical_key string, atom_count long, score double"
    old = spark.createDataFrame([(1, "f", "a", 2, 0.9), (2, "f", "b", 2, 0.9), (3, "f", None, 1, None), (4, "f", "d", 1, None), (5, "f", "d", 3, None)], ddl)
    new = spark.createDataFrame([(1, "f", "a", 3, 0.9), (9, "f", "c", 2, 0.9), (5, "f", "d", 3, None)], ddl)
    assert [r[:3] for r in rows(diff.resolution_diff(old, new))] == [("added", "f", "c"), ("changed", "f", "a"), ("removed", "f", "b")]


def test_insertion_order_changes_nothing(spark):
    rng = random.Random(1337)
    data = [(i, f"k{i}", f"v{i}") for i in range(50)]
    mixed = data[:]
    rng.shuffle(mixed)
    mixed = [(1000 + i, k, v) for i, (_, k, v) in enumerate(mixed)]
    a, b = spark.createDataFrame(data, KEYED), spark.createDataFrame(mixed, KEYED)
    assert diff.natural_diff(a, b, ["k", "v"]).count() == 0 and diff.changed_entities(a, b, ["k"], "v").count() == 0


def test_report_and_markdown(spark):
    from lodeworks import schema

    old, new = schema.empty(spark), schema.empty(spark)
    new["files"] = schema.conform(spark.createDataFrame([(1, "/a|b`\x1b", 3)], "id long, path string, size long"), "files")
    report = diff.Differ(old, new).generate_report()
    assert "addition /a\\|b\\x60\\x1b" in report and "daemons" not in report
    hostile = "a\\|`\x00\x7f\x9bé"
    assert spark.createDataFrame([(hostile,)], "t string").select(sanitize_column(F.col("t"))).first()[0] == sanitize(hostile)
    assert [r[0] for r in spark.createDataFrame([("x" * 61,), (None,), ("x" * 60,)], "t string").select(cell(F.col("t"))).collect()] == ["x" * 57 + "...", "", "x" * 60]


def test_moves_of_each_pair(spark):
    # One content at /a, /b and /b in snapshots 1, 2, 3: it moves in pair 2 only.
    ddl = "pair_id long, path string, sha256 string, size long"
    old = spark.createDataFrame([(2, "/a", "h", 1), (3, "/b", "h", 1)], ddl)
    new = spark.createDataFrame([(2, "/b", "h", 1), (3, "/b", "h", 1)], ddl)
    differ = diff.Differ({"files": old}, {"files": new}, ("pair_id",))
    moves = differ.unified().where("result = 'files_moved'")
    assert rows(moves.select("key", "old_value", "new_value")) == [("2|h", "/a", "/b")]
    assert rows(differ.summary()) == [("files_added", "addition", 1), ("files_moved", "structural", 1), ("files_removed", "deletion", 1)]


def test_upsert(spark):
    there = spark.createDataFrame([(1, "a", "old")], KEYED)
    more = spark.createDataFrame([(2, "a", "new"), (4, "b", "late"), (3, "b", "first"), (5, None, "n"), (6, None, "n")], KEYED)
    got = rows(diff.upsert_ignore(there, more, ["k"], [F.col("id")]).fillna("-"))
    assert got == [(1, "a", "old"), (3, "b", "first"), (5, "-", "n"), (6, "-", "n")]


def test_full_diff_compares_no_surrogate_ids(spark):
    """Two workspaces equal but for their ids have no change; one real change per table shows once."""
    from lodeworks import schema

    def space(shift, extra=False):
        t = schema.empty(spark)
        files = [(1 + shift, "/app", "h1", 5), (2 + shift, "/big", None, 9)] + ([(3 + shift, "/new", "h3", 1)] if extra else [])
        put = {
            "files": ("id long, path string, sha256 string, size long", files),
            "binaries": ("id long, file_id long, bundle_id string, executable_name string", [(50 + shift, 1 + shift, "com.app", "app")]),
            "entitlements": ("id long, binary_id long, key string, value string", [(7 + shift, 50 + shift, "k", "v")] + ([(8 + shift, 50 + shift, "k2", None)] if extra else [])),
            "sandbox_profiles": ("id long, name string", [(3 + shift, "p"), (4 + shift, "q")]),
            "sandbox_rules": ("id long, profile_id long, operation string, action string", [(1 + shift, (4 if extra else 3) + shift, "read", "deny")]),
            "daemons": ("id long, label string, program string", [(9 + shift, "d", "/app")]),
            "mach_services": ("id long, daemon_id long, service_name string", [(1 + shift, 9 + shift, "s")] + ([(2 + shift, 9 + shift, "s2")] if extra else [])),
            "observations": ("id long, entity_table string, entity_id long, event_type string, observed_at string", [(1, "binaries", 50 + shift, "seen", "t"), (2, "daemons", 9 + shift, "late" if extra else "seen", "t")]),
            "bags": ("id long, entity_type string, canonical_key string, atom_count long, score double", [(1 + shift, "files", "b", 3 if extra else 2, 0.9)]),
        }
        for name, (ddl, data) in put.items():
            t[name] = schema.conform(spark.createDataFrame(data, ddl), name)
        return t

    assert diff.Differ(space(0), space(1000)).unified().count() == 0
    got = rows(diff.Differ(space(0), space(1000, extra=True)).unified().fillna("-"))
    assert got == sorted([
        ("files_added", "addition", "/new", "-", "-"),
        ("entitlements", "addition", "com.app|k2|", "-", "-"),
        ("sandbox_rules", "addition", "q|read|deny||", "-", "-"),
        ("sandbox_rules", "deletion", "p|read|deny||", "-", "-"),
        ("mach_services", "addition", "d|s2", "-", "-"),
        ("structural", "structural", "sandbox_rule_reassigned|read:deny", "p", "q"),
        ("observations", "addition", "daemons|d|late|t", "-", "-"),
        ("observations", "deletion", "daemons|d|seen|t", "-", "-"),
        ("resolution", "resolution", "files|b", "2|0.900000", "3|0.900000"),
    ])
