"""Matching, clustering, resolution and evaluation: the numeric expectations."""

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import cluster, evaluate, matching, resolver


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_comparators(spark):
    c = lambda f, a, b: one(spark, matching.COMPARATORS[f](F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert c("token_jaccard", "a b c", "b c d") == 0.5
    assert [c("path_suffix", a, b) for a, b in (("/a/x", "/b/x"), ("/a/x", "/a/y"), ("/a/X", "/b/x"), ("C:\\a\\x", "/b/x"))] == [1.0, 0.0, 1.0, 1.0]
    assert c("numeric_close", "100", "110") == pytest.approx(0.909090909) and c("numeric_close", "1", "1000000") < 0.01
    assert c("numeric_close", "x", "1") == 0.0 and c("numeric_close", "0", "0") == 1.0
    assert c("exact", "A", "a") == 0.0 and c("norm_equal", " A", "a") == 1.0 and c("exact", None, "a") == 0.0
    assert c("ratio", "abcd", "abce") == 0.75


FIELDS = "id long, source_version_id long, source_key string, executable_name string, sha256 string, path string, arch string"


def atoms(spark, *rows):
    return spark.createDataFrame(rows, FIELDS)


def test_score_without_shared_field(spark):
    a = atoms(spark, (1, 1, "a", "x", None, None, None), (2, 1, "b", None, "h", None, None))
    pair = spark.createDataFrame([(1, 2)], "atom_a long, atom_b long")
    assert tuple(matching.score_pairs(pair, a, "binaries").first()) == (1, 2, 0.0, "{}")
    with pytest.raises(KeyError):
        matching.score_columns("nothing")


def test_blocking(spark):
    a = spark.createDataFrame([(i, "n" if i < 6 else "", "x") for i in range(1, 9)], "id long, name string, other string")
    assert matching.bucket_pairs(a, ["name"]).count() == 10
    assert matching.bucket_pairs(a, ["name"], cap=4).count() == 0 and matching.bucket_overflow(a, ["name"], 4).collect()[0].n == 5
    split = a.withColumn("half", F.col("id") % 2)
    assert matching.bucket_pairs(split, ["name"], cap=4, refine=["half"]).count() == 4


def test_token_blocking_is_asymmetric_and_complete(spark):
    rows = [(i, "t", f"shared n{i}", "{}") for i in range(1, 12)]
    a = spark.createDataFrame(rows, "id long, entity_type string, source_key string, properties string")
    got = {tuple(r) for r in matching.token_pairs(a, cap=3).collect()}
    want = set()
    for i in range(1, 12):
        want |= {(min(i, j), max(i, j)) for j in [j for j in range(1, 12) if j != i][:3]}
    assert got == want


def test_clusters(spark):
    p = spark.createDataFrame([(5, 4), (4, 9), (9, 1), (7, 7), (20, 30), (None, 3)], "atom_a long, atom_b long")
    assert sorted((r.cluster_id, r.atom_id) for r in cluster.cluster(p).collect()) == [(1, 1), (1, 4), (1, 5), (1, 9), (20, 20), (20, 30)]
    assert cluster.cluster(p.limit(0)).count() == 0


def test_exact(spark):
    a = spark.createDataFrame([(1, " A@x "), (2, "a@X"), (3, "b@x"), (4, None)], "id long, email string")
    done = resolver.resolve(a, ["email"], "identity")
    assert done.counts == {"merges": 1, "atoms_resolved": 3}
    assert sorted((r.canonical_key or "", r.atom_count) for r in done.bags.collect()) == [("", 1), ("a@x", 2)]
    assert [r.id for r in resolver.unresolved_atoms(a, done.bag_atoms).collect()] == [4]
    b = spark.createDataFrame([(1, "A", "T"), (2, "a", "t")], "id long, email string, tenant string")
    assert resolver.resolve(b, ["email", "tenant"], "identity").bags.first().canonical_key == "a|t"


def test_scored_chain(spark):
    a = atoms(spark, (1, 1, "x", "x", "h", "/a/x", None), (2, 2, "x", "x", "h", "/b/y", None), (3, 2, "x", "x", None, "/b/y", None), (4, 1, "z", "z", "q", "/z", None))
    low = resolver.resolve_scored(a, "binaries", 0.5, blocking=[["executable_name"]])
    scores = {(r.atom_a, r.atom_b): r.score for r in low.candidates.collect()}
    assert scores[1, 2] == pytest.approx(5 / 6) and scores[1, 3] == pytest.approx(2 / 3) and scores[2, 3] == pytest.approx(1.0)
    bag = low.bags.where("atom_count = 3").first()
    assert (bag.id, bag.canonical_key) == (1, "x") and bag.score == pytest.approx((5 / 6 + 2 / 3 + 1) / 3)
    assert low.counts == {"clusters": 1, "merges": 3, "atoms_resolved": 3}
    assert sorted(r.event_type for r in low.events.collect()) == ["create", "create", "resolve"]
    high = resolver.resolve_scored(a, "binaries", 0.99, blocking=[["executable_name"]])
    assert high.counts["merges"] == 1
    with pytest.raises(ValueError):
        resolver.resolve_scored(a, "binaries", 1.5)


def test_bags(spark):
    s = resolver.Resolution.empty(spark)
    s = resolver.create_bag(resolver.create_bag(s, "t", [1, 2], "k"), "t", [2, 3])
    m = resolver.merge_bags(s, spark.createDataFrame([(1, 2)], "survivor long, loser long"))
    assert sorted(tuple(r) for r in m.bag_atoms.collect()) == [(1, 1), (1, 2), (1, 3)]
    assert [(r.id, r.canonical_key, r.atom_count) for r in m.bags.collect()] == [(1, "k", 3)]
    assert {(r.event_type, r.bag_id) for r in m.events.collect()} == {("create", 1), ("merge", 1)}
    p = resolver.split_bag(m, 1, [3])
    assert sorted((r.id, r.atom_count) for r in p.bags.collect()) == [(1, 2), (2, 1)]
    a = spark.createDataFrame([(1, 1, "t", "k", "{}")], "id long, source_version_id long, entity_type string, source_key string, properties string")
    assert resolver.ingest_atom(a, 1, "t", "other", "{}").count() == 2
    with pytest.raises(ValueError):
        resolver.ingest_atom(a, 1, "t", "k", "{}")


def base(spark, n):
    return spark.createDataFrame([(i, f"e{i}", "arm64", f"/b/e{i}", f"h{i}") for i in range(1, n + 1)], "id long, executable_name string, arch string, path string, sha256 string")


def test_perturbation(spark):
    got = evaluate.perturb(base(spark, 3), {"identical": 2, "new": 1, "drop": 1})
    assert got.count() == 6
    assert sorted(r["count"] for r in got.groupBy("cluster_id").count().collect()) == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        evaluate.perturb(base(spark, 3), {"identical": 4})
    with pytest.raises(ValueError):
        evaluate.perturb(base(spark, 3), {"melt": 1})


def test_strong_confusable_merges_only_at_low_threshold(spark):
    world = evaluate.perturb(base(spark, 4), {"confusable_strong": 1}).withColumn("source_key", F.col("executable_name"))
    for threshold, wrong in ((0.5, 1), (0.85, 0)):
        done = resolver.resolve_scored(world, "binaries", threshold, blocking=[["executable_name"]])
        labelled = world.join(done.bag_atoms.withColumnRenamed("atom_id", "id"), "id")
        assert evaluate.false_merges(labelled) == wrong


def test_metrics(spark):
    ddl = "atom_id long, cluster_id long, bag_id long"
    perfect = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, None)], ddl)
    assert tuple(evaluate.pair_metrics(perfect).first()) == (1, 0, 0, 1.0, 1.0, 1.0)
    bad = spark.createDataFrame([(1, 1, 1), (2, 2, 1)], ddl)
    assert tuple(evaluate.pair_metrics(bad).first()) == (0, 1, 0, 0.0, 1.0, 0.0)


def test_thresholds(spark):
    m = spark.createDataFrame([(0.5, 0.80, 0.9), (0.6, 0.90, 0.9), (0.7, 0.97, 0.8), (0.8, 0.98, 0.7), (0.9, 1.0, 0.6)], "threshold double, precision double, f1 double")
    assert evaluate.recommend_threshold(m).first().threshold == 0.6
    assert evaluate.calibrate_threshold(m, 0.95).first().threshold == 0.7
    assert evaluate.calibrate_threshold(m, 0.99).first().threshold == 0.9
    assert evaluate.calibrate_threshold(m.where("threshold < 0.7"), 0.99).first().threshold == 0.6
    assert evaluate.recommend_threshold(m.limit(0)).count() == 0


def test_atomize(spark):
    d = spark.createDataFrame([(1, 1, "a", "p", "x"), (2, 1, "a", "q", "x"), (3, 1, " ", "q", "x"), (4, 2, "a", None, None)], "id long, source_version_id long, label string, program string, plist_path string")
    got = sorted(tuple(r) for r in matching.atomize(d, "daemons").collect())
    assert got == [(1, "daemons", "a", '{"label":"a","plist_path":"x","program":"p"}'), (2, "daemons", "a", '{"label":"a"}')]


def test_scored_query_against_brute_force(spark, tmp_path):
    from itertools import combinations

    from lodeworks.plans.resolution import r16_resolve_scored

    rows = [(1, 1, "/a/x", "x", 5, None, "elf"), (2, 2, "/b/x", "x", 5, None, "elf"), (3, 2, "/c/y", "y", 7, "h", "elf"), (4, 3, "/d/y", "y", 7, "H", "elf"), (5, 3, "/z/tool", "q", 1, None, "pe"), (6, 1, "/w/Tool", None, 1, None, "pe"), (7, 1, "/k/lone", "lone", 9, None, "pe")]
    files = spark.createDataFrame(rows, "id long, source_version_id long, path string, filename string, size long, sha256 string, file_type string")
    files.write.parquet(str(tmp_path / "files.parquet"))
    pairs = spark.createDataFrame(list(combinations([r[0] for r in rows], 2)), "atom_a long, atom_b long")
    scored = matching.score_pairs(pairs, files.withColumn("sha256", F.lower("sha256")), "files").where("score >= 0.85")
    want = sorted((r.cluster_id, r.atom_id) for r in cluster.cluster(scored).collect())
    assert want == [(1, 1), (1, 2), (3, 3), (3, 4), (5, 5), (5, 6)]
    bags = {r.id: r.atom_count for r in r16_resolve_scored(spark, str(tmp_path)).collect()}
    assert bags == {1: 2, 3: 2, 5: 2, 7: 1}


def test_scored_by_default_names_and_tokens(spark):
    # Arch and hash are missing on one side: only the plain name proposes 1 and 2, only tokens 3 and 4.
    a = atoms(spark, (1, 1, "k1", "tool", None, "/a/tool", None), (2, 2, "k2", "tool", "h", "/b/tool", "arm64"), (3, 1, "daemon x", None, None, "/c/run", None), (4, 2, "daemon y", "run", None, "/d/run", None), (5, 1, "alone", "z", "q", "/e/z", None))
    done = resolver.resolve_scored(a, "binaries")
    assert sorted((r.bag_id, r.atom_id) for r in done.bag_atoms.collect()) == [(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)]
    names = resolver.resolve_scored(a, "binaries", tokens=False)
    assert names.bags.where("atom_count > 1").count() == 1


def test_token_query_keeps_the_hits_of_the_operator(spark, tmp_path):
    from lodeworks.plans.resolution import r10_block_tokens

    b = spark.createDataFrame([(i, f"runner n{i}", "arm64") for i in range(1, 121)], "id long, executable_name string, arch string")
    b.write.parquet(str(tmp_path / "binaries.parquet"))
    assert r10_block_tokens(spark, str(tmp_path)).count() == 120 * 119 // 2


def test_hot_buckets_are_linked_without_all_pairs(spark):
    from lodeworks.operators import matching, resolver

    rows = [(i, "t", f"/a/{i % 3}/runner", f"/a/{i % 3}/runner", "runner", 5, f"h{i % 3}", "macho") for i in range(700)]
    rows += [(1000 + i, "t", f"/b/{i}/runner", f"/b/{i}/runner", "runner", 5, "same", "macho") for i in range(20)]
    atoms = spark.createDataFrame(rows, "id long, entity_type string, source_key string, path string, filename string, size long, sha256 string, file_type string")
    pairs = matching.hot_pairs(atoms, ["filename"], *matching.hot_fields("files", atoms.columns))
    assert pairs.count() < 3 * len(rows)
    done = resolver.resolve_scored(atoms, "files", tokens=False)
    assert sorted(r.atom_count for r in done.bags.collect()) == [20, 233, 233, 234] and done.overflow == 720
    assert resolver.resolve_scored(atoms, "files", tokens=False, hot=False).bags.where("atom_count > 1").count() == 0


def odd_files(spark, blanks):
    """Files of which many share a name, a folder or a content; with ``blanks`` any field may be missing."""
    import random

    r = random.Random(5)
    rows = []
    for i in range(1, 901):
        name = r.choice(["runner", "Runner", "RUNNER ", f"n{r.randrange(60)}", "__", "café", "cafe"])
        folder = r.choice(["/Apps/Contents", "C:\\Apps\\x", f"/u{r.randrange(40)}/apps", "/--"])
        row = [r.choice([f"{folder}/{name.strip()}", f"{folder}/{name}/", f"{folder}/m{r.randrange(9)}"]), name, r.choice([5, 5, 6, 900]), f"h{r.randrange(4)}", r.choice(["elf", "pe"])]
        if blanks:
            row = [r.choice([None, "" if isinstance(v, str) else 0]) if r.random() < 0.15 else v for v in row]
        elif r.random() < 0.3:
            row[3] = None
        rows.append((i, "files", row[0], *row))
    return spark.createDataFrame(rows, "id long, entity_type string, source_key string, path string, filename string, size long, sha256 string, file_type string").withColumn("properties", F.to_json(F.struct("file_type", "filename", "path", "sha256", "size"))).cache()


@pytest.mark.parametrize("blanks, blocking", [(False, [["filename"]]), (True, [["filename"]]), (True, [["sha256", "size"], ["path"]])])
def test_links_are_the_candidates_at_or_above_the_threshold(spark, blanks, blocking):
    a = odd_files(spark, blanks)
    hot = matching.hot_fields("files", a.columns)
    got = [tuple(r) for r in matching.linking_pairs(a, blocking, "files", 0.85, hot=hot).collect()]
    scored = matching.score_pairs(matching.candidate_pairs(a, blocking, hot=hot), a, "files").where("score >= 0.85").drop("features")
    want = [tuple(r) for r in scored.collect()]
    assert len(want) > 500 and sorted(got) == sorted(want)


def test_bags_do_not_list_all_pairs(spark, monkeypatch):
    # The list of all scored pairs is a hundred times the rows; bags must not wait for it.
    pairs = matching.candidate_pairs
    monkeypatch.setattr(matching, "candidate_pairs", lambda *a: pairs(*a).where(F.raise_error(F.lit("all pairs were listed")).isNull()))
    a = atoms(spark, (1, 1, "x", "x", "h", "/a/x", None), (2, 2, "x", "x", "h", "/b/x", None), (3, 1, "z", "z", "q", "/z", None))
    done = resolver.resolve_scored(a, "binaries")
    assert sorted((r.id, r.atom_count) for r in done.bags.collect()) == [(1, 2), (3, 1)]
    with pytest.raises(Exception, match="all pairs were listed"):
        done.candidates.collect()


def test_path_suffix_of_slashes_and_line_ends(spark):
    c = lambda a, b: one(spark, matching.path_suffix(F.lit(a), F.lit(b)))
    assert [c(a, b) for a, b in (("/a/x//", "b\\X\\"), ("/", "/"), ("", ""), ("x", "/x"), ("/a/x\n", "/a/x"), ("/a/x/\n", "/a/x"))] == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
