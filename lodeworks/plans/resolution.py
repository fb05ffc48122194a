"""Entity-resolution queries R01-R16 and E01-E05."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import hash_value
from lodeworks.operators import cluster, evaluate, matching, resolver
from lodeworks.session import table

SWEEP = [0.5, 0.7, 0.85, 0.95]


def _files(spark, sf) -> DataFrame:
    """File rows as atoms with their fields as columns."""
    f = table(spark, sf, "files")
    return f.select("id", "source_version_id", F.col("path").alias("source_key"), "path", "filename", "size", hash_value(F.col("sha256")).alias("sha256"), "file_type")


def _binaries(spark, sf) -> DataFrame:
    return table(spark, sf, "binaries").select("id", "source_version_id", "executable_name", "arch", "sha256", "bundle_id")


def r01_atomize(spark, sf):
    daemons = matching.atomize(table(spark, sf, "daemons"), "daemons")
    return daemons.unionByName(matching.atomize(_binaries(spark, sf), "binaries"))


def r02_atomize_files(spark, sf):
    atoms = matching.atomize(table(spark, sf, "files"), "files")
    # What each image delivered first is there already; the later runs come in.
    firsts = table(spark, sf, "versions").groupBy("source_path").agg(F.min("id").alias("source_version_id")).select("source_version_id")
    return matching.new_atoms(atoms.join(firsts, "source_version_id", "left_semi"), atoms).select("source_version_id", "entity_type", "source_key")


def r07_resolve_exact(spark, sf):
    return resolver.resolve(_binaries(spark, sf), ["bundle_id", "executable_name"], "binaries").bags.select("id", "entity_type", "canonical_key", "atom_count")


def r08_unresolved(spark, sf):
    atoms = _binaries(spark, sf)
    return resolver.unresolved_atoms(atoms, resolver.resolve(atoms, ["bundle_id"], "binaries").bag_atoms).select("id")


def r09_block_buckets(spark, sf):
    return matching.bucket_pairs(_files(spark, sf), ["filename", "size"])


def r09_bucket_overflow(spark, sf):
    return matching.bucket_overflow(_files(spark, sf), ["filename"])


def r10_block_tokens(spark, sf):
    b = table(spark, sf, "binaries")
    atoms = b.select("id", F.lit("binaries").alias("entity_type"), F.col("executable_name").alias("source_key"), F.to_json(F.struct("arch", "executable_name")).alias("properties"))
    return matching.token_pairs(atoms)


def r11_comparators(spark, sf):
    c = table(spark, sf, "match_candidates").where("entity_type = 'binaries'").select("id", "atom_a", "atom_b")
    b = _binaries(spark, sf)
    side = lambda p: b.select(F.col("id").alias(f"atom_{p}"), *[F.col(x).alias(f"{p}_{x}") for x in ("executable_name", "bundle_id", "arch", "sha256")])
    j = c.join(side("a"), "atom_a").join(side("b"), "atom_b")
    pair = lambda f, x: f(F.col(f"a_{x}"), F.col(f"b_{x}"))
    return j.select("id", pair(matching.exact, "sha256").alias("exact"), pair(matching.norm_equal, "executable_name").alias("norm"), pair(matching.path_suffix, "executable_name").alias("suffix"), F.round(matching.numeric_close(F.col("atom_a"), F.col("atom_b")), 6).alias("close"), F.round(pair(matching.token_jaccard, "bundle_id"), 6).alias("jaccard"))


def r14_score_pairs(spark, sf):
    atoms = _files(spark, sf)
    pairs = matching.bucket_pairs(atoms, ["sha256"])
    return matching.score_pairs(pairs, atoms, "files").select("atom_a", "atom_b", F.round("score", 6).alias("score"))


def _given_pairs(spark, sf, entity_type: str) -> DataFrame:
    c = table(spark, sf, "match_candidates").where(F.col("entity_type") == entity_type)
    return c.select(F.least("atom_a", "atom_b").alias("atom_a"), F.greatest("atom_a", "atom_b").alias("atom_b")).where("atom_a < atom_b").distinct()


def r14_score_daemons(spark, sf):
    atoms = table(spark, sf, "daemons").select("id", "label", "program", "plist_path")
    return matching.score_pairs(_given_pairs(spark, sf, "daemons"), atoms, "daemons").select("atom_a", "atom_b", F.round("score", 6).alias("score"))


def r14_score_binaries(spark, sf):
    atoms = table(spark, sf, "binaries").select("id", "sha256", "executable_name", F.lit(None).cast("string").alias("path"), "arch")
    return matching.score_pairs(_given_pairs(spark, sf, "binaries"), atoms, "binaries").select("atom_a", "atom_b", F.round("score", 6).alias("score"))


def r11_path_suffix(spark, sf):
    """Every file path against the program of the daemon with the same id."""
    f = table(spark, sf, "files").select("id", "path", "symlink_target", F.concat("path", F.lit("/")).alias("folder"))
    d = table(spark, sf, "daemons").select("id", "program")
    suffix = matching.path_suffix
    return f.join(d, "id", "left").select("id", suffix(F.col("path"), F.col("folder")).alias("own"), suffix(F.col("path"), F.col("symlink_target")).alias("link"), suffix(F.col("path"), F.col("program")).alias("program"), suffix(F.col("path"), F.lit("//")).alias("empty"))


def r15_components(spark, sf):
    links = table(spark, sf, "match_candidates").where("score >= 0.85")
    return cluster.cluster(links, kind="entity_type")


def r16_resolve_scored(spark, sf):
    done = resolver.resolve_scored(_files(spark, sf), "files")
    return done.bags.select("id", "entity_type", "canonical_key", "atom_count", F.round("score", 6).alias("score"))


def r05_merge_bags(spark, sf):
    atoms = _binaries(spark, sf)
    state = resolver.resolve(atoms, ["bundle_id", "executable_name"], "binaries")
    of_bundle = atoms.where("bundle_id IS NOT NULL AND bundle_id <> ''").join(state.bag_atoms.withColumnRenamed("atom_id", "id"), "id")
    merges = of_bundle.groupBy("bundle_id").agg(F.min("bag_id").alias("survivor")).join(of_bundle.select("bundle_id", F.col("bag_id").alias("loser")).distinct(), "bundle_id").select("survivor", "loser")
    return resolver.merge_bags(state, merges).bags.select("id", "canonical_key", "atom_count")


def e01_perturb(spark, sf):
    base = _files(spark, sf).where("sha256 IS NOT NULL").select("id", F.col("filename").alias("executable_name"), F.col("file_type").alias("arch"), "path", "sha256")
    return evaluate.perturb(base, evaluate.default_plan(base.count())).groupBy("mutation").agg(F.count("*").alias("n"), F.count_distinct("sha256").alias("contents"))


def _labelled(spark, sf) -> DataFrame:
    """File rows labelled by content, bagged by name and size."""
    f = _files(spark, sf).where("sha256 IS NOT NULL")
    return f.select(F.col("id").alias("atom_id"), F.col("sha256").alias("cluster_id"), F.concat_ws("|", F.lower("filename"), "size").alias("bag_id"))


def e02_pair_metrics(spark, sf):
    m = evaluate.pair_metrics(_labelled(spark, sf))
    return m.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _sweep(spark, sf) -> DataFrame:
    c = table(spark, sf, "match_candidates").where("entity_type = 'binaries' AND score IS NOT NULL").select("atom_a", "atom_b", "score")
    labels = table(spark, sf, "binaries").select(F.col("id").alias("atom_id"), F.coalesce("executable_name", F.col("id").cast("string")).alias("cluster_id"))
    return evaluate.sweep(labels, c, SWEEP)


def e03_sweep(spark, sf):
    return _sweep(spark, sf).select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def e04_recommend(spark, sf):
    return evaluate.recommend_threshold(_sweep(spark, sf)).select("threshold")


def e05_calibrate(spark, sf):
    return evaluate.calibrate_threshold(_sweep(spark, sf), 0.2).select("threshold")


QUERIES = {f.__name__: f for f in (r01_atomize, r02_atomize_files, r05_merge_bags, r07_resolve_exact, r08_unresolved, r09_block_buckets, r09_bucket_overflow, r10_block_tokens, r11_comparators, r11_path_suffix, r14_score_pairs, r14_score_daemons, r14_score_binaries, r15_components, r16_resolve_scored, e01_perturb, e02_pair_metrics, e03_sweep, e04_recommend, e05_calibrate)}

_H = "nullif(regexp_replace(lower(trim(sha256)), '^sha256:', ''), '')"
_ATOM = "json_merge_patch('{}', to_json({0}))"
_CK = "nullif(concat_ws('|', nullif(lower(trim(bundle_id)), ''), nullif(lower(trim(executable_name)), '')), '')"
_LINKED = """
links AS (SELECT DISTINCT k, a, b FROM raw UNION SELECT DISTINCT k, b, a FROM raw),
reach AS (SELECT k, a AS v, a AS w FROM links UNION SELECT r.k, r.v, l.b FROM reach r JOIN links l ON l.k = r.k AND l.a = r.w),
comp AS (SELECT k, min(w) AS cluster_id, v AS atom_id FROM reach GROUP BY k, v)
"""
_FA = f"fa AS (SELECT id, path, filename, size, {_H} AS sha256, file_type FROM files)"
_SCORE = """sp AS (
  SELECT a.id AS atom_a, b.id AS atom_b,
    (3.0 + CASE WHEN a.filename IS NOT NULL AND b.filename IS NOT NULL AND lower(trim(a.filename)) = lower(trim(b.filename)) THEN 1.5 ELSE 0 END
      + CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL AND nullif(regexp_extract(lower(replace(a.path, '\\', '/')), '([^/]+)/*$', 1), '') = regexp_extract(lower(replace(b.path, '\\', '/')), '([^/]+)/*$', 1) THEN 1.0 ELSE 0 END
      + CASE WHEN a.size IS NOT NULL AND b.size IS NOT NULL THEN 0.5 * CASE WHEN a.size = b.size THEN 1.0 ELSE greatest(0.0, 1.0 - CAST(abs(a.size - b.size) AS DOUBLE) / greatest(abs(a.size), abs(b.size))) END ELSE 0 END
      + CASE WHEN a.file_type IS NOT NULL AND b.file_type IS NOT NULL AND a.file_type = b.file_type THEN 0.5 ELSE 0 END)
    / (3.0 + CASE WHEN a.filename IS NOT NULL AND b.filename IS NOT NULL THEN 1.5 ELSE 0 END + CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN 1.0 ELSE 0 END
      + CASE WHEN a.size IS NOT NULL AND b.size IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN a.file_type IS NOT NULL AND b.file_type IS NOT NULL THEN 0.5 ELSE 0 END) AS score
  FROM fa a JOIN fa b ON a.sha256 = b.sha256 AND a.id < b.id
  WHERE a.sha256 IN (SELECT sha256 FROM fa GROUP BY sha256 HAVING count(*) BETWEEN 2 AND 200))"""
_TOKEN = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"
_METRIC = """
cells AS (SELECT {by} cluster_id, coalesce('b' || bag_id, 'a' || atom_id) AS bag, count(*) AS n FROM lab GROUP BY ALL),
t1 AS (SELECT {by} CAST(sum(n * (n - 1) / 2) AS BIGINT) AS tp FROM cells {g}),
t2 AS (SELECT {by} CAST(sum(n * (n - 1) / 2) AS BIGINT) AS ib FROM (SELECT {by} bag, sum(n) AS n FROM cells GROUP BY ALL) {g}),
t3 AS (SELECT {by} CAST(sum(n * (n - 1) / 2) AS BIGINT) AS ic FROM (SELECT {by} cluster_id, sum(n) AS n FROM cells GROUP BY ALL) {g}),
m AS (SELECT {by} tp, ib - tp AS fp, ic - tp AS fn, CASE WHEN ib > 0 THEN tp / ib ELSE 1.0 END AS precision, CASE WHEN ic > 0 THEN tp / ic ELSE 1.0 END AS recall FROM t1 {j2} {j3}),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
"""
_SWEEP = (
    "WITH RECURSIVE th AS (SELECT CAST(unnest([0.5, 0.7, 0.85, 0.95]) AS DOUBLE) AS threshold), raw AS (SELECT threshold AS k, atom_a AS a, atom_b AS b FROM match_candidates, th WHERE entity_type = 'binaries' AND score >= threshold AND atom_a <> atom_b), "
    + _LINKED.strip()
    + ", lab AS (SELECT th.threshold, b.id AS atom_id, coalesce(b.executable_name, CAST(b.id AS VARCHAR)) AS cluster_id, c.cluster_id AS bag_id FROM binaries b CROSS JOIN th LEFT JOIN comp c ON c.atom_id = b.id AND c.k = th.threshold), "
    + _METRIC.format(by="threshold,", g="GROUP BY threshold", j2="JOIN t2 USING (threshold)", j3="JOIN t3 USING (threshold)").strip()
)

_GIVEN = "p AS (SELECT DISTINCT least(atom_a, atom_b) AS atom_a, greatest(atom_a, atom_b) AS atom_b FROM match_candidates WHERE entity_type = '{0}' AND atom_a <> atom_b)"


def _suffix(a: str, b: str) -> str:
    last = lambda p: f"regexp_extract(lower(replace({p}, '\\', '/')), '([^/]+)/*$', 1)"
    return f"CASE WHEN {last(a)} <> '' AND {last(a)} = {last(b)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _eq(field: str) -> str:
    return f"(lower(trim(a.{field})) = lower(trim(b.{field})))::DOUBLE"


def _weighted(*rules: tuple[str, str, float]) -> str:
    """Weighted mean over the fields that both sides have, 0 without any."""
    there = lambda f: f"a.{f} IS NOT NULL AND b.{f} IS NOT NULL"
    top = " + ".join(f"CASE WHEN {there(f)} THEN {w} * {score} ELSE 0 END" for score, f, w in rules)
    bottom = " + ".join(f"CASE WHEN {there(f)} THEN {w} ELSE 0 END" for _, f, w in rules)
    return f"coalesce(({top}) / nullif(({bottom})::DOUBLE, 0), 0.0::DOUBLE)"


#: Pairs the default blocking proposes for files: one file name in a bucket of 2 to 200, or among the first 200 hits of the path's tokens.
_CANDIDATES = f"""
nm AS (SELECT id, lower(trim(filename)) AS b FROM fa WHERE coalesce(trim(filename), '') <> ''),
nb AS (SELECT b FROM nm GROUP BY b HAVING count(*) BETWEEN 2 AND 200),
tx AS (SELECT id, path, concat_ws(' ', 'files', path, CASE WHEN file_type IS NOT NULL THEN 'file_type ' || file_type END, CASE WHEN filename IS NOT NULL THEN 'filename ' || filename END,
  CASE WHEN path IS NOT NULL THEN 'path' END, CASE WHEN sha256 IS NOT NULL THEN 'sha256 ' || sha256 END, CASE WHEN size IS NOT NULL THEN 'size ' || size END) AS t FROM fa),
tk AS (SELECT id, unnest({_TOKEN.format("strip_accents(t)")}) AS token FROM tx),
tq AS (SELECT DISTINCT path, unnest({_TOKEN.format("strip_accents(path)")}) AS token FROM (SELECT DISTINCT path FROM tx)),
th AS (SELECT DISTINCT tq.path, tk.id AS hit FROM tq JOIN tk USING (token)),
tr AS (SELECT tx.id, th.hit FROM th JOIN tx USING (path) WHERE tx.id <> th.hit QUALIFY row_number() OVER (PARTITION BY tx.id ORDER BY th.hit) <= 200),
hot AS (SELECT f.*, nm.b FROM fa f JOIN nm USING (id) WHERE b IN (SELECT b FROM nm GROUP BY b HAVING count(*) > 200)),
hc AS (SELECT id, min(id) OVER (PARTITION BY b, path, filename, size, sha256, file_type) AS first FROM hot),
hr AS (SELECT hot.id, b || '|' || coalesce(lower(trim(sha256)), '') AS k1, b || '|' || coalesce(lower(trim(path)), '') AS k2, b || '|' || coalesce(lower(trim(filename)), '') AS k3 FROM hot JOIN hc ON hc.id = hot.id AND hc.first = hot.id),
hk AS (SELECT id, unnest(['1' || k1, '2' || k2, '3' || k3]) AS k FROM hr),
cand AS (
  SELECT first AS atom_a, id AS atom_b FROM hc WHERE first < id
  UNION SELECT x.id, y.id FROM hk x JOIN (SELECT k FROM hk GROUP BY k HAVING count(*) BETWEEN 2 AND 200) USING (k) JOIN hk y ON y.k = x.k AND x.id < y.id
  UNION SELECT x.id AS atom_a, y.id AS atom_b FROM nm x JOIN nb USING (b) JOIN nm y ON y.b = x.b AND x.id < y.id
  UNION SELECT least(id, hit), greatest(id, hit) FROM tr)
"""
_CLOSE = "CASE WHEN a.size = b.size THEN 1.0 ELSE greatest(0.0, 1.0 - CAST(abs(a.size - b.size) AS DOUBLE) / greatest(abs(a.size), abs(b.size))) END"
_FILE_SCORE = _weighted(("(a.sha256 = b.sha256)::DOUBLE", "sha256", 3.0), (_eq("filename"), "filename", 1.5), (_suffix("a.path", "b.path"), "path", 1.0), (_CLOSE, "size", 0.5), ("(a.file_type = b.file_type)::DOUBLE", "file_type", 0.5))



def _atoms(table: str, entity_type: str, key: str, fields: tuple[str, ...]) -> str:
    shown = ", ".join(f"""CASE WHEN {f} IS NOT NULL THEN '"{f}":' || CAST(to_json({f}) AS VARCHAR) END""" for f in sorted(fields))
    return f"SELECT source_version_id, '{entity_type}' AS entity_type, {key} AS source_key, '{{' || concat_ws(',', {shown}) || '}}' AS properties FROM {table} WHERE trim({key}) <> '' QUALIFY row_number() OVER (PARTITION BY source_version_id, {key} ORDER BY id) = 1"


def _perturbed() -> str:
    """The default plan over files with a digest: rows in the order of their lots, cut into the consuming mutations one after the other."""
    share = lambda m: f"CAST(greatest(1, round_even(count(*) * {evaluate.RATIOS[m]}, 0)) AS BIGINT) AS {m}"
    rows, start = ["SELECT 'base' AS mutation, count(*) AS n, count(DISTINCT h) AS contents FROM b"], "0"
    for m in ("identical", "move", "recompile", "rename"):
        contents = "count(*)" if m == "recompile" else "count(DISTINCT h)"
        rows.append(f"SELECT '{m}', count(*), {contents} FROM o, c WHERE k > {start} AND k <= {start} + {m}")
        start = f"{start} + {m}"
    rows += [f"SELECT '{m}', {m}, {m} FROM c" for m in evaluate.FOREIGN]
    plan = ", ".join(share(m) for m in ("identical", "move", "recompile", "rename", *evaluate.FOREIGN))
    return f"WITH b AS (SELECT id, {_H} AS h FROM files WHERE {_H} IS NOT NULL), c AS (SELECT {plan} FROM b), o AS (SELECT h, row_number() OVER (ORDER BY md5('0|' || id), id) AS k FROM b) " + " UNION ALL ".join(rows)


ORACLE = {
    "e01_perturb": _perturbed(),
    "r01_atomize": _atoms("daemons", "daemons", "label", ("label", "program", "plist_path")) + " UNION ALL " + _atoms("binaries", "binaries", "executable_name", ("executable_name", "arch", "sha256")),
    "r02_atomize_files": "SELECT DISTINCT source_version_id, 'files' AS entity_type, path AS source_key FROM files x WHERE trim(path) <> '' AND source_version_id NOT IN (SELECT min(id) FROM versions GROUP BY source_path)",
    "r05_merge_bags": f"""WITH a AS (SELECT id, nullif(bundle_id, '') AS bundle, {_CK} AS ck FROM binaries),
bag AS (SELECT ck, min(id) AS id, count(*) AS n FROM a WHERE ck IS NOT NULL GROUP BY ck),
mem AS (SELECT a.id AS atom, bag.id AS bag, a.bundle FROM a JOIN bag USING (ck)),
lead AS (SELECT bundle, min(bag) AS s FROM mem WHERE bundle IS NOT NULL GROUP BY bundle),
mg AS (SELECT DISTINCT s, bag AS l FROM mem JOIN lead USING (bundle) WHERE s <> bag),
moved AS (SELECT DISTINCT coalesce(mg.s, mem.bag) AS bag, atom FROM mem LEFT JOIN mg ON mg.l = mem.bag)
SELECT bag.id, CASE WHEN bag.n > 1 THEN bag.ck END AS canonical_key, (SELECT count(*) FROM moved WHERE moved.bag = bag.id) AS atom_count FROM bag WHERE bag.id NOT IN (SELECT l FROM mg)""",
    "r07_resolve_exact": f"SELECT min(id) AS id, 'binaries' AS entity_type, CASE WHEN count(*) > 1 THEN ck END AS canonical_key, count(*) AS atom_count FROM (SELECT id, {_CK} AS ck FROM binaries) WHERE ck IS NOT NULL GROUP BY ck",
    "r08_unresolved": "SELECT id FROM binaries WHERE bundle_id IS NULL OR lower(trim(bundle_id)) = ''",
    "r09_block_buckets": """WITH k AS (SELECT id, coalesce(lower(trim(filename)), '') || '|' || coalesce(CAST(size AS VARCHAR), '') AS b FROM files WHERE coalesce(lower(trim(filename)), '') <> '' OR size IS NOT NULL),
u AS (SELECT b FROM k GROUP BY b HAVING count(*) BETWEEN 2 AND 200)
SELECT x.id AS atom_a, y.id AS atom_b FROM k x JOIN u USING (b) JOIN k y ON y.b = x.b AND x.id < y.id""",
    "r09_bucket_overflow": "SELECT lower(trim(filename)) AS bucket, count(*) AS n FROM files WHERE coalesce(trim(filename), '') <> '' GROUP BY 1 HAVING count(*) > 200",
    "r10_block_tokens": f"""WITH a AS (SELECT id, executable_name AS k, concat_ws(' ', 'binaries', executable_name, CASE WHEN arch IS NOT NULL THEN 'arch ' || arch END, CASE WHEN executable_name IS NOT NULL THEN 'executable_name ' || executable_name END) AS t FROM binaries),
ix AS (SELECT id, unnest({_TOKEN.format("t")}) AS token FROM a), qs AS (SELECT id, unnest({_TOKEN.format("k")}) AS token FROM a WHERE k IS NOT NULL),
h AS (SELECT DISTINCT qs.id, ix.id AS hit FROM qs JOIN ix USING (token) WHERE qs.id <> ix.id),
r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY hit) <= 200)
SELECT DISTINCT least(id, hit) AS atom_a, greatest(id, hit) AS atom_b FROM r""",
    "r11_comparators": """WITH b AS (SELECT id, executable_name AS e, bundle_id AS u, sha256 AS s FROM binaries)
SELECT c.id, CASE WHEN a.s = b.s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact, CASE WHEN lower(trim(a.e)) = lower(trim(b.e)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm,
 CASE WHEN nullif(regexp_extract(lower(replace(a.e, '\\', '/')), '([^/]+)/*$', 1), '') = regexp_extract(lower(replace(b.e, '\\', '/')), '([^/]+)/*$', 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS suffix,
 round(CASE WHEN atom_a = atom_b THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(atom_a - atom_b)::DOUBLE / greatest(abs(atom_a), abs(atom_b))) END, 6) AS close,
 CASE WHEN a.u IS NULL OR b.u IS NULL THEN 0.0::DOUBLE ELSE round(coalesce(len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(a.u), '[^a-z0-9]+'), lambda t: t <> '')), list_distinct(list_filter(regexp_split_to_array(lower(b.u), '[^a-z0-9]+'), lambda t: t <> ''))))::DOUBLE
   / nullif(len(list_distinct(list_concat(list_filter(regexp_split_to_array(lower(a.u), '[^a-z0-9]+'), lambda t: t <> ''), list_filter(regexp_split_to_array(lower(b.u), '[^a-z0-9]+'), lambda t: t <> '')))), 0), 0.0), 6) END AS jaccard
FROM match_candidates c JOIN b a ON a.id = c.atom_a JOIN b b ON b.id = c.atom_b WHERE c.entity_type = 'binaries'""",
    "r11_path_suffix": f"SELECT f.id, {_suffix('f.path', "f.path || '/'")} AS own, {_suffix('f.path', 'f.symlink_target')} AS link, {_suffix('f.path', 'd.program')} AS program, 0.0::DOUBLE AS empty FROM files f LEFT JOIN daemons d ON d.id = f.id",
    "r14_score_daemons": f"WITH {_GIVEN.format('daemons')} SELECT atom_a, atom_b, round({_weighted((_eq('label'), 'label', 3.0), (_suffix('a.program', 'b.program'), 'program', 2.0), (_suffix('a.plist_path', 'b.plist_path'), 'plist_path', 1.0))}, 6) AS score FROM p JOIN daemons a ON a.id = atom_a JOIN daemons b ON b.id = atom_b",
    "r14_score_binaries": f"WITH {_GIVEN.format('binaries')} SELECT atom_a, atom_b, round({_weighted(('(a.sha256 = b.sha256)::DOUBLE', 'sha256', 3.0), (_eq('executable_name'), 'executable_name', 2.0), ('(a.arch = b.arch)::DOUBLE', 'arch', 0.5))}, 6) AS score FROM p JOIN binaries a ON a.id = atom_a JOIN binaries b ON b.id = atom_b",
    "r14_score_pairs": f"WITH {_FA}, {_SCORE} SELECT atom_a, atom_b, round(score, 6) AS score FROM sp",
    "r15_components": "WITH RECURSIVE raw AS (SELECT entity_type AS k, atom_a AS a, atom_b AS b FROM match_candidates WHERE score >= 0.85 AND atom_a <> atom_b), " + _LINKED.strip() + " SELECT k AS kind, cluster_id, atom_id FROM comp",
    "r16_resolve_scored": f"WITH RECURSIVE {_FA}, {_CANDIDATES}, sp AS (SELECT atom_a, atom_b, {_FILE_SCORE} AS score FROM cand JOIN fa a ON a.id = atom_a JOIN fa b ON b.id = atom_b), raw AS (SELECT '' AS k, atom_a AS a, atom_b AS b FROM sp WHERE score >= 0.85), " + _LINKED.strip() + """, n AS (SELECT cluster_id, count(*) AS c FROM comp GROUP BY 1), s AS (SELECT cluster_id, avg(score) AS s FROM sp JOIN comp ON comp.atom_id = sp.atom_a WHERE score >= 0.85 GROUP BY 1)
SELECT n.cluster_id AS id, 'files' AS entity_type, f.path AS canonical_key, n.c AS atom_count, round(s.s, 6) AS score FROM n JOIN s USING (cluster_id) JOIN files f ON f.id = n.cluster_id
UNION ALL SELECT id, 'files', NULL, 1, NULL FROM files WHERE id NOT IN (SELECT atom_id FROM comp)""",
    "e02_pair_metrics": f"WITH lab AS (SELECT CAST(id AS VARCHAR) AS atom_id, {_H} AS cluster_id, concat_ws('|', lower(filename), CAST(size AS VARCHAR)) AS bag_id FROM files WHERE {_H} IS NOT NULL), " + _METRIC.format(by="", g="", j2=", t2", j3=", t3").strip() + " SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM m2",
    "e03_sweep": _SWEEP + " SELECT threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM m2",
    "e04_recommend": _SWEEP + " SELECT threshold FROM m2 ORDER BY f1 DESC, threshold DESC LIMIT 1",
    "e05_calibrate": _SWEEP + " SELECT threshold FROM m2 ORDER BY precision >= 0.2 DESC, CASE WHEN precision >= 0.2 THEN threshold END, precision DESC, threshold DESC LIMIT 1",
}
