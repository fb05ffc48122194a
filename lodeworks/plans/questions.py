"""Query-layer queries Q01-Q19 and text search, over the domain and star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import query, textsearch
from lodeworks.session import table


def _events(spark, sf) -> DataFrame:
    """Events as observations of customers, one version per month."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.lit("customers").alias("entity_table"), F.col("user_id").alias("entity_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), "event_type", F.month("ts").cast("long").alias("version_id"), "value")


def _holds(spark, sf) -> DataFrame:
    """What each binary was built against, as grants: (binary_id, key)."""
    b = table(spark, sf, "binaries")
    facts = F.array(F.concat(F.lit("arch:"), F.coalesce("arch", F.lit("none"))), F.concat(F.lit("sdk:"), F.coalesce("sdk_version", F.lit("none"))), F.concat(F.lit("sign:"), F.coalesce("code_sign_flags", F.lit("none"))))
    return b.select(F.col("id").alias("binary_id"), F.explode(facts).alias("key"))


def q01_raw_sql(spark, sf):
    engine = query.EntityQuery(spark, {"q_files": table(spark, sf, "files"), "q_versions": table(spark, sf, "versions")})
    sql = """SELECT v.source_path, f.file_type, count(*) AS n, sum(CASE WHEN f.size > :least THEN 1 ELSE 0 END) AS big
             FROM q_files f JOIN q_versions v ON v.id = f.source_version_id GROUP BY v.source_path, f.file_type HAVING count(*) > 1"""
    return engine.execute(sql, {"least": 100000}).frame


def q01_window_sql(spark, sf):
    engine = query.EntityQuery(spark, {"q_orders": table(spark, sf, "orders")})
    return engine.execute("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
        CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n FROM q_orders""").frame


def q01_grouping_sets(spark, sf):
    engine = query.EntityQuery(spark, {"q_daemons": table(spark, sf, "daemons")})
    return engine.execute("SELECT session_type, group_name, count(*) AS n, grouping(session_type) AS g1, grouping(group_name) AS g2 FROM q_daemons GROUP BY CUBE (session_type, group_name)").frame


def _search(name, columns, row_id, text):
    def run(spark, sf):
        return textsearch.search(table(spark, sf, name), text, columns, row_id).select(row_id, *columns)

    return run


def q02_search_index(spark, sf):
    index = textsearch.inverted_index(table(spark, sf, "files"), ["path", "filename", "file_type"])
    return index.groupBy("token").agg(F.count("*").alias("n"))


def q03_root_daemons(spark, sf):
    return query.root_daemons(table(spark, sf, "daemons")).select("id", "label", "program", "user_name", "sandbox_profile")


def q04_top_holders(spark, sf):
    return query.top_holders(_holds(spark, sf))


def q05_grants_of(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    grants = lines.join(parts, "p_partkey").withColumnRenamed("p_brand", "key")
    holders = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    places = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return query.grants_of(grants, holders, places, ["Brand#2", "Brand#17"], "s_suppkey", "n_nationkey").select("key", "s_name", "n_name", "l_orderkey", "l_linenumber")


def q06_service_map(spark, sf):
    return query.service_map(table(spark, sf, "daemons"))


def q07_service_owners(spark, sf):
    services = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("service_name"), F.col("o_custkey").alias("daemon_id"))
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("sandbox_profile"), F.col("c_nationkey").cast("string").alias("user_name"))
    return query.service_owners(services, owners, "%URGENT%").groupBy("service_name", "label", "sandbox_profile", "user_name").agg(F.count("*").alias("n"))


def q08_daemons_with(spark, sf):
    found = query.daemons_with(_holds(spark, sf), table(spark, sf, "binaries"), table(spark, sf, "daemons"), "ARCH:arm%")
    return found.select("id", "label", "executable_name", "key", "sandbox_profile", "user_name")


def q09_kernel_surface(spark, sf):
    kexts = table(spark, sf, "binaries").withColumn("has_user_client", F.col("has_restrict"))
    return query.kernel_surface(kexts).select("id", "bundle_id", "executable_name", "arch")


def q10_test_binaries(spark, sf):
    """Programs of services in place of binaries, their labels in place of bundle ids."""
    services = table(spark, sf, "daemons")
    places = services.select("id", F.col("program").alias("path"))
    return query.test_binaries(services.select(F.col("id").alias("file_id"), F.col("label").alias("bundle_id"), F.col("sandbox_profile").alias("executable_name")), places)


def q11_escape_surface(spark, sf):
    return query.escape_surface(table(spark, sf, "daemons"), _holds(spark, sf))


def q12_observations_for(spark, sf):
    return query.observations_for(_events(spark, sf), "customers", 8).select("id", "observed_at", "event_type")


def q13_pattern_of_life(spark, sf):
    return query.pattern_of_life(_events(spark, sf), "customers", 8, "2024-01-02", "2024-01-09").select("id", "observed_at", "event_type")


def q14_first_seen(spark, sf):
    return query.first_seen(_events(spark, sf))


def q15_cross_graph(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return query.cross_graph(customers, _events(spark, sf), "customers", "purchase", "c_custkey").select("c_name", "observation_id", "observed_at")


def q16_new_observations(spark, sf):
    e = table(spark, sf, "events").select(F.lit("customers").alias("entity_table"), F.col("user_id").alias("entity_id"), "event_type", F.date_format("ts", "HH").alias("observed_at"), (F.dayofmonth("ts") > 15).alias("late"))
    return query.new_observations(e, ~F.col("late"), F.col("late")).groupBy("entity_table", "entity_id", "event_type", "observed_at").agg(F.count("*").alias("n"))


def q17_stats(spark, sf):
    names = ("files", "binaries", "daemons", "match_candidates")
    return query.stats({n: table(spark, sf, n) for n in names})


def q18_largest_files(spark, sf):
    return query.largest(table(spark, sf, "files"), 20).select("id", "path", "size")


def q18_arch_distribution(spark, sf):
    return query.distribution(table(spark, sf, "binaries"), "arch")


def q18_file_types(spark, sf):
    return query.distribution(table(spark, sf, "files"), "file_type")


def q18_merge_audit(spark, sf):
    return query.merge_audit(table(spark, sf, "match_candidates"), 25).select("id", "entity_type", "score")


def _same_content(spark, sf):
    """Bags of file rows with the same content."""
    atoms = table(spark, sf, "files").where("sha256 IS NOT NULL AND sha256 <> ''").select("id", "source_version_id", "sha256")
    bags = atoms.groupBy("sha256").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("score"))
    members = atoms.join(bags.select("sha256", F.col("id").alias("bag_id")), "sha256").select("bag_id", F.col("id").alias("atom_id"))
    return bags, members, atoms


def q18_cross_source_bags(spark, sf):
    return query.cross_source_bags(*_same_content(spark, sf)).select("id", "score", "sources", "atoms")


def q19_canonical_count(spark, sf):
    _, members, atoms = _same_content(spark, sf)
    return query.canonical_counts(members, atoms)


_SEARCHES = {
    "q02_search_and": ("documents", ["text"], "doc_id", "the gehe OR hubrea bocir"),
    "q02_search_phrase": ("documents", ["text"], "doc_id", '"sapock was"'),
    "q02_search_prefix": ("files", ["path", "filename", "file_type"], "id", "gro* NOT runner"),
    "q02_search_column": ("daemons", ["label", "program", "mach_services", "sandbox_profile"], "id", "program:usr AND label:com"),
    "q02_search_accents": ("documents", ["text"], "doc_id", "hohe"),
}

QUERIES = {n: _search(t, c, i, q) for n, (t, c, i, q) in _SEARCHES.items()}
QUERIES |= {f.__name__: f for f in (q01_raw_sql, q01_window_sql, q01_grouping_sets, q02_search_index, q03_root_daemons, q04_top_holders, q05_grants_of, q06_service_map, q07_service_owners, q08_daemons_with, q09_kernel_surface, q10_test_binaries, q11_escape_surface, q12_observations_for, q13_pattern_of_life, q14_first_seen, q15_cross_graph, q16_new_observations, q17_stats, q18_largest_files, q18_arch_distribution, q18_file_types, q18_merge_audit, q18_cross_source_bags, q19_canonical_count)}


def _padded(column: str) -> str:
    return f"' ' || array_to_string(list_filter(regexp_split_to_array(strip_accents(lower(coalesce({column}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ') || ' '"


def _any(columns: list[str], needle: str) -> str:
    return "(" + " OR ".join(f"contains({_padded(c)}, '{needle}')" for c in columns) + ")"


_F, _D = _SEARCHES["q02_search_prefix"][1], _SEARCHES["q02_search_column"][1]
_HOLDS = "holds AS (SELECT id AS binary_id, unnest(['arch:' || coalesce(arch, 'none'), 'sdk:' || coalesce(sdk_version, 'none'), 'sign:' || coalesce(code_sign_flags, 'none')]) AS key FROM binaries)"
_EV = "ev AS (SELECT event_id AS id, 'customers' AS entity_table, user_id AS entity_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS observed_at, event_type FROM events)"
_SAME = """atoms AS (SELECT id, source_version_id, sha256 FROM files WHERE sha256 IS NOT NULL AND sha256 <> ''),
bags AS (SELECT sha256, min(id) AS id, CAST(count(*) AS DOUBLE) AS score, count(DISTINCT source_version_id) AS sources, count(*) AS atoms FROM atoms GROUP BY sha256)"""

ORACLE = {
    "q01_raw_sql": "SELECT v.source_path, f.file_type, count(*) AS n, CAST(sum(CASE WHEN f.size > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM files f JOIN versions v ON v.id = f.source_version_id GROUP BY ALL HAVING count(*) > 1",
    "q01_window_sql": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "q01_grouping_sets": "SELECT session_type, group_name, count(*) AS n, grouping(session_type) AS g1, grouping(group_name) AS g2 FROM daemons GROUP BY CUBE (session_type, group_name)",
    "q02_search_and": f"SELECT doc_id, text FROM documents WHERE ({_any(['text'], ' the ')} AND {_any(['text'], ' gehe ')}) OR ({_any(['text'], ' hubrea ')} AND {_any(['text'], ' bocir ')}) ORDER BY doc_id LIMIT 100",
    "q02_search_phrase": f"SELECT doc_id, text FROM documents WHERE {_any(['text'], ' sapock was ')} ORDER BY doc_id LIMIT 100",
    "q02_search_prefix": f"SELECT id, path, filename, file_type FROM files WHERE {_any(_F, ' gro')} AND NOT {_any(_F, ' runner ')} ORDER BY id LIMIT 100",
    "q02_search_column": f"SELECT id, label, program, mach_services, sandbox_profile FROM daemons WHERE {_any(['program'], ' usr ')} AND {_any(['label'], ' com ')} ORDER BY id LIMIT 100",
    "q02_search_accents": f"SELECT doc_id, text FROM documents WHERE {_any(['text'], ' hohe ')} ORDER BY doc_id LIMIT 100",
    "q02_search_index": f"SELECT token, count(*) AS n FROM (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(concat_ws(' ', path, filename, file_type))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS token FROM files) GROUP BY token",
    "q03_root_daemons": "SELECT id, label, program, user_name, sandbox_profile FROM daemons WHERE (user_name IS NULL OR user_name = 'root') AND (sandbox_profile IS NULL OR sandbox_profile = '')",
    "q04_top_holders": f"WITH {_HOLDS} SELECT key, count(*) AS holders FROM holds GROUP BY key ORDER BY holders DESC, key LIMIT 50",
    "q05_grants_of": "SELECT p_brand AS key, s_name, n_name, l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE p_brand IN ('Brand#2', 'Brand#17')",
    "q06_service_map": "SELECT label, mach_services, sandbox_profile, user_name FROM daemons WHERE mach_services IS NOT NULL",
    "q07_service_owners": "SELECT o_orderpriority AS service_name, c_name AS label, c_mktsegment AS sandbox_profile, CAST(c_nationkey AS VARCHAR) AS user_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority ILIKE '%URGENT%' GROUP BY ALL",
    "q08_daemons_with": f"WITH {_HOLDS} SELECT d.id, d.label, b.executable_name, h.key, d.sandbox_profile, d.user_name FROM daemons d JOIN binaries b ON b.id = d.binary_id JOIN holds h ON h.binary_id = b.id WHERE h.key ILIKE 'ARCH:arm%'",
    "q09_kernel_surface": "SELECT id, bundle_id, executable_name, arch FROM binaries WHERE has_restrict = 1",
    "q10_test_binaries": "SELECT program AS path, label AS bundle_id, sandbox_profile AS executable_name FROM daemons WHERE program ILIKE '%/test%' OR program ILIKE '%/debug%' OR label ILIKE '%test%' OR label ILIKE '%debug%'",
    "q11_escape_surface": f"WITH {_HOLDS} SELECT d.id, d.label, d.program, d.mach_services, d.sandbox_profile, d.user_name, string_agg(h.key, ', ' ORDER BY h.key) AS privileged_entitlements FROM daemons d JOIN holds h ON h.binary_id = d.binary_id WHERE (d.sandbox_profile IS NULL OR d.sandbox_profile = '') AND d.mach_services IS NOT NULL GROUP BY ALL",
    "q12_observations_for": f"WITH {_EV} SELECT id, observed_at, event_type FROM ev WHERE entity_id = 8",
    "q13_pattern_of_life": f"WITH {_EV} SELECT id, observed_at, event_type FROM ev WHERE entity_id = 8 AND observed_at BETWEEN '2024-01-02' AND '2024-01-09'",
    "q14_first_seen": f"WITH {_EV} SELECT entity_table, entity_id, observed_at, id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY entity_table, entity_id ORDER BY observed_at, id) = 1",
    "q15_cross_graph": f"WITH {_EV} SELECT c_name, id AS observation_id, observed_at FROM customer JOIN ev ON entity_id = c_custkey WHERE event_type = 'purchase'",
    "q16_new_observations": """WITH e AS (SELECT 'customers' AS entity_table, user_id AS entity_id, event_type, strftime(ts, '%H') AS observed_at, day(ts) > 15 AS late FROM events)
SELECT entity_table, entity_id, event_type, observed_at, count(*) AS n FROM e x WHERE late AND NOT EXISTS (SELECT 1 FROM e y WHERE NOT y.late AND y.entity_id = x.entity_id AND y.event_type = x.event_type AND y.observed_at = x.observed_at) GROUP BY ALL""",
    "q17_stats": " UNION ALL ".join(f"SELECT '{n}' AS table_name, " + (f"count(*) AS rows FROM {n}" if n in ("files", "binaries", "daemons", "match_candidates") else "CAST(0 AS BIGINT) AS rows") for n in query.COUNTED),
    "q18_largest_files": "SELECT id, path, size FROM files ORDER BY size DESC NULLS LAST, id LIMIT 20",
    "q18_arch_distribution": "SELECT arch, count(*) AS n FROM binaries GROUP BY arch",
    "q18_file_types": "SELECT file_type, count(*) AS n FROM files GROUP BY file_type",
    "q18_merge_audit": "SELECT id, entity_type, score FROM match_candidates WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 25",
    "q18_cross_source_bags": f"WITH {_SAME} SELECT id, score, sources, atoms FROM bags WHERE sources >= 2",
    "q19_canonical_count": f"WITH {_SAME} SELECT count(*) AS canonical, count(*) FILTER (WHERE sources >= 2) AS cross_source FROM bags",
}
