"""Query layer, search, sanitizer, STIX, sources, pipeline, command line and streaming."""

import hashlib
import hmac
import io
import json
import os
import plistlib
import sqlite3
import struct
import tarfile
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeworks import cli, harness, schema
from lodeworks.operators import query, sanitize, stix, textsearch
from lodeworks.pipeline import Context, FingerprintMismatch, OutputExists, Phase, Pipeline, default_pipeline
from lodeworks.sources import columns as C
from lodeworks.sources import readers, registry
from lodeworks.streaming import events as stream
from lodeworks.workspace import Workspace


def values(spark, text, match):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "id long, t string")
    return [r.id for r in textsearch.search(df, match, ["t"]).collect()]


def test_search(spark):
    text = ["Café au lait", "a b c", "b a", "alpha_beta gamma", "x-y", None]
    assert values(spark, text, "cafe") == [0] and values(spark, text, "a b") == [1, 2] and values(spark, text, '"a b"') == [1]
    assert values(spark, text, "alpha_beta") == [3] and values(spark, text, "al*") == [3] and values(spark, text, "cafe OR gamma") == [0, 3]
    assert values(spark, text, "b NOT c") == [2] and values(spark, text, "^b") == [2] and values(spark, text, "NEAR(a c, 1)") == [1]
    assert values(spark, text, "(cafe OR gamma) NOT lait") == [3] and values(spark, text, "t:x") == [4]
    for bad in ("x-y", "", "(a", "nope:a", '"a'):
        with pytest.raises(textsearch.MatchSyntaxError):
            textsearch.matches(bad, ["t"])
    index = textsearch.inverted_index(spark.createDataFrame([(1, "a b"), (2, "b")], "id long, t string"), ["t"])
    assert [r.id for r in textsearch.search_index(index, ["a", "b"]).collect()] == [1]


def test_read_only(spark):
    engine = query.EntityQuery(spark, {"files": spark.createDataFrame([(1, "/a", "a", "t")], "id long, path string, filename string, file_type string")})
    assert engine.execute("SELECT count(*) AS n FROM files WHERE id = ?", [1]).as_dicts() == [{"n": 1}]
    for bad in ("DROP TABLE files", "INSERT INTO files VALUES (1)", "WITH x AS (SELECT 1) INSERT INTO files SELECT * FROM x", "FROM files INSERT INTO files SELECT *", "SET a=b", "", "/* SELECT */ CREATE VIEW v AS SELECT 1"):
        with pytest.raises(query.ReadOnlyViolation):
            engine.execute(bad)
    with pytest.raises(ValueError):
        engine.search("a", "versions")
    with pytest.raises(ValueError):
        query.valid_identifier("a; DROP")
    with pytest.raises(PermissionError):
        query.EntityQuery(spark, {}, "failed")
    shown = query.QueryResult(spark.range(150).select("id", F.lit("x" * 70).alias("t"))).to_markdown()
    assert "... and 50 more rows" in shown and "x" * 57 + "..." in shown and "x" * 58 not in shown


def test_patterns_follow_the_public_formats():
    import re

    hit = lambda name, text: re.search(sanitize.PATTERNS[name], text) is not None
    yes = {
        "uuid": ("07409496-a423-4a3e-b620-2cfb01a9318d", "URN:UUID:F81D4FAE-7DEC-11D0-A765-00A0C91E6BF6"),
        "gps_coord": ("latitude: 52.5163", "lng=-0.12776", '"lon": "13.37770"', "GPS = 179.99999"),
        "username_path": ("/home/alice/notes.txt", "/home/über/u.txt", "/Users/bob", "/var/home/kim/x"),
        "username_path_win": (r"C:\Users\alice\x", "d:/Users/bob/y", "C:\\\\Documents and Settings\\\\eve"),
        "aws_secret_key_kv": ("aws_secret_access_key = " + "aB3/" * 10, "AWS-SECRET-KEY:" + "x+9Y" * 10, 'secretAccessKey="' + "k" * 40 + '"'),
        "private_key_kv": ("PrivateKey = " + "A" * 43 + "=", "wireguard-key: " + "b" * 43 + "=", "preshared_key=" + "c/d+" * 8),
        "token_kv": ("api-key=abc123", "access_token: x.y-z", "client secret = s3cr3t", "bearer_token = synthetic-value", '"auth_token": "Bearer abc"'),
        "bearer_token": ("Authorization: Bearer abcdefghij0123456789", "bearer a.b-c_d~e+f/g0123456=="),
    }
    no = {
        "uuid": ("07409496-a423-4a3e-b620-2cfb01a9318", "07409496a4234a3eb6202cfb01a9318d"),
        "gps_coord": ("latitude: 52", "lat = 52.51", "flat: 52.51630", "lng=999.12345"),
        "username_path": ("/usr/share/home", "/Users", "/homes/x"),
        "username_path_win": (r"C:\Windows\x", r"C:\Users"),
        "aws_secret_key_kv": ("aws_secret_access_key = short", "secret = " + "x" * 40),
        "private_key_kv": ("PrivateKey = short", "public_key = " + "A" * 43),
        "token_kv": ("token = abc", "api key abc"),
        "bearer_token": ("bearer of bad news", "Bearer short"),
    }
    for name, texts in yes.items():
        assert all(hit(name, t) for t in texts), (name, [t for t in texts if not hit(name, t)])
    for name, texts in no.items():
        assert not any(hit(name, t) for t in texts), (name, [t for t in texts if hit(name, t)])


def test_sanitizer(spark):
    secret = "password=hunter22 mail a.b@c.org /Users/anna/x Bearer abcdefghijklmnop1234"
    df = spark.createDataFrame([(1, secret, "/home/über/doc v1.2.3.4"), (2, None, None)], "id long, properties string, path string")
    clean, before = sanitize.sanitize_output({"observations": df})
    text = clean["observations"].first().properties
    assert before["observations"] > 3 and not any(x in text for x in ("hunter22", "a.b@c.org", "anna", "abcdefghijkl"))
    files = sanitize.redact(df.select("id", "path"), "files").first().path
    assert files == "[REDACTED_USERNAME_PATH]/doc v1.2.3.4"
    assert sum(sanitize.verify_clean(clean).values()) == 0
    found = sanitize.fingerprints(df, "observations", "properties", b"key").collect()
    want = hmac.new(b"key", b"a.b@c.org", hashlib.sha256).hexdigest()[:16]
    assert ("email", want) in [tuple(r) for r in found] and not any("@" in r.fingerprint for r in found)
    assert sanitize.sanitization_status({"sanitize_status": "FAILED: x"}) == "failed" and sanitize.sanitization_status(None) == "unknown"
    assert sanitize.sanitization_status({"sanitize_skipped": "true"}) == "skipped"
    assert {r.column: r.cells for r in sanitize.changed_cells(df, "observations").collect()} == {"properties": 1, "path": 1}


def test_stix(spark):
    one = spark.range(1)
    assert one.select(stix.uuid5(F.lit("näme"))).first()[0] == str(uuid.uuid5(stix.NAMESPACE, "näme"))
    at = lambda t: one.select(stix.timestamp(F.lit(t).cast("string"), "2026-01-01T00:00:00Z")).first()[0]
    assert at("2026-07-18T12:34:56+05:00") == "2026-07-18T07:34:56Z" and at("2026-07-18 12:34:56") == "2026-07-18T12:34:56Z"
    assert at(None) == at("") == "2026-01-01T00:00:00Z" and at("2026-07-18T12:34:56.120Z") == "2026-07-18T12:34:56.12Z"
    files = spark.createDataFrame([(1, "f", 0, "", "/f", "t")], "id long, filename string, size long, sha256 string, path string, file_type string")
    body = json.loads(stix.files(files, "2026-01-01T00:00:00Z").first().json)
    assert body["name"] == "f" and "size" not in body and "hashes" not in body
    seen = spark.createDataFrame([(5, "files", 1, "2026-01-01T00:00:00Z", "e")], "id long, entity_table string, entity_id long, observed_at string, event_type string")
    out = stix.export({"files": files, "observations": seen}, "2026-01-01T00:00:00Z", ("observations",))
    objects = {r.type: json.loads(r.json) for r in out.collect()}
    assert objects["observed-data"]["object_refs"] == [objects["file"]["id"]]
    assert stix.bundle_id(out) == stix.bundle_id(out.repartition(5))
    with pytest.raises(stix.ReferenceError_):
        stix.export({"files": files.limit(0), "observations": seen}, "2026-01-01T00:00:00Z")


def test_header_columns(spark):
    elf = b"\x7fELF" + b"\0" * 14 + struct.pack("<H", 0x3E)
    pe = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<H", 0x8664)
    df = spark.createDataFrame([(bytearray(elf),), (bytearray(pe),), (bytearray(b"MZ"),), (bytearray(b""),)], "c binary")
    assert [tuple(r) for r in df.select(C.elf_arch(F.col("c")), C.pe_arch(F.col("c"))).collect()] == [("x86_64", None), (None, "x86_64"), (None, "unknown"), (None, None)]
    units = ["[Service]\nExecStart=-/bin/a --x\nExecStart=/bin/b", "ExecStart = @ /bin/c", "nothing"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in units], "u string").select(C.exec_start(F.col("u"))).collect()] == ["/bin/a", "/bin/c", ""]
    assert [r[0] for r in C.entropy(spark.createDataFrame([(1, bytearray(range(256))), (2, bytearray(b"aab")), (3, bytearray(b""))], "id long, content binary")).select("shannon_entropy").collect()] == [8.0, 0.9183, None]


@pytest.fixture
def tree(tmp_path):
    def put(path, data):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data if isinstance(data, bytes) else data.encode())

    return tmp_path, put


def test_linux(spark, tree):
    root, put = tree
    elf = b"\x7fELF" + b"\0" * 14 + struct.pack("<H", 0xB7)
    put("etc/passwd", "root:x:0:0")
    put("usr/bin/tool", elf)
    put("usr/lib/libx.so", elf)
    put("etc/systemd/system/tool.service", "[Service]\nExecStart=/usr/bin/tool -v\n")
    os.symlink("tool", root / "usr/bin/link")
    parser = readers.Linux()
    assert parser.identify(str(root))
    t = parser.extract_relationships(parser.extract_entities(spark, str(root)))
    assert {n: d.count() for n, d in t.items()} == {"files": 5, "binaries": 1, "daemons": 1, "frameworks": 1}
    assert t["binaries"].first().arch == "aarch64" and t["daemons"].first().binary_id is not None
    assert t["files"].where("is_symlink = 1").first().sha256 is None
    assert t["files"].where("filename = 'tool'").first().sha256 == hashlib.sha256(elf).hexdigest()
    with pytest.raises(ValueError):
        parser.verify({"files": t["files"].limit(0)})


def test_windows_and_generic(spark, tree):
    root, put = tree
    pe = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<H", 0x014C)
    put("app.exe", pe)
    put("x/lib.dll", pe)
    put("data.json", '{"b": 1, "a": 2}')
    put("list.json", "[1]")
    put("a.xml", "<r/>")
    db = sqlite3.connect(root / "s.db")
    db.execute("CREATE TABLE t1 (a)")
    db.commit()
    db.close()
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("in.txt", "x")
    with tarfile.open(root / "t.tgz", "w:gz") as t:
        info = tarfile.TarInfo("member")
        info.size = 1
        t.addfile(info, io.BytesIO(b"x"))
    w = readers.Windows().extract_entities(spark, str(root))
    assert (w["binaries"].count(), w["frameworks"].first().name) == (2, "lib")
    assert {r.file_type for r in w["files"].collect()} >= {"binary", "dylib", "config"}
    seen = lambda p: [r.properties for r in p.extract_entities(spark, str(root))["observations"].collect()]
    assert seen(readers.GenericJson()) == ['["a","b"]']
    assert [json.loads(x) for x in seen(readers.GenericSqlite())] == [{"schema_tables": "t1"}]
    assert sorted(json.loads(x)["archive_contents"] for x in seen(readers.GenericArchive())) == ["in.txt", "member"]
    assert len(seen(readers.GenericBinary())) == 8
    assert readers.GenericXml().extract_entities(spark, str(root))["files"].count() == 1


def macho_file(entitlements):
    plist = plistlib.dumps(entitlements)
    blob = struct.pack(">II", 0xFADE7171, 8 + len(plist)) + plist
    directory = struct.pack(">IIII", 0xFADE0C02, 16, 0x20400, 0x12000)
    body = struct.pack(">III", 0xFADE0CC0, 28 + len(directory) + len(blob), 2) + struct.pack(">IIII", 0, 28, 5, 28 + len(directory)) + directory + blob
    head = struct.pack("<IIIIIIII", 0xFEEDFACF, 0x0100000C, 0, 2, 1, 16, 0, 0) + struct.pack("<IIII", 0x1D, 16, 48, len(body))
    return head + body


def test_apple(spark, tree):
    root, put = tree
    put("System/Library/CoreServices/SystemVersion.plist", plistlib.dumps({"ProductVersion": "1"}))
    put("usr/libexec/agentd", macho_file({"com.x.allow": True, "com.x.list": ["a"]}))
    put("System/Library/LaunchDaemons/a.plist", plistlib.dumps({"Label": "com.x.a", "Program": "/usr/libexec/agentd", "MachServices": {"com.x.s2": True, "com.x.s1": True}, "UserName": "root"}, fmt=plistlib.FMT_BINARY))
    put("Library/LaunchDaemons/b.plist", plistlib.dumps({"Label": "com.x.a", "ProgramArguments": ["/other"], "MachServices": {"dropped": True}}))
    put("System/Library/Extensions/K.kext/Info.plist", plistlib.dumps({"CFBundleIdentifier": "k", "CFBundleName": "K", "IOKitPersonalities": {"p": {"IOClass": "C", "IOUserClientClass": "U"}}}))
    put("System/Library/PrivateFrameworks/F.framework/Info.plist", plistlib.dumps({"CFBundleIdentifier": "f"}))
    put("usr/share/sandbox/p.sb", "(version 1)")
    put(".hidden/x", "x")
    parser = readers.Apple()
    assert parser.identify(str(root))
    t = parser.extract_relationships(parser.extract_entities(spark, str(root)))
    counts = {n: d.count() for n, d in t.items()}
    assert counts == {"files": 7, "binaries": 1, "entitlements": 2, "daemons": 1, "mach_services": 2, "kexts": 1, "frameworks": 1, "sandbox_profiles": 1}
    binary, daemon = t["binaries"].first(), t["daemons"].first()
    assert (binary.arch, binary.code_sign_flags) == ("arm64", "0x12000") and daemon.binary_id == binary.id and daemon.plist_path.startswith("/System")
    assert {(r.key, r.value, r.value_type) for r in t["entitlements"].collect()} == {("com.x.allow", "true", "boolean"), ("com.x.list", '["a"]', "array")}
    assert t["kexts"].first().has_user_client == 1 and t["frameworks"].first().is_private == 1
    assert readers.macho.info(b"\xcf\xfa\xed\xfe") is None and readers.macho.info(b"") is None


TRAIL = [
    {"eventVersion": "1", "eventSource": "s", "eventID": "1", "eventName": "N", "eventTime": "2025-01-01T00:00:00Z", "userIdentity": {"arn": "u1", "type": "T", "accountId": "7"}, "requestParameters": {}},
    {"eventVersion": "1", "eventSource": "s", "eventID": "2", "eventName": "N", "eventTime": "2025-01-01T00:00:00Z", "userIdentity": {"arn": "u1"}},
    {"eventVersion": "1", "eventSource": "s", "eventID": "2", "eventName": "N", "eventTime": "2025-01-01T00:00:00Z", "userIdentity": {"arn": "u1"}},
    {"eventVersion": "1", "eventSource": "s", "eventName": "N", "eventTime": None, "userIdentity": {"arn": "u2"}},
    {"eventVersion": "1", "eventSource": "s", "eventName": "N", "userIdentity": {}},
]


def test_trail_build_query_diff_and_command_line(spark, tree, capsys):
    root, put = tree
    put("src/a.json", json.dumps({"Records": TRAIL}))
    put("src/b.json", json.dumps(TRAIL[:1]))
    out = str(root / "out")
    assert cli.main(["build", "--source", str(root / "src"), "--output", out], spark) == 0
    assert cli.main(["build", "--source", str(root / "src"), "--output", out], spark) == 1
    space = Workspace(spark, out)
    t = space.tables()
    assert (t["files"].count(), t["daemons"].count(), t["observations"].count(), space.status()) == (2, 2, 2, "verified")
    assert t["versions"].first().completed_at and t["files"].first().source_version_id == 1
    seen = [json.loads(r.properties) for r in t["observations"].orderBy("properties").collect()]
    assert {"eventID": "1", "requestParameters": "{}"} in seen
    assert cli.main(["query", out, "--sql", "SELECT label FROM daemons ORDER BY label"], spark) == 0 and "| u1 |" in capsys.readouterr().out
    assert cli.main(["query", out, "--sql", "DELETE FROM daemons"], spark) == 2
    assert cli.main(["query", out, "--search", "u2", "--table", "daemons"], spark) == 0 and "u2" in capsys.readouterr().out
    assert cli.main(["query", out, "--stats"], spark) == 0 and "daemons: 2" in capsys.readouterr().out
    put("src/c.json", json.dumps([TRAIL[0] | {"eventID": "9", "userIdentity": {"arn": "u3"}}]))
    two = str(root / "two")
    assert cli.main(["build", "--source", str(root / "src"), "--output", two, "--skip-sanitize", "--resolve"], spark) == 0
    assert Workspace(spark, two).status() == "skipped" and Workspace(spark, two).tables()["bags"].count() > 0
    capsys.readouterr()
    assert cli.main(["diff", out, two, "--stix", str(root / "stix")], spark) == 0 and "u3" in capsys.readouterr().out
    assert spark.read.text(str(root / "stix")).where("value LIKE '%note--%'").count() > 0
    assert cli.main(["exec", two, "--sql", "DELETE FROM daemons WHERE label = 'u3'"], spark) == 0 and "affected rows: 1" in capsys.readouterr().out
    assert cli.main(["exec", two, "--sql", "UPDATE daemons SET user_name = 'n' WHERE label = 'u1'"], spark) == 0
    assert Workspace(spark, two).tables()["daemons"].where("user_name = 'n'").count() == 1
    assert cli.main(["exec", two, "--sql", "DROP TABLE daemons"], spark) == 1
    assert cli.main(["resolve", "--out", str(root / "res"), "--entity-type", "daemons", out, two], spark) == 0
    assert Workspace(spark, str(root / "res")).tables()["bags"].where("atom_count = 2").count() == 2
    assert cli.main(["resolve", "--out", str(root / "r2"), "--threshold", "2", out], spark) == 1
    assert cli.main(["parser", "list"], spark) == 0
    rewritten = Workspace(spark, out).tables()["metadata"].where("key <> 'sanitize_status'").unionByName(spark.createDataFrame([("sanitize_status", "FAILED")], "key string, value string"))
    Workspace(spark, out).save(t | {"metadata": spark.createDataFrame(rewritten.collect(), "key string, value string")})
    assert cli.main(["query", out, "--stats"], spark) == 3
    assert cli.main(["query", out, "--stats", "--allow-unverified"], spark) == 0


def test_gates(spark, tree):
    root, put = tree
    put("a.json", json.dumps({"Records": TRAIL[:2]}))
    results = harness.run_gates(readers.Trail(), spark, str(root), {"entity_counts": {"files": 1, "daemons": 1}, "observation_count": 2})
    assert [(r.name, r.passed) for r in results] == [("golden", True), ("conformance", True), ("idempotency", True), ("zero_findings", True)], results
    assert not harness.golden(readers.Trail(), spark, str(root), {"entity_counts": {"files": 3}}).passed


def test_registry(tmp_path):
    r = registry.Registry()
    r.discover()
    assert {p["name"] for p in r.list()} == {n for n, _, _ in registry.SPECIFICITY}
    with pytest.raises(ValueError, match="windows"):
        r.get("nope")
    (tmp_path / "a.json").write_text("{}")
    assert r.detect(str(tmp_path)) == "generic_json" and r.detect(str(tmp_path / "none")) is None
    good = tmp_path / "m.yaml"
    good.write_text("id: my_parser\nname: My\nversion: 1.0.0\ntier: production\nevent_types:\n  - a\n  - b\n")
    m = registry.load_manifest(str(good))
    assert (m.specificity, m.confidence, m.event_types) == (50, 0.5, ["a", "b"])
    for bad in ("extra: 1", "tier: odd", "specificity: 0", "reliability: Z"):
        (tmp_path / "bad.yaml").write_text(good.read_text() + bad + "\n")
        with pytest.raises(ValueError):
            registry.load_manifest(str(tmp_path / "bad.yaml"))
    assert len(registry.catalogs(str(tmp_path))["production"]) == 1


def test_resume_and_fingerprint(spark, tmp_path):
    calls = []

    def phase(name, fail=False):
        def run(c):
            calls.append(name)
            if name == "one":
                c.tables = schema.empty(spark)
            if fail and calls.count(name) == 1:
                raise RuntimeError("broken")
            return {}

        return Phase(name, run)

    out = str(tmp_path / "w")
    flow = Pipeline([phase("one"), phase("two", True)], "mark")
    with pytest.raises(RuntimeError, match="broken"):
        flow.run(Context(spark, "s", out, "p"))
    assert not os.path.exists(out)
    with pytest.raises(FingerprintMismatch):
        Pipeline([phase("one")], "other").run(Context(spark, "s", out, "p"))
    flow.run(Context(spark, "s", out, "p"))
    assert calls == ["one", "two", "two"]
    with pytest.raises(OutputExists):
        flow.run(Context(spark, "s", out, "p"))


def test_schema(spark):
    tables = schema.empty(spark)
    schema.validate(tables)
    old = {n: tables[n] for n in tables if n not in ("mach_services", "atoms", "bags", "bag_atoms", "resolution_event_log", "match_candidates")}
    assert set(schema.upgrade(old, 2)) == set(schema.DDL)
    with pytest.raises(schema.SchemaVersionError):
        schema.upgrade(old, 9)
    with pytest.raises(schema.SchemaValidationError):
        schema.validate(old)
    broken = tables | {"bag_atoms": spark.createDataFrame([(1, 2), (1, 2)], "bag_id long, atom_id long")}
    assert schema.link_violations(broken).count() == 2
    assert {r.table_name for r in schema.duplicate_keys(broken).where("repeated > 0").collect()} == {"bag_atoms"}


def test_streaming(spark, tmp_path):
    rows = [(1, "2025-01-01 00:00:00", "a"), (1, "2025-01-01 00:01:00", "a"), (2, "2025-01-01 02:00:00", "b"), (3, "2025-01-01 00:05:00", "a")]
    df = spark.createDataFrame(rows, "k long, at string, kind string").select("k", F.to_timestamp("at").alias("at"), "kind")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = lambda: stream.read_stream(spark, str(tmp_path / "in"), "k long, at timestamp, kind string")
    assert sorted(r.k for r in stream.run_once(stream.deduplicated(s(), ["k"], "at"), "s1").collect()) == [1, 2, 3]
    counted = stream.run_once(stream.windowed(s(), "at", ["kind"]), "s2", "complete").collect()
    assert {(str(r.window_start), r.kind): r.n for r in counted} == {("2025-01-01 00:00:00", "a"): 3, ("2025-01-01 02:00:00", "b"): 1}
    assert {(r.kind, r.n) for r in stream.run_once(stream.sessions(s(), "at", "kind"), "s3", "complete").collect()} == {("a", 3), ("b", 1)}
    first = {r.kind: str(r.first_time) for r in stream.run_once(stream.first_seen(s(), "kind", "at"), "s4", "update").collect()}
    assert first == {"a": "2025-01-01 00:00:00", "b": "2025-01-01 02:00:00"}


def test_scan_query_reads_every_text_column(spark, tmp_path):
    from lodeworks.plans.exports import h04_scan_files

    rows = spark.createDataFrame([(1, "/x", "x", None, "/Users/ann/o", "y")], "id long, path string, filename string, symlink_target string, owner string, group_name string")
    rows.write.parquet(str(tmp_path / "files.parquet"))
    assert [tuple(r) for r in h04_scan_files(spark, str(tmp_path)).collect()] == [("owner", "username_path", 1)]


def test_search_folds_data_and_query_alike(spark):
    import unicodedata

    from lodeworks.operators import textsearch

    texts = ["été à Paris", unicodedata.normalize("NFD", "été à Paris"), "tiếng Việt", "ΑΘΉΝΑ", "Straße", None, "plain ascii"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for needle, want in (("ete", [0, 1]), ("ÉTÉ", [0, 1]), ("tieng viet", [2]), ("αθηνα", [3]), ("Αθήνα", [3]), ("straße", [4]), ("plain", [6])):
        assert [r.id for r in textsearch.search(rows, needle, ["text"]).collect()] == want, needle


def test_apple_headers_that_are_damaged():
    from lodeworks.sources import macho

    good = macho_file({"com.x.allow": True})
    assert macho.info(good)["arch"] == "arm64" and macho.info(good)["entitlements"] == {"com.x.allow": True}
    e = bytearray(good)
    e[8:12] = struct.pack("<I", 0x80000002)
    assert macho.info(bytes(e))["arch"] == "arm64e"
    spoiled = good.replace(b"<plist", b"<plast")
    assert macho.info(spoiled) == {"arch": "arm64", "code_sign_flags": "0x12000", "entitlements": {}}
    for cut in (40, 47, 60, 90):
        assert macho.info(good[:cut])["arch"] == "arm64"


def test_no_code_through_sql(spark):
    for bad in ("SELECT reflect('java.lang.System', 'exit', 1)", "SELECT Java_Method ('a', 'b')", "SELECT try_reflect('a', 'b')", "SELECT `reflect`('a', 'b')", "SELECT /* x */ reflect /* y */ ('a', 'b')"):
        with pytest.raises(query.ReadOnlyViolation):
            query.guard_reading(spark, bad)
    query.guard_reading(spark, "SELECT 'reflect(x)' AS reflection")


def test_bundle_file(spark, tmp_path):
    from lodeworks.operators import stix

    ddl = "id long, label string, program string, user_name string, mach_services string, observed_time string"
    rows = spark.createDataFrame([(1, "a", "/p", "root", None, "2026-07-18T12:34:56+05:00"), (2, "b", None, None, None, None)], ddl)
    objects = stix.export({"daemons": rows}, "2026-02-01T00:00:00Z", ("daemons",))
    path = str(tmp_path / "out.json")
    own = stix.write_bundle(objects, path)
    bundle = json.loads(open(path, encoding="utf-8").read())
    assert bundle["type"] == "bundle" and bundle["id"] == own == stix.bundle_id(objects.repartition(3)) and len(bundle["objects"]) == 2
    first = next(o for o in bundle["objects"] if o["name"] == "a")
    assert first["created"] == first["modified"] == "2026-07-18T07:34:56Z" and first["infrastructure_types"] == ["hosting-target"]
    assert stix.bundle_id(objects.limit(1)) != own


def test_failed_sanitation_leaves_a_mark(spark, tmp_path, monkeypatch):
    from lodeworks import pipeline, schema
    from lodeworks.workspace import Workspace

    def fail(c):
        raise sanitize.SanitizationFailed("left")

    def start(c):
        c.tables = schema.empty(c.spark)
        c.tables["files"] = schema.conform(c.spark.createDataFrame([(1, "/secret")], "id long, path string"), "files")
        return {}

    out = str(tmp_path / "ws")
    run = pipeline.Pipeline([pipeline.Phase("init", start), pipeline.Phase("sanitize", fail)], "mark")
    with pytest.raises(sanitize.SanitizationFailed):
        run.run(pipeline.Context(spark, "src", out, "p", started_at="2026-01-01T00:00:00Z"))
    tables = Workspace(spark, out).tables()
    status = sanitize.sanitization_status({r["key"]: r["value"] for r in tables["metadata"].collect()})
    assert status == "failed" and tables["files"].count() == 0
    with pytest.raises(PermissionError):
        query.EntityQuery(spark, tables, status)


def test_listing_in_tasks_equals_a_walk(spark, tmp_path):
    import os

    from lodeworks.sources.base import catalog, walk

    for i in range(40):
        folder = tmp_path / f"d{i % 7}" / f"e{i % 3}" / f"f{i}"
        folder.mkdir(parents=True)
        (folder / f"Name {i}.TXT").write_text("x" * i)
    (tmp_path / "top.so.1").write_text("t")
    os.symlink("d0", tmp_path / "link")
    os.symlink("/nowhere", tmp_path / "d1" / "broken")
    with open(os.fsencode(tmp_path) + b"/d2/bad\xff.bin", "wb") as f:
        f.write(b"1")
    want = sorted(walk(str(tmp_path)), key=str)
    assert len(want) == 44
    for most in (1, 5, 2000):
        got = sorted((tuple(r) for r in catalog(spark, str(tmp_path), most).collect()), key=str)
        assert got == want, most
