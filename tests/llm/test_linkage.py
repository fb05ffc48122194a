"""P3 operator: planted matches, look-alikes, ties and the solver against its optimum."""

import hashlib

import pytest

from lodeworks.llm import linkage

BIN = "id long, bundle_id string, executable_name string, sha256 string, path string"
FILES = "path string, sha256 string, file_type string, id long"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def run(spark, binaries, files):
    df = linkage.match(spark.createDataFrame(binaries, BIN), spark.createDataFrame(files, FILES))
    return {r.binary_id: r.path for r in df.collect()}


ONE = "/Applications/Sokijaju/Todre Hugri.app/Contents/MacOS/Runner"
TWO = "/Library/Application Support/sokijaju/Melavi.app/Contents/MacOS/melavid"
THREE = "/Applications/Kladrino.app/Contents/MacOS/Kladrino"


def test_matches(spark):
    files = [(ONE, h("1"), "macho", 1), (ONE.replace("/Runner", "//Runner"), h("1b").upper(), "macho", 2), (TWO, h("2"), "macho", 3), (THREE, None, None, 4), (None, h("9"), "macho", 5), ("/etc/other.conf", h("2"), "conf", 6)]
    binaries = [
        (1, None, None, "sha256:" + h("1b"), "p"),
        (2, "com.sokijaju.TodreHugri", "Runner", None, "p"),
        (3, "9A9614FF4E.com.sokijaju.melavi.helper", "MELAVID", None, "p"),
        (4, "com.sokijaju.melaviLite", "melavid", h("unknown"), "p"),
        (5, None, "Kladrino (deleted)", None, "p"),
        (6, "org.x.kladirno", None, None, "p"),
        (7, None, "Runner", None, "p"),
        (8, None, None, None, "p"),
        (9, "com.sokijaju.TodreHugri", "Runner", h("2")[:12], "p"),
        (10, "com.elsewhere.melavi", "melavid", None, "p"),
        (2, "com.sokijaju.TodreHugri", "Runner", None, "p"),
    ]
    got = run(spark, binaries, files)
    assert {k: got.get(k) for k in (1, 2, 3, 5, 6)} == {1: ONE, 2: ONE, 3: TWO, 5: THREE, 6: THREE}
    assert not {4, 7, 8, 10} & got.keys()


def test_ties_and_shared_contents(spark):
    files = [("/Applications/A/Onenen.app/Contents/MacOS/Onenen", h("s"), "macho", 1), ("/Applications/B/Twoten.app/Contents/MacOS/Twoten", h("s"), "macho", 2)]
    binaries = [(1, "com.b.Twoten", None, h("s"), "p"), (2, None, None, h("s"), "p")]
    assert run(spark, binaries, files) == {1: files[1][0]}


def test_hot_contents(spark):
    files = [(f"/Applications/V{i}/Name{i:03d}x.app/Contents/MacOS/Runner", h("hot"), "macho", i) for i in range(200)]
    binaries = [(i, None, None, h("hot"), "p") for i in range(200)] + [(900, "com.v7.Name007x", "Runner", h("hot"), "p")]
    assert run(spark, binaries, files) == {900: files[7][0]}


def test_empty(spark):
    assert run(spark, [], [(ONE, h("1"), "macho", 1)]) == {} and run(spark, [(1, "a.b.c", "d", None, "p")], []) == {}


def test_shared_keys_of_any_size(spark):
    """One file more or less than are expanded changes no result; a second kind of evidence finds its pair in a class."""
    for n in (linkage.Rules.explicit - 1, linkage.Rules.explicit, linkage.Rules.explicit + 1, 300):
        files = [(f"/Applications/V{i}/Common.app/Contents/MacOS/Exec{i:03d}", h(f"c{i}"), "macho", i) for i in range(n)]
        files += [("/Applications/Solo/Uniqueone.app/Contents/MacOS/Uniqueone", h("solo"), "macho", 999)]
        binaries = [(1, "com.v7.Common", None, None, "p"), (2, None, "Exec007", h("c7"), "p"), (3, "org.other.Common", None, None, "p"), (4, None, None, h("solo"), "p"), (5, "Common", "Exec011", None, "p"), (6, "x.Common", "Exec011", None, "p")]
        got = run(spark, binaries, files)
        assert {k: got.get(k) for k in (1, 2, 3, 4, 5, 6)} == {1: files[7][0], 2: files[7][0], 3: None, 4: files[-1][0], 5: files[11][0], 6: None}, n
    w = linkage.Rules().weights
    most = sum(w[k] for k in ("hash", "name", "vendor_name", "exec")) / (linkage.Rules.explicit + 1)
    assert most / (most + w["prior"]) < linkage.Rules.accept


PAIRS = "bid long, fid long, path string, grp long, a double, b double, mult long"


def objective(rows, y, q, same):
    return sum(m * (a * max(0, 1 - y[b, f]) ** 2 + c * y[b, f] ** 2) + (same * (y[b, f] - q[g, f]) ** 2 if m == 1 else 0) for b, f, _, g, a, c, m in rows)


def best_by_descent(rows, same, steps=20000, rate=0.004):
    """The optimum by projected gradient steps, records and things in turn."""
    y, q = {(r[0], r[1]): 0.3 for r in rows}, {(r[3], r[1]): 0.3 for r in rows if r[6] == 1}
    bids = {r[0] for r in rows}
    for _ in range(steps):
        for key in q:
            mine = [y[r[0], r[1]] for r in rows if (r[3], r[1]) == key and r[6] == 1]
            q[key] = sum(mine) / len(mine)
        for b, f, _, g, a, c, m in rows:
            y[b, f] -= rate * (-2 * a * (1 - y[b, f]) + 2 * c * y[b, f] + (2 * same * (y[b, f] - q[g, f]) if m == 1 else 0))
        for b in bids:
            mine = [(r[1], r[6]) for r in rows if r[0] == b]
            lo, hi = 0.0, 10.0
            if sum(m * max(0.0, y[b, f]) for f, m in mine) > 1:
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if sum(m * max(0.0, y[b, f] - mid) for f, m in mine) > 1 else (lo, mid)
            else:
                hi = 0.0
            for f, _m in mine:
                y[b, f] = max(0.0, y[b, f] - hi)
    return y, q


@pytest.mark.parametrize("same", [0.5, 8.0])
def test_solver_reaches_the_optimum(spark, same):
    rows = [(1, 10, "x", 1, 3.0, 1.0, 1), (1, 11, "y", 1, 2.0, 1.0, 1), (2, 10, "x", 1, 1.0, 2.0, 1), (2, 11, "y", 1, 4.0, 1.0, 1), (3, 10, "x", 2, 1.0, 3.0, 1), (4, 12, "z", 3, 3.0, 1.0, 1), (4, 13, None, 3, 0.5, 1.0, 40)]
    got = {(r.bid, r.fid): r.confidence for r in linkage.solve(spark.createDataFrame(rows, PAIRS), same, tolerance=1e-5).collect()}
    assert got[3, 10] == pytest.approx(0.25, abs=1e-3)
    y, q = best_by_descent(rows, same)
    for key in got:
        if key != (4, 13):
            assert got[key] == pytest.approx(y[key], abs=0.02), key
    assert 40 * got[4, 13] + got[4, 12] <= 1 + 1e-6
    # The stronger the rule, the closer the records of one thing.
    assert abs(got[1, 10] - got[2, 10]) < {0.5: 0.5, 8.0: 0.15}[same]


def test_unsettled_is_an_error(spark):
    rows = [(1, 10, "x", 1, 3.0, 1.0, 1), (2, 10, "x", 1, 1.0, 2.0, 1)]
    with pytest.raises(RuntimeError):
        linkage.solve(spark.createDataFrame(rows, PAIRS), rounds=2, tolerance=1e-12)
