"""P2 operator: intervals, paths and dirty bodies."""

import json
import random

from lodeworks.functions.jsonwalk import parse, records
from lodeworks.operators import nested


def brute(body):
    """Elements by plain recursion."""
    out = []

    def go(node, path, side, pos, arn):
        if isinstance(node, dict):
            for k, v in node.items():
                go(v, f"{path}.{k}" if path else k, side, pos, arn)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                out.append((pos, arn, side, path, i))
                go(v, f"{path}[{i}]", side, pos, arn)

    for pos, r in enumerate(records(body)):
        if isinstance(r, dict):
            who = r.get("userIdentity")
            arn = (who.get("arn") if isinstance(who, dict) else None) or ""
            for side in nested.SIDES:
                v = r.get(side)
                if isinstance(v, str):
                    try:
                        v = json.loads(v)
                    except ValueError:
                        v = None
                if isinstance(v, (dict, list)):
                    go(v, "", side, pos, arn)
    return out


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, 1, 2.5, True, "t", "[1, 2]"])
    if rng.random() < 0.5:
        return [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abc"): tree(rng, depth - 1) for _ in range(rng.randint(0, 3))}


def record(rng):
    r = {"eventName": "x", "userIdentity": rng.choice([None, {}, {"arn": "u"}, {"arn": None}]), "requestParameters": tree(rng, 4), "responseElements": tree(rng, 4)}
    if rng.random() < 0.3:
        r["requestParameters"] = json.dumps(r["requestParameters"])
    return r


def run(spark, bodies):
    df = nested.array_items(spark.createDataFrame(list(enumerate(bodies)), "raw_id long, body string"))
    return sorted(tuple(r) for r in df.collect())


def test_against_recursion(spark):
    rng = random.Random(3)
    bodies = []
    for i in range(60):
        rs = [record(rng) for _ in range(rng.randint(1, 4))]
        bodies.append(json.dumps([rs, {"Records": rs}, rs[0], {"source": "s", "detail": rs[0]}, json.dumps(rs)][i % 5]))
    bodies[3] = "﻿" + bodies[3]
    want = sorted((i, *row) for i, b in enumerate(bodies) for row in brute(b))
    assert want and run(spark, bodies) == want


def test_dirty_bodies(spark):
    assert run(spark, [None, "", "  ", "{", '{"Records": [{"requestParameters": {"a": [1]}}', "[]", "{}", "null", "3", '"text"']) == []


def test_intervals_contain_exactly_the_descendants():
    rows = list(nested.walk(json.dumps([{"eventName": "x", "requestParameters": {"a": [[1, None], {"b": []}]}}])))
    records_ = [r for r in rows if r[4] == "record"]
    assert all(records_[0][1] < r[1] and r[2] < records_[0][2] for r in rows if r[4] != "record")
    pres, posts = [r[1] for r in rows], [r[2] for r in rows]
    assert sorted(pres) == list(range(len(rows))) and sorted(posts) == list(range(len(rows)))
    items = [(r[6], r[7]) for r in rows if r[4] == "item"]
    assert sorted(items) == [("a", 0), ("a", 1), ("a[0]", 0), ("a[0]", 1)]


def test_very_deep_and_very_long(spark):
    deep = '{"eventName": "x", "requestParameters": {"a": ' + "[" * 4_000 + "]" * 4_000 + "}}"
    df = nested.array_items(spark.createDataFrame([(1, deep)], "raw_id long, body string"))
    assert df.count() == 3_999
    assert len(records("[" * 300_000 + "]" * 300_000)) == 1
    wide = json.dumps({"eventName": "x", "requestParameters": {"a": list(range(70_000))}})
    assert len(run(spark, [wide])) == 70_000


def test_own_parser_agrees():
    from lodeworks.functions.jsonwalk import _deep

    rng = random.Random(5)
    for _ in range(200):
        text = json.dumps(tree(rng, 5), indent=rng.choice([None, 1]))
        assert _deep(text, False) == json.loads(text) == parse(text)
    for bad in ("", "[", "[1", "[1,]", '{"a" 1}', '{"a": 1,}', "[1] 2", "tru"):
        try:
            _deep(bad, False)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_wrapped_any_number_of_times():
    import json

    from lodeworks.functions.jsonwalk import records

    body = json.dumps([{"eventName": "x", "requestParameters": {"a": [1]}}])
    for _ in range(12):  # every wrapping doubles the escapes
        body = json.dumps(body)
        assert len(records(body)) == 1
    deep = {"eventName": "x"}
    for _ in range(3000):
        deep = {"detail": deep}
    from lodeworks.functions.jsonwalk import _unwrap

    assert _unwrap(deep, False) == [{"eventName": "x"}]


def test_links_agree_with_the_join(spark):
    import json
    import random

    from lodeworks.operators.nested import array_items, inside, shred

    rng = random.Random(12)
    bodies = []
    for i in range(60):
        records = [{"userIdentity": {"arn": f"arn:{i % 3}"}, "requestParameters": tree(rng, 4), "responseElements": {"x": tree(rng, 3)}} for _ in range(rng.randint(0, 4))]
        bodies.append((i, json.dumps({"Records": [*records, None, 7]})))
    bodies += [(100, None), (101, ""), (102, '{"Records": [{"a"'), (5, bodies[5][1])]
    df = spark.createDataFrame(bodies, "raw_id long, body string")
    joined = inside(shred(df, types=("item",)), shred(df, types=("record",)).dropDuplicates(["doc_id", "record_pos"]), {"arn": "value"})
    want = sorted(map(tuple, joined.select("doc_id", "record_pos", "arn", "side", "array_path", "item_pos").collect()))
    assert sorted(map(tuple, array_items(df).collect())) == want and len(want) > 100
