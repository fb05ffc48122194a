"""P8 operator: shares, caps, determinism and dirt."""

import math
import random

import pytest

from lodeworks.llm.mixing import mix, spread, token_counts

DOCS, TARGETS = "doc_id long, source string, text string, copies int", "source string, target_share double, max_repeats int"


def corpus(rng):
    out = []
    for source, n in (("web", 400), ("book", 60), ("tiny", 9), ("other", 50)):
        out += [(len(out) + i, source, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 80))), 1) for i in range(n)]
    return out


def test_targets_and_caps(spark):
    docs = spark.createDataFrame(corpus(random.Random(1)), DOCS)
    targets = spark.createDataFrame([("web", 0.5, 1), ("book", 0.3, 3), ("tiny", 0.1, 5), ("none", 0.1, 2)], TARGETS)
    chosen, shares = mix(docs, targets)
    rows = {r.source: r for r in shares.collect()}
    total = sum(r.chosen_tokens for r in rows.values())
    for name, share, cap in (("web", 0.5, 1), ("book", 0.3, 3), ("tiny", 0.1, 5)):
        assert abs(rows[name].actual_share - share / 0.9) < 80 / total
        assert max(r.copies for r in chosen.where(f"source = '{name}'").collect()) <= cap
    assert rows["none"].actual_share == 0 and set(rows) == {"web", "book", "tiny", "none"}
    assert not any(rows[n].short for n in ("web", "book", "tiny")) and rows["none"].short
    # The scarcest source is used up: no larger total is possible.
    assert any(r.chosen_tokens == cap * r.available_tokens for r, cap in ((rows["web"], 1), (rows["book"], 3), (rows["tiny"], 5)))
    again = {tuple(r) for r in mix(docs.repartition(7), targets, bucket_docs=20)[0].groupBy("source").sum("copies").collect()}
    assert again == {tuple(r) for r in chosen.groupBy("source").sum("copies").collect()}


def test_rates_are_the_tilt_of_the_dual(spark):
    """Within a source log(rate) is proportional to the tokens, and the tokens meet the target."""
    docs = spark.createDataFrame(corpus(random.Random(5)), DOCS)
    targets = spark.createDataFrame([("web", 0.2, 1), ("book", 0.8, 3)], TARGETS)
    chosen, shares = mix(docs, targets, total_tokens=4000)
    told = {r.source: r for r in shares.collect()}
    assert abs(told["web"].chosen_tokens - 800) < 40 and abs(told["book"].chosen_tokens - 3200) < 40
    slopes = {s: [(r.n_tokens, math.log(r.rate) / r.n_tokens) for r in chosen.where(f"source = '{s}'").collect() if r.rate < {"web": 1, "book": 3}[s]] for s in ("web", "book")}
    for found in slopes.values():
        assert len({n for n, _ in found}) > 5 and max(x for _, x in found) == pytest.approx(min(x for _, x in found), rel=1e-6)
    assert slopes["web"][0][1] < 0 < slopes["book"][0][1]
    # Brute force on the sizes: the same multiplier by bisection.
    sizes = [(r.n_tokens) for r in token_counts(docs).where("source = 'web'").collect()]
    lo, hi = -1.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * min(1.0, math.exp(mid * n)) for n in sizes) < 800 else (lo, mid)
    assert slopes["web"][0][1] == pytest.approx(lo, rel=1e-4)


def test_length_neutral(spark):
    docs = spark.createDataFrame(corpus(random.Random(5)), DOCS)
    targets = spark.createDataFrame([("web", 0.2, 1), ("book", 0.8, 1)], TARGETS)
    chosen, shares = mix(docs, targets, length_neutral=True)
    row = {r.source: r for r in shares.collect()}["web"]
    assert abs(row.chosen_tokens / row.chosen_docs - row.available_tokens / row.n_docs) < 0.25 * row.available_tokens / row.n_docs


def test_tiny_source_falls_short_and_keeps_the_rest(spark):
    docs = spark.createDataFrame([(i, "a", "one two three four five", 1) for i in range(1000)] + [(2000, "b", "word", 1)], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], TARGETS)
    rows = {r.source: r for r in mix(docs, targets)[1].collect()}
    assert rows["b"].chosen_copies == 3 and rows["b"].short and not rows["a"].short
    assert abs(rows["a"].chosen_tokens - rows["a"].available_tokens) < 10
    given = {r.source: r for r in mix(docs, targets, total_tokens=6)[1].collect()}
    assert given["b"].chosen_copies == 3 and given["a"].chosen_tokens == 5


def test_spread():
    assert spread(100, {"a": 0.5, "b": 0.5}, {"a": 1000, "b": 10}) == {"a": 90, "b": 10}
    assert spread(100, {"a": 0.5, "b": 0.5}, {"a": 20, "b": 10}) == {"a": 20, "b": 10}
    assert spread(100, {}, {}) == {}


def test_dirt(spark):
    docs = spark.createDataFrame([(1, "a", None, 1), (2, "a", "", 1), (3, None, "text", 1), (4, "x", "text", 1), (None, "a", "text", 1), (5, "a", "some text", 1), (5, "a", "some text", 1), (6, "a", "word " * 60_000, 1)], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 2), ("a", 0.5, 2), ("b", 0.5, 2), (None, 0.5, 2), ("c", 0.0, 2), ("x", None, 1)], TARGETS)
    chosen, shares = mix(docs, targets)
    assert sorted((r.doc_id, r.copies) for r in chosen.collect()) == [(5, 1), (5, 1), (6, 1)]
    doubled = mix(docs, targets, total_tokens=10**9)[0]
    assert sorted((r.doc_id, r.copies) for r in doubled.collect()) == [(5, 2), (5, 2), (6, 2)]
    assert {r.source: r.actual_share for r in shares.collect()} == {"a": 1.0, "b": 0.0}
    chosen, shares = mix(docs.limit(0), targets)
    assert chosen.count() == 0 and all(r.actual_share == 0 for r in shares.collect())


def test_hot_class(spark):
    docs = spark.createDataFrame([(i, "a", "the same text", 1) for i in range(3000)] + [(5000 + i, "b", "one two three four", 1) for i in range(10)], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    shares = {r.source: r for r in mix(docs, targets, total_tokens=160, bucket_docs=100)[1].collect()}
    assert abs(shares["a"].actual_share - 0.5) < 0.03 and shares["b"].chosen_copies == 20


def test_counts(spark):
    rows = token_counts(spark.createDataFrame([(1, "a", "hello world", 1), (2, "a", None, 1), (3, "a", "", 1)], DOCS)).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(1, 2), (2, 0), (3, 0)]
