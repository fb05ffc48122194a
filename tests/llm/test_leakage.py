"""P7 operator: exact leaks against brute force, recall of edited ones, dirt."""

import random
import unicodedata

from lodeworks.llm.leakage import Embedder, ItemIndex, Plan, class_bound, edits_in, embeddings_for, find_leaks, normal_words, sample_passages, size_class, _scan

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
RUN = Plan.run


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abdefghiklmnoprstué") for _ in range(rng.randint(2, 10))) for _ in range(n)]


def garble(rng, words):
    out = []
    for w in words:
        w = rng.choice([w, w.upper(), w.capitalize(), unicodedata.normalize("NFD", w), w[:1] + "​" + w[1:], w + ",", "“" + w + "”"])
        out.append(w)
    return rng.choice([" ", "\n", "  ", " "]).join(out)


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = normal_words(t)
        for k in range(len(w) - RUN + 1):
            grams.setdefault(tuple(w[k : k + RUN]), set()).add(i)
    out = set()
    for d, t in docs:
        w = normal_words(t)
        for k in range(len(w) - RUN + 1):
            out |= {(i, d) for i in grams.get(tuple(w[k : k + RUN]), ())}
    return out


def test_exact_against_brute_force(spark):
    rng = random.Random(2)
    words = vocabulary(rng)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(40)]
    docs = []
    for d in range(150):
        body = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if d % 2:
            source = items[rng.randrange(40)][1].split()
            n = rng.choice([9, 11, 12, 13, 20])
            k = rng.randrange(max(1, len(source) - n))
            at = rng.randint(0, len(body))
            body[at:at] = source[k : k + n]
        docs.append((d, garble(rng, body)))
    found = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    got = {(r.item_id, r.doc_id) for r in found.where(f"run_words >= {RUN}").collect()}
    assert got == brute(docs, items) and len(got) > 20
    # Joined instead of broadcast, with a filter that lets everything through or next to nothing.
    whole = sorted(map(tuple, found.collect()))
    for bits in (64, 2**20):
        joined = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_chars=0, filter_bits=bits)
        assert {(r.item_id, r.doc_id) for r in joined.where(f"run_words >= {RUN}").collect()} == got
    assert len(set(whole) & set(map(tuple, joined.collect()))) >= 0.95 * len(whole)


def plant(rng, passage, edits):
    chars = list(" ".join(passage))
    for _ in range(edits):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        chars[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abdegiknorst ")]
    return "".join(chars)


def test_recall_by_length_and_edits():
    """Passages of 12, 20 and 40 words with up to the promised edits per 12 words."""
    rng = random.Random(5)
    words = vocabulary(rng, 3000)
    items = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(150)]
    plan = Plan()
    index = ItemIndex(plan, items)
    embedder = Embedder(plan, index.embeddings)
    for length in (12, 20, 40):
        for edits in (1, 2, 4):
            docs = []
            for i, t in items:
                k = rng.randrange(60 - length)
                around = [rng.choice(words) for _ in range(20)]
                body = plant(rng, normal_words(t)[k : k + length], edits * length // 12)
                docs.append((i, normal_words(" ".join([*around[:10], body, *around[10:]]))))
            found = {(index.ids[which], docs[n][0]) for which, n in _scan(index, embedder, docs)}
            assert len(found & {(i, i) for i, _ in items}) >= 0.9 * len(items), (length, edits)
            assert len(found) <= len(items) + 2


def test_items_that_share_a_text_or_a_window(spark):
    shared = [f"common{i}" for i in range(20)]
    items = [(i, " ".join([*shared, *(f"own{i}x{k}" for k in range(15))])) for i in range(30)] + [(100 + i, " ".join(f"copy{k}" for k in range(14))) for i in range(40)]
    docs = [(1, " ".join(shared)), (2, " ".join(f"copy{k}" for k in range(14))), (3, " ".join(shared[:11]))]
    for block in (10**9, 0):
        found = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_chars=block).where(f"run_words >= {RUN}")
        assert {(r.item_id, r.doc_id) for r in found.collect()} == {(i, 1) for i in range(30)} | {(100 + i, 2) for i in range(40)}


def test_edited_leaks_reach_recall(spark):
    rng = random.Random(9)
    words = vocabulary(rng, 3000)
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(100)]
    docs = []
    for i, t in items:
        chars = list(" ".join(t.split()[3:33]))
        for at in sorted(rng.sample(range(len(chars)), 5), reverse=True):
            chars[at] = rng.choice(["", "x", chars[at] + "y"])
        docs.append((i, "".join(chars)))
    found = {(r.item_id, r.doc_id) for r in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(found & {(i, i) for i, _ in items}) >= 90 and len(found) <= 105


def test_dirt(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, text + " " + "z" * 200_000), (5, " ".join([text] * 50))]
    items = [(7, text), (8, "too short"), (9, None), (None, text), (7, text)]
    rows = sorted((r.item_id, r.doc_id) for r in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect())
    assert rows == [(7, 1), (7, 4), (7, 5)]
    none = spark.createDataFrame([], DOCS)
    assert find_leaks(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_edit_distance():
    rng = random.Random(4)

    def full(pattern, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(pattern, 1):
            nxt = [i]
            for j, y in enumerate(text, 1):
                nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
            row = nxt
        return min(row)

    for _ in range(600):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert edits_in(a, b) == full(a, b)


def test_keys():
    plan = Plan()
    assert [size_class(n) for n in (0, 16, 17, class_bound(9), class_bound(9) + 1)] == [0, 0, 1, 9, 10]
    windows = ["same window of words", "same window of words", "another window here"]
    keys = Embedder(plan, 5).keys(windows, size_class(19))
    assert keys.shape == (3, 5 * plan.samplings) and (keys[0] == keys[1]).all() and (keys[0] != keys[2]).all()
    # The end of a long window matters: no prefix of it decides.
    rng = random.Random(1)
    start = "".join(rng.choice("abcdefgh ") for _ in range(95))
    one, two = (start + "".join(rng.choice("abcdefgh ") for _ in range(20)) for _ in range(2))
    keys = Embedder(plan, 20).keys([one, two], size_class(115))
    assert (keys[0] != keys[1]).mean() > 0.5


def test_repetitions_follow_from_the_recall():
    rng = random.Random(3)
    words = vocabulary(rng, 2000)
    passages = sample_passages(Plan(), [[rng.choice(words) for _ in range(60)] for _ in range(80)])
    few, many = (embeddings_for(Plan(recall=r), passages) for r in (0.5, 0.9))
    assert 1 <= few < many and embeddings_for(Plan(max_edits=0), passages) == 1
