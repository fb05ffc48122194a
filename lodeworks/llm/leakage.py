"""Evaluation texts leaking into training text.

Texts become words (letter case, punctuation, spacing, composition and invisible
characters removed). Windows of the size of the smallest passage that counts (``run`` words,
less the spacing of the windows) are embedded by the random walk of CGK: at every step the
walk copies the current symbol and advances or stays, as a random function of step and
symbol says, over three steps for every character, so few edits become a small Hamming
distance between walks. Bit-sampling LSH over the walks proposes (document window, item
window) pairs; each is then verified exactly, by the longest run of equal words through it
and by the edit distance of the item's passage to the document there.

The number of repetitions follows from the recall asked for: passages of the items are
edited ``max_edits`` times at random and searched, and as many repetitions are taken as find
the wanted share of them. Windows of different length are walked in classes of lengths, and
an item's window stands in every class that ``max_edits`` edits could move it to.

A leak of ``run`` words contains a document window wherever windows are ``stride`` words
apart, and equal windows have equal walks: an unedited leak is found with certainty.

Scale: the items are a stated query set and are indexed once each, copies of an item as one.
Items up to ``block_chars`` in all are broadcast (the size is checked, not assumed) and the
documents pass them once, map-only, without a shuffle. Beyond that nothing is broadcast: both
sides emit the keys of their windows, documents only those that a filter of all item keys
lets through, and meet in an equi-join on the key, which adaptive execution splits where a
key is hot; the corpus is read twice however many items there are. Every word of every
document is looked at.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.session import cut_lineage

SCHEMA = "item_id long, doc_id long, run_words int, item_from int, doc_from int, edits int"
_OUT = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("run_words", pa.int32()), ("item_from", pa.int32()), ("doc_from", pa.int32()), ("edits", pa.int32())])
#: Windows walked at a time.
_CHUNK = 8192
#: Places of the table that tells most keys of no item from the others.
_PRESENT = 2**24
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0} | set(range(0xFE00, 0xFE10)) | set(range(0xE0100, 0xE01F0))


class _Fold(dict):
    """str.translate table: white space to a blank, letters folded, the rest dropped."""

    def __missing__(self, code: int):
        char = chr(code)
        if char.isspace():
            out: str | None = " "
        elif code in _INVISIBLE:
            out = None
        else:
            out = char.casefold() if unicodedata.category(char)[0] in "LNM" else None
        self[code] = out
        return out


_FOLD = _Fold()


def normal_words(text: str | None) -> list[str]:
    """The words of a text as they are compared; a word without letter or digit is none."""
    if not text:
        return []
    folded = unicodedata.normalize("NFC", text).translate(_FOLD)
    return (folded if folded.isascii() else unicodedata.normalize("NFC", folded)).split()


@dataclass(frozen=True)
class Plan:
    """Parameters of the search.

    ``run``: words of the smallest passage that counts. ``stride``: spacing of the document
    windows, which are ``run - stride + 1`` words wide. ``max_edits``: edits (of characters)
    in a passage of ``run`` words that are still to be found, with the probability
    ``recall``. ``symbols``: steps of the walk sampled for a key. ``samplings``: keys taken
    from each walk. ``sample``: passages of the items that the repetitions are measured on.
    """

    run: int = 12
    width: int = 10
    stride: int = 3
    max_edits: int = 4
    recall: float = 0.9
    symbols: int = 8
    samplings: int = 4
    most_embeddings: int = 48
    sample: int = 400
    seed: int = 20240229

    def __post_init__(self) -> None:
        if self.width < 1 or self.stride < 1 or self.width + self.stride - 1 > self.run:
            raise ValueError("windows would miss runs: width + stride - 1 must not exceed run")


@lru_cache(maxsize=4096)
def size_class(length: int) -> int:
    """Class of a window's length; a class reaches up to ``class_bound`` characters."""
    c = 0
    while class_bound(c) < length:
        c += 1
    return c


def class_bound(c: int) -> int:
    return math.ceil(16 * 2 ** (c / 4))


class Embedder:
    """CGK walks and their sampled keys, the same on every machine (fixed seed)."""

    def __init__(self, plan: Plan, embeddings: int) -> None:
        self.plan, self.embeddings = plan, embeddings
        self.repetitions = embeddings * plan.samplings
        self.factors = np.random.default_rng(plan.seed).integers(1, 2**63, plan.symbols, dtype=np.uint64) | np.uint64(1)

    def keys(self, windows: list[str], c: int) -> np.ndarray:
        """(windows, repetitions) of 64-bit keys of windows walked in class ``c``.

        A walk has three steps for every character of the class's longest window. A key
        samples one step from each of ``symbols`` equal parts of the first two thirds, by
        whose end nearly every walk has seen its window's last character (later steps would
        add the same to every key); what no key samples is not walked.
        """
        plan, bound = self.plan, class_bound(c)
        out = np.empty((len(windows), self.repetitions), dtype=np.uint64)
        chunk = max(64, min(_CHUNK, 4_000_000 // bound))
        width = 2 * bound + 1  # a walk can't leave its own row
        edges = np.linspace(0, 2 * bound, plan.symbols + 1).astype(int)
        for at in range(0, len(windows), chunk):
            part = windows[at : at + chunk]
            n = len(part)
            raw = np.frombuffer("".join([w[:bound].ljust(width, "\0") for w in part]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            symbols = ((raw * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
            base = np.arange(n, dtype=np.intp) * width
            symbol, turn = np.empty(n, dtype=np.uint8), np.empty(n, dtype=np.uint8)
            for e in range(self.embeddings):
                rng = np.random.default_rng((plan.seed, c, e))
                places = [rng.integers(edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)) for _ in range(plan.samplings)]
                needed = {int(p) for sampled in places for p in sampled}
                # The random function of a step: the top bit of an odd multiple of the symbol plus an offset.
                odd, offset = rng.integers(0, 128, 2 * bound, dtype=np.uint8) * 2 + 1, rng.integers(0, 256, 2 * bound, dtype=np.uint8)
                taken: dict[int, np.ndarray] = {}
                here = base.copy()
                for step in range(max(needed) + 1):
                    np.take(symbols, here, out=symbol, mode="clip")
                    if step in needed:
                        taken[step] = symbol.astype(np.uint64)
                    np.multiply(symbol, odd[step], out=turn)
                    np.add(turn, offset[step], out=turn)
                    np.right_shift(turn, 7, out=turn)
                    np.add(here, turn, out=here)
                for s, sampled in enumerate(places):
                    key = np.full(n, (c << 20) + e * 64 + s + 1, dtype=np.uint64)
                    for place, factor in zip(sampled, self.factors):
                        key ^= taken[int(place)]
                        key *= factor
                        key ^= key >> np.uint64(29)
                    out[at : at + n, e * plan.samplings + s] = key
        return out


def doc_windows(plan: Plan, words: list[str]) -> Iterator[tuple[int, str]]:
    """(offset, window) of a document: every ``stride`` words, and one at the very end."""
    last = len(words) - plan.width
    for k in range(0, last + 1, plan.stride):
        yield k, " ".join(words[k : k + plan.width])
    if last > 0 and last % plan.stride:
        yield last, " ".join(words[last:])


def item_windows(plan: Plan, words: list[str]) -> Iterator[tuple[int, str]]:
    """(offset, window) of an item: at every word, also one word wider and narrower for passages that an edit splits or joins words of."""
    for width in (plan.width, plan.width - 1, plan.width + 1) if plan.max_edits and plan.width > 1 else (plan.width,):
        for k in range(len(words) - width + 1):
            yield k, " ".join(words[k : k + width])


def item_classes(plan: Plan, length: int) -> list[int]:
    """Classes in which windows may stand that differ from one of this length by the edits allowed."""
    return list(range(size_class(max(0, length - plan.max_edits)), size_class(length + plan.max_edits) + 1))


def embeddings_for(plan: Plan, passages: list[list[str]]) -> int:
    """Embeddings that find the wanted share of passages with ``max_edits`` random edits.

    Each passage of ``run`` words is edited, put behind words of another at a random
    distance from the document's windows, and searched for. ValueError if even
    ``most_embeddings`` don't reach the recall.
    """
    if not passages or plan.max_edits == 0:
        return 1
    rng = np.random.default_rng(plan.seed + 1)
    queue: dict[int, list[tuple[int, bool, str]]] = {}  # per class: passage, whether of the document, window
    for n, passage in enumerate(passages):
        text = list(" ".join(passage))
        letters = [ch for ch in text if ch != " "]
        for _ in range(plan.max_edits):
            place, kind = int(rng.integers(len(text))), int(rng.integers(3))
            text[place : place + (kind != 1)] = [] if kind == 0 else [letters[int(rng.integers(len(letters)))]]
        around = passages[(n + 1) % len(passages)]
        words = around[: int(rng.integers(plan.stride))] + "".join(text).split() + around[: plan.run]
        for _, w in item_windows(plan, passage):
            for c in item_classes(plan, len(w)):
                queue.setdefault(c, []).append((n, False, w))
        for _, w in doc_windows(plan, words):
            queue.setdefault(size_class(len(w)), []).append((n, True, w))
    embedder = Embedder(plan, plan.most_embeddings)
    hits = np.zeros((len(passages), plan.most_embeddings), dtype=bool)
    for c, rows in queue.items():
        keys = embedder.keys([w for _, _, w in rows], c)
        held: dict[int, list[int]] = {}
        for i, (n, of_doc, _) in enumerate(rows):
            if not of_doc:
                held.setdefault(n, []).append(i)
        for i, (n, of_doc, _) in enumerate(rows):
            if of_doc and n in held:
                hits[n] |= (keys[held[n]] == keys[i]).any(axis=0).reshape(plan.most_embeddings, plan.samplings).any(axis=1)
    first = sorted(int(np.argmax(h)) + 1 for h in hits if h.any())
    # One standard error above the target, so that the sample's luck doesn't decide.
    need = math.ceil(len(hits) * min(1.0, plan.recall + math.sqrt(plan.recall * (1 - plan.recall) / len(hits))))
    if len(first) < need:
        raise ValueError(f"a recall of {plan.recall} at {plan.max_edits} edits in {plan.run} words needs more than {plan.most_embeddings} embeddings")
    return first[need - 1]


def sample_passages(plan: Plan, texts: list[list[str]]) -> list[list[str]]:
    """At most ``plan.sample`` passages of ``run`` words, spread evenly over all of the items."""
    starts = [(n, k) for n, words in enumerate(texts) for k in range(0, len(words) - plan.run + 1, plan.run)]
    step = max(1, math.ceil(len(starts) / plan.sample))
    return [texts[n][k : k + plan.run] for n, k in starts[::step]]


class ItemIndex:
    """All windows of the items by class and sorted key, with the items' words."""

    def __init__(self, plan: Plan, items: list[tuple[int, str]]) -> None:
        self.plan = plan
        self.ids, self.words = [], []
        for item_id, text in items:
            words = normal_words(text)
            if len(words) >= plan.run:
                self.ids.append(item_id)
                self.words.append(words)
        self.embeddings = embeddings_for(plan, sample_passages(plan, self.words))
        embedder = Embedder(plan, self.embeddings)
        placed: dict[int, list[tuple[int, int, str]]] = {}
        for n, words in enumerate(self.words):
            for k, w in item_windows(plan, words):
                for c in item_classes(plan, len(w)):
                    placed.setdefault(c, []).append((n, k, w))
        #: Per class: sorted keys, the window each belongs to, and the windows' items and offsets.
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for c, rows in placed.items():
            keys = embedder.keys([w for _, _, w in rows], c)
            order = np.argsort(keys, axis=None, kind="stable")
            self.classes[c] = keys.ravel()[order], (order // keys.shape[1]).astype(np.int32), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def present(self) -> np.ndarray:
        """Whether any key stands at a place of the table; made where it is used, not sent around."""
        if not hasattr(self, "_present"):
            self._present = np.zeros(_PRESENT, dtype=bool)
            for keys, *_ in self.classes.values():
                self._present[(keys % np.uint64(_PRESENT)).astype(np.intp)] = True
        return self._present


def edits_in(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any part of the text (bit-parallel columns)."""
    size = len(pattern)
    if not size:
        return 0
    full, high = (1 << size) - 1, 1 << (size - 1)
    at: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        at[ch] = at.get(ch, 0) | 1 << i
    up, down, score = full, 0, size
    best = size
    for ch in text:
        eq = at.get(ch, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = (down | ~(across | up)) & full
        minus = up & across & full
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical
        best = min(best, score)
    return best


def verify(plan: Plan, words: list[str], item: list[str], at: int, start: int, known: int | None = None) -> tuple[int, int, int, int | None]:
    """(run, item_from, doc_from, edits) of the alignment doc[at] ~ item[start].

    run: the longest run of equal words that touches the window. Where it is shorter than
    ``plan.run``, edits is the least edit distance of any passage of ``plan.run`` words of
    the item that holds the window to the document around it, None if above ``max_edits`` or
    above ``known``, which another alignment of the two has (0 can't be bettered).
    """
    best = (0, start, at)
    lo, run_from = 0, None
    for k in range(plan.width + 1):
        same = k < plan.width and at + k < len(words) and start + k < len(item) and words[at + k] == item[start + k]
        if same and run_from is None:
            run_from = k
        if not same and run_from is not None:
            lo, hi = run_from, k
            while lo + start > 0 and lo + at > 0 and item[start + lo - 1] == words[at + lo - 1]:
                lo -= 1
            while start + hi < len(item) and at + hi < len(words) and item[start + hi] == words[at + hi]:
                hi += 1
            best = max(best, (hi - lo, start + lo, at + lo), key=lambda x: x[0])
            run_from = None
    if best[0] >= plan.run:
        return *best, 0
    most = plan.max_edits if known is None else known
    if most < 1:
        return *best, None
    around = " ".join(words[max(0, at - plan.stride - 1) : at + plan.run + plan.stride])
    first, last = max(0, start - (plan.run - plan.width)), min(start, len(item) - plan.run)
    # A narrower window may stand at the very end of an item.
    first = min(first, max(0, last))
    there, edits = Counter(around), most + 1
    for k in range(first, last + 1):
        passage = " ".join(item[k : k + plan.run])
        # Every character that the document has too few of costs an edit.
        if sum((Counter(passage) - there).values()) < edits:
            edits = min(edits, edits_in(passage, around))
    return *best, edits if edits <= most else None


def _better(new: tuple, old: tuple | None) -> bool:
    """Fewer edits, then the longer run, then the earlier place."""
    rank = lambda x: (x[3], -x[0], x[1], x[2])
    return old is None or rank(new) < rank(old)


def _scan(index: ItemIndex, embedder: Embedder, docs: list[tuple[int, list[str]]]) -> dict[tuple[int, int], tuple]:
    """Best verified alignment of each (item, document) among the proposed ones."""
    plan = index.plan
    placed: dict[int, list[tuple[int, int, str]]] = {}
    for n, (_, words) in enumerate(docs):
        for k, w in doc_windows(plan, words):
            if (c := size_class(len(w))) in index.classes:
                placed.setdefault(c, []).append((n, k, w))
    found: dict[tuple[int, int], tuple] = {}
    present = index.present()
    for c, rows in placed.items():
        held, window_of, owner, offset = index.classes[c]
        keys = embedder.keys([w for _, _, w in rows], c).ravel()
        some = np.flatnonzero(present[(keys % np.uint64(_PRESENT)).astype(np.intp)])
        left, right = np.searchsorted(held, keys[some], side="left"), np.searchsorted(held, keys[some], side="right")
        known_keys = right > left
        hit, left, sizes = some[known_keys], left[known_keys], (right - left)[known_keys]
        ends = np.cumsum(sizes)
        # A key that very many windows share is worked off in parts of bounded size.
        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(ends // 1_000_000)) + 1) if len(hit) else ():
            mine, many = hit[part], sizes[part]
            places = np.repeat(left[part], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs = np.unique(np.stack([np.repeat(mine // embedder.repetitions, many), window_of[places]], axis=1), axis=0)
            for row, window in pairs.tolist():
                n, at, _ = rows[row]
                which, start = int(owner[window]), int(offset[window])
                known = found.get((which, n))
                if known and known[3] == 0 and start - at == known[1] - known[2] and known[1] <= start < known[1] + known[0]:
                    continue
                judged = verify(plan, docs[n][1], index.words[which], at, start, known and known[3])
                if judged[3] is not None and _better(judged, known):
                    found[which, n] = judged
    return found


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _by_broadcast(corpus: DataFrame, index: ItemIndex) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        embedder = Embedder(index.plan, index.embeddings)
        waiting: list[tuple[int, list[str]]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            return _rows([(index.ids[which], waiting[n][0], *judged) for (which, n), judged in _scan(index, embedder, waiting).items()], _OUT)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = normal_words(text.as_py())
                if len(words) < index.plan.width:
                    continue
                waiting.append((doc, words))
                count += len(words)
                if count >= 100_000:
                    yield flush()
                    waiting, count = [], 0
        if waiting:
            yield flush()

    return corpus.mapInArrow(search, SCHEMA)


_KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("at", pa.int32())])


def _by_join(corpus: DataFrame, items: DataFrame, plan: Plan, embeddings: int, filter_bits: int) -> DataFrame:
    """The same search where the items are too many to be held in one place."""

    def keys_of(of_items: bool, bits=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            embedder = Embedder(plan, embeddings)
            wanted = None if bits is None else bits.value

            def flush(waiting: dict[int, list[tuple[int, int, str]]]) -> Iterator[pa.RecordBatch]:
                for c, rows in waiting.items():
                    keys = embedder.keys([w for _, _, w in rows], c)
                    flat = keys.ravel()
                    keep = np.arange(len(flat)) if wanted is None else np.flatnonzero((wanted[(flat % np.uint64(filter_bits)) >> np.uint64(6)] >> (flat & np.uint64(63))) & np.uint64(1))
                    ids, at = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(flat[keep].view(np.int64)), pa.array(ids[keep // keys.shape[1]]), pa.array(at[keep // keys.shape[1]])], schema=_KEYS)

            waiting: dict[int, list[tuple[int, int, str]]] = {}
            count = 0
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    words = normal_words(text.as_py())
                    if of_items and len(words) < plan.run:
                        continue
                    for k, w in (item_windows if of_items else doc_windows)(plan, words):
                        for c in item_classes(plan, len(w)) if of_items else (size_class(len(w)),):
                            waiting.setdefault(c, []).append((row, k, w))
                            count += 1
                    if count >= 50_000:
                        yield from flush(waiting)
                        waiting, count = {}, 0
            yield from flush(waiting)

        return run

    item_keys = cut_lineage(items.mapInArrow(keys_of(True), "key long, id long, at int"))
    # The filter has a fixed size; where the keys outgrow it, it lets more through and loses none.
    place = F.pmod("key", F.lit(filter_bits)).cast("long")
    marks = item_keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(key, {filter_bits}) & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    bitmap = np.zeros(filter_bits // 64, dtype=np.uint64)
    for r in marks:
        bitmap[r["w"]] = np.uint64(r["m"] & (2**64 - 1))
    bits = corpus.sparkSession.sparkContext.broadcast(bitmap)
    doc_keys = corpus.mapInArrow(keys_of(False, bits), "key long, id long, at int")
    proposed = doc_keys.withColumnsRenamed({"id": "doc_id", "at": "doc_at"}).join(item_keys.withColumnsRenamed({"id": "item_id", "at": "item_at"}), "key").select("doc_id", "item_id", "doc_at", "item_at").distinct()
    told = proposed.join(corpus.withColumnRenamed("text", "doc_text"), "doc_id").join(items.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = lru_cache(maxsize=64)(lambda text: normal_words(text))
        for batch in batches:
            out = []
            for doc, item, at, start, doc_text, item_text in zip(*(c.to_pylist() for c in batch.columns)):
                words, own = words_of(doc_text), words_of(item_text)
                # Another text under the same id may be shorter.
                if at + plan.width <= len(words) and start < len(own):
                    judged = verify(plan, words, own, at, start)
                    if judged[3] is not None:
                        out.append((item, doc, *judged))
            yield _rows(out, _OUT)

    return told.select("doc_id", "item_id", "doc_at", "item_at", "doc_text", "item_text").mapInArrow(check, SCHEMA)


def find_leaks(docs: DataFrame, items: DataFrame, plan: Plan | None = None, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 500_000, filter_bits: int = 2**26) -> DataFrame:
    """item_id, doc_id, run_words, item_from, doc_from, edits: documents with passages of items.

    A pair is listed if a run of at least ``plan.run`` words of the item stands in the
    document (edits = 0); that is certain. A passage of ``plan.run`` words of the item with 1
    to ``plan.max_edits`` edits (run_words is then the longest unedited part) is listed with
    the probability ``plan.recall``, for which the number of repetitions is measured.
    Null ids and null, empty or shorter texts have no leaks; texts under several ids are
    each listed; rows repeating an id are listed once. An empty table gives none.
    Up to ``block_chars`` characters of items are broadcast, more are joined. Jobs run over
    the items while the result is built.
    """
    plan = plan or Plan()
    if filter_bits % 64 or filter_bits <= 0:
        raise ValueError("the filter has whole words of 64 bits")
    chosen = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    # Copies of an item are searched for once, under the smallest of their ids. An id with several texts has several entries.
    texts = chosen.groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    size = texts.agg(F.sum(F.length("text")).alias("chars"), F.max("copies").alias("copies")).first()
    if (size["chars"] or 0) <= block_chars:
        found = _by_broadcast(corpus, ItemIndex(plan, sorted((r["id"], r["text"]) for r in texts.collect())))
    else:
        # Hash order, so that the passages measured on are spread over all items.
        drawn = texts.select("text").orderBy(F.xxhash64("text")).limit(plan.sample).collect()
        embeddings = embeddings_for(plan, sample_passages(plan, [w for r in drawn if len(w := normal_words(r["text"])) >= plan.run]))
        found = _by_join(corpus, texts.select("id", "text"), plan, embeddings, filter_bits)
    best = F.struct((-F.col("edits")).alias("e"), F.col("run_words"), (-F.col("item_from")).alias("i"), (-F.col("doc_from")).alias("d"))
    if (size["copies"] or 0) > 1:
        members = chosen.join(texts.select("text", F.col("id").alias("item_id")), "text").select("item_id", F.col("id").alias("member")).distinct()
        found = found.join(members, "item_id").withColumn("item_id", F.col("member")).drop("member")
    return found.groupBy("item_id", "doc_id").agg(F.max(best).alias("b")).select("item_id", "doc_id", F.col("b.run_words").alias("run_words"), (-F.col("b.i")).alias("item_from"), (-F.col("b.d")).alias("doc_from"), (-F.col("b.e")).alias("edits"))
