"""Mixing sources to target shares of the total size in tokens.

Entropy balancing: among all document rates r (expected copies, between 0 and the source's
cap) choose those closest in relative entropy to one copy of each document, sum over
documents of r log r - r + 1, that meet every source's token target, sum of n r over the
source's documents (n tokens each). The optimum is an exponential tilt of each document,
r = min(cap, exp(lambda_s * n)); its convex dual has one multiplier per source, found for
all sources together by Newton iterations. An iteration is one distributed aggregation over
the table of (source, token count) classes; one row of sums per source reaches the driver.

So a source that must shrink gives up its long documents first and one that must grow
repeats its long ones, whichever changes the fewest documents. ``length_neutral`` takes the
tilt per token instead, exp(lambda_s): every document of a source then has the same rate.

The total may be given. A source that can't deliver its target with all documents at their
cap falls short, is reported so, and what it lacks is spread over the others in proportion
to their targets. Without a given total it is the largest that the sources meet exactly, at
most the size of the corpus; sources that could not deliver ``too_small`` of their target
even for the corpus's size don't hold it down.

Rates are rounded to whole copies class by class, long documents first, with the token
remainder carried on, so a source misses its target by about half its shortest document;
within a class copies go to documents in hash order.

Scale: texts are tokenised once, in Arrow batches, and only (document, source, tokens) is
kept, written to the checkpoint folder. A class that holds a third of all documents is split
into hash buckets, ranked bucket by bucket and offset by a prefix sum over bucket sizes.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.session import cut_lineage, discard

#: Where the vocabulary files of public tokenizers lie, unless another place is handed in.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern that belongs to that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: More sources than this would not be a mixing table but data.
MOST_SOURCES = 100_000
#: A larger vocabulary file is not sent to the executors.
MOST_VOCABULARY = 256_000_000
SHARES = "source string, target_share double, max_repeats long, n_docs long, available_tokens long, target_tokens double, chosen_docs long, chosen_copies long, chosen_tokens long, actual_share double, short boolean"


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, n_tokens of every document; a null or empty text has 0 tokens.

    The vocabulary file is read on the driver and sent to the executors.
    """
    with open(vocabulary, "rb") as file:
        raw = file.read(MOST_VOCABULARY + 1)
    if len(raw) > MOST_VOCABULARY:
        raise ValueError("the vocabulary is too large to be sent around")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line.strip())}
        encoding = tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long"), F.col(source).cast("string"), F.col(text)).mapInArrow(count, "doc_id long, source string, n_tokens long")


def _targets(targets: DataFrame) -> DataFrame:
    """One row per usable source: positive share and cap; a repeated source counts once."""
    usable = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1")
    return usable.groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))


def spread(total: float, shares: dict[str, float], room: dict[str, float]) -> dict[str, float]:
    """Tokens wanted of each source: in proportion to the shares, none above its room.

    What full sources lack is spread over the others until nothing is left to spread or all
    are full. Every pass fills a source or ends, so it ends.
    """
    full: set[str] = set()
    while True:
        free = sum(shares[s] for s in shares if s not in full)
        rest = total - sum(room[s] for s in full)
        over = {s for s in shares if s not in full and rest * shares[s] / free > room[s]} if free > 0 else set()
        if not over:
            return {s: room[s] if s in full else rest * shares[s] / free for s in shares}
        full |= over


def default_total(shares: dict[str, float], room: dict[str, float], available: dict[str, float], too_small: float) -> float:
    """The largest total, up to the corpus's size, that no source of reasonable size bounds from below its share."""
    corpus, mass = sum(available.values()), sum(shares.values())
    bounds = [room[s] * mass / shares[s] for s in shares if room[s] >= too_small * corpus * shares[s] / mass]
    return min([corpus, *bounds], default=0.0) if bounds else corpus


def rate_of(lam: Column, cap: Column, n_tokens: Column, mean: Column, length_neutral: bool) -> Column:
    """min(cap, exp(lambda * n)), n in units of the source's mean so that multipliers compare."""
    exponent = lam if length_neutral else lam * n_tokens / mean
    return F.when(lam == math.inf, cap).otherwise(F.least(cap, F.exp(F.least(exponent, F.log(cap) + 1))))


def _tilt(classes: DataFrame, wanted: dict[str, tuple[float, int, float, float]], tolerance: float, length_neutral: bool) -> dict[str, float]:
    """Multiplier per source by Newton on the dual, kept between bounds that always bracket it.

    ``wanted``: tokens wanted, cap, tokens there, mean tokens of a document. Where a Newton
    step leaves the bracket it is halved instead, so that every source settles.
    """
    spark = classes.sparkSession
    lam = {s: 0.0 for s in wanted}
    low = {s: -math.inf for s in wanted}
    high = {s: math.inf for s in wanted}
    unsettled = {s for s, (need, cap, there, _) in wanted.items() if need < cap * there * (1 - 1e-12)}
    for s in set(wanted) - unsettled:
        lam[s] = math.inf  # all documents at their cap
    while unsettled:
        now = spark.createDataFrame([(s, lam[s], float(wanted[s][1]), wanted[s][3]) for s in sorted(unsettled)], "source string, lam double, cap double, mean double")
        rate = rate_of(F.col("lam"), F.col("cap"), F.col("n_tokens"), F.col("mean"), length_neutral)
        told = classes.join(F.broadcast(now), "source").withColumn("rate", rate).withColumn("mass", F.col("n_tokens").cast("double") * F.col("n_docs") * F.col("rate"))
        grows = F.when(F.col("rate") < F.col("cap"), F.col("mass") * (F.lit(1.0) if length_neutral else F.col("n_tokens") / F.col("mean"))).otherwise(0.0)
        for row in told.groupBy("source").agg(F.sum("mass").alias("got"), F.sum(grows).alias("slope")).collect():
            s = row["source"]
            need, miss = wanted[s][0], wanted[s][0] - row["got"]
            if abs(miss) <= tolerance * need or (math.isfinite(low[s]) and math.isfinite(high[s]) and high[s] - low[s] <= 1e-12 * max(1.0, abs(lam[s]))):
                unsettled.discard(s)
                continue
            if miss > 0:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            step = lam[s] + miss / row["slope"] if row["slope"] > 0 else math.nan
            if not low[s] < step < high[s] or abs(step - lam[s]) > 4 * (1 + abs(lam[s])):
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = lam[s] + math.copysign(1.0 + abs(lam[s]), miss)
                else:
                    step = (low[s] + high[s]) / 2
            lam[s] = step
    return lam


def _round_classes(classes: pd.DataFrame) -> pd.DataFrame:
    """Whole copies per class of one source, long documents first, carrying the token remainder.

    The group has a row per distinct token count of the source, however many documents.
    """
    classes = classes.sort_values("n_tokens", ascending=False, ignore_index=True)
    carried, copies = 0.0, []
    for size, docs, cap, rate in zip(classes["n_tokens"], classes["n_docs"], classes["cap"], classes["rate"]):
        wish = docs * rate * size + carried
        taken = min(cap * docs, max(0, math.floor(wish / size + 0.5)))
        carried = wish - taken * size
        copies.append(taken)
    return classes[["source", "n_tokens", "n_docs"]].assign(class_copies=copies)


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, tolerance: float = 1e-7, too_small: float = 0.25, length_neutral: bool = False, bucket_docs: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: doc_id, source, n_tokens, rate (what the dual says), copies (at least 1). shares:
    source, target_share, max_repeats, n_docs, available_tokens, target_tokens, chosen_docs,
    chosen_copies, chosen_tokens, actual_share, short; a row per listed source, also those
    without documents (all zero). ``short``: all documents are at their cap and the target
    share is not reached.

    The shares of sources without tokens are spread over the others in proportion.
    Documents of no source, of an unlisted one, or without a token are never chosen. Rows
    that repeat an id are separate documents. No documents give no chosen row. Jobs run
    while the result is built; ``discard(chosen)`` deletes its written table.
    """
    spark = docs.sparkSession
    listed = _targets(targets).limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError("a mixing table with that many sources is not supported")
    names = F.broadcast(spark.createDataFrame([(r["source"],) for r in listed], "source string"))
    sized = cut_lineage(token_counts(docs, vocabulary, pattern).where("doc_id IS NOT NULL AND source IS NOT NULL AND n_tokens > 0").join(names, "source", "left_semi"))
    buckets = max(1, math.ceil(sized.count() / bucket_docs))
    bucketed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(buckets)).cast("int"))
    cells = cut_lineage(bucketed.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n")))
    classes = cut_lineage(cells.groupBy("source", "n_tokens").agg(F.sum("n").alias("n_docs")).coalesce(8))
    there = {r["source"]: r for r in classes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"), F.sum("n_docs").alias("n")).collect()}
    caps = {r["source"]: r["max_repeats"] for r in listed}
    share = {r["source"]: r["target_share"] for r in listed if r["source"] in there}
    available = {s: float(there[s]["t"]) for s in share}
    room = {s: caps[s] * available[s] for s in share}
    total = default_total(share, room, available, too_small) if total_tokens is None else float(total_tokens)
    aims = spread(total, share, room)
    wanted = {s: (aims[s], caps[s], available[s], available[s] / there[s]["n"]) for s in share}
    lam = _tilt(classes, {s: w for s, w in wanted.items() if w[0] > 0}, tolerance, length_neutral)
    tilts = spark.createDataFrame([(s, lam[s], wanted[s][1], wanted[s][3]) for s in sorted(lam)], "source string, lam double, cap long, mean double")
    rate = rate_of(F.col("lam"), F.col("cap").cast("double"), F.col("n_tokens"), F.col("mean"), length_neutral)
    rated = classes.join(F.broadcast(tilts), "source").select("source", "n_tokens", "n_docs", "cap", rate.alias("rate"))
    rounded = rated.groupBy("source").applyInPandas(_round_classes, "source string, n_tokens long, n_docs long, class_copies long")
    planned = cut_lineage(rounded.join(rated.select("source", "n_tokens", "rate"), ["source", "n_tokens"]))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("before", before).join(planned, ["source", "n_tokens"]).drop("n")
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id"))
    ranked = bucketed.withColumn("rank", rank).join(placed, ["source", "n_tokens", "bucket"])
    extra = (F.col("before") + F.col("rank") <= F.col("class_copies") % F.col("n_docs")).cast("long")
    copies = F.floor(F.col("class_copies") / F.col("n_docs")) + extra
    chosen = cut_lineage(ranked.select("doc_id", "source", "n_tokens", "rate", copies.alias("copies")).where("copies > 0"))
    got = {r["source"]: r for r in chosen.groupBy("source").agg(F.count("*").alias("d"), F.sum("copies").alias("c"), F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    discard(sized, cells, classes, planned)
    whole, mass = sum(r["t"] for r in got.values()), sum(share.values())
    rows = []
    for r in sorted(listed, key=lambda x: x["source"]):
        s = r["source"]
        docs_there, tokens_there = (there[s]["n"], there[s]["t"]) if s in there else (0, 0)
        d, c, t = (got[s]["d"], got[s]["c"], got[s]["t"]) if s in got else (0, 0, 0)
        below = s not in share or aims[s] < total * share[s] / mass * (1 - 1e-9)
        rows.append((s, r["target_share"], r["max_repeats"], docs_there, tokens_there, aims.get(s, 0.0), d, c, t, t / whole if whole else 0.0, below))
    return chosen, spark.createDataFrame(rows, SHARES)
