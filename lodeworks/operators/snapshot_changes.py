"""What changed between consecutive full snapshots.

The states are range-partitioned by (series, key) and sorted by (series, key, position of
the snapshot). Every task then walks its range once and merges all snapshots of a series
like sorted runs: the row before a state is either the same key one snapshot earlier
(compare), or the key was absent there (added); likewise the row after it decides
``removed``. Only one row is carried from batch to batch, so memory does not depend on
the number of keys.

Scale: repeated deliveries are folded map-side before the only shuffle by key, so a key
that holds a third of all rows arrives as one row per task; what is left per key is at
most one row per snapshot. Ranges are sampled by Spark, hence balanced whatever the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "natural_key string, old_version_id long, new_version_id long, change_kind string"
_OUT = pa.schema([("natural_key", pa.string()), ("old_version_id", pa.int64()), ("new_version_id", pa.int64()), ("change_kind", pa.string())])


def snapshot_sequence(versions: DataFrame, series: str = "source_path", started: str = "started_at", completed: str = "completed_at") -> DataFrame:
    """Completed runs of each series in order: version_id, series, seq (from 1), prev_id, next_id.

    A run without ``completed`` (null or blank) delivered no full snapshot and is left out,
    as is one without a series or start. Ties in the start are broken by id. The table has a
    row per run, not per record, so ordering it costs nothing that grows with the data.
    """
    when = F.coalesce(F.try_to_timestamp(F.col(started)), F.lit(None).cast("timestamp"))
    runs = versions.where(F.col(completed).isNotNull() & (F.trim(completed) != "") & F.col(series).isNotNull()).select(F.col("id").alias("version_id"), F.col(series).alias("series"), when.alias("_at"), F.col(started).alias("_text"))
    order = Window.partitionBy("series").orderBy("_at", "_text", "version_id")
    return runs.where(F.col("_text").isNotNull()).select(
        "version_id",
        F.first("version_id").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("series_id"),
        F.row_number().over(order).alias("seq"),
        F.lag("version_id").over(order).alias("prev_id"),
        F.lead("version_id").over(order).alias("next_id"),
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted states (series_id, natural_key, seq, version_id, prev_id, next_id, digest, size)."""
    held: pa.Table | None = None  # the last two rows seen: one already judged, one whose successor is unknown

    def judge(rows: pa.Table, first: int, last: int) -> pa.RecordBatch | None:
        """Changes of the rows first..last-1; the neighbours may lie outside that span."""
        n = rows.num_rows
        series = rows["series_id"].combine_chunks().to_numpy()
        seq = rows["seq"].combine_chunks().to_numpy()
        key = rows["natural_key"].combine_chunks()
        follows = np.zeros(n + 1, dtype=bool)  # follows[i]: row i is row i-1's key in the next snapshot
        if n > 1:
            same = pc.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            follows[1:n] = same & (series[1:] == series[:-1]) & (seq[1:] == seq[:-1] + 1)
        version, before, after = (rows[c].combine_chunks() for c in ("version_id", "prev_id", "next_id"))
        has_before = before.is_valid().to_numpy(zero_copy_only=False)
        has_after = after.is_valid().to_numpy(zero_copy_only=False)
        differs = np.zeros(n, dtype=bool)
        if n > 1:
            digest, size = rows["digest"].combine_chunks(), rows["size"].combine_chunks()
            there = digest.is_valid().to_numpy(zero_copy_only=False)
            other = pc.fill_null(pc.not_equal(digest.slice(1), digest.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            known = size.is_valid().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(size, 0).to_numpy()
            resized = (known[1:] != known[:-1]) | (known[1:] & (sizes[1:] != sizes[:-1]))
            differs[1:] = np.where(there[1:] & there[:-1], other, resized)
        span = np.zeros(n, dtype=bool)
        span[first:last] = True
        picks = []
        for kind, mask, old, new in (
            ("added", span & has_before & ~follows[:n], before, version),
            ("changed", span & follows[:n] & differs, before, version),
            ("removed", span & has_after & ~follows[1:], version, after),
        ):
            at = np.flatnonzero(mask)
            if len(at):
                picks.append(pa.table([key.take(pa.array(at)), old.take(pa.array(at)), new.take(pa.array(at)), pa.array([kind] * len(at))], schema=_OUT))
        if not picks:
            return None
        return pa.concat_tables(picks).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = pa.Table.from_batches([batch])
        rows = fresh if held is None else pa.concat_tables([held, fresh])
        first = 0 if held is None else held.num_rows - 1
        if rows.num_rows - 1 > first and (out := judge(rows, first, rows.num_rows - 1)):
            yield out
        held = rows.slice(max(0, rows.num_rows - 2))
    if held is not None and (out := judge(held, held.num_rows - 1, held.num_rows)):
        yield out


def snapshot_changes(states: DataFrame, sequence: DataFrame, partitions: int | None = None) -> DataFrame:
    """Typed changes between every two consecutive snapshots of each series.

    ``states``: version_id, natural_key, digest, size; further columns are ignored. A row
    belongs to its version_id whenever it arrived; rows of unknown versions and rows
    without a key (null or empty) are no states. Of several deliveries of one key in one
    snapshot the largest digest and the largest size count, so a repeated row changes
    nothing. ``changed``: the digests differ where both have one, otherwise the sizes
    differ (a missing size differs from a present one). States without digest and size
    columns give only ``added`` and ``removed``. Empty input gives an empty result.
    """
    columns = {c.lower() for c in states.columns}
    digest = F.col("digest") if "digest" in columns else F.lit(None).cast("string")
    size = F.col("size").cast("long") if "size" in columns else F.lit(None).cast("long")
    known = states.where(F.col("natural_key").isNotNull() & (F.col("natural_key") != "")).select("version_id", "natural_key", digest.alias("digest"), size.alias("size"))
    folded = known.groupBy("version_id", "natural_key").agg(F.max("digest").alias("digest"), F.max("size").alias("size"))
    placed = folded.join(sequence, "version_id").select("series_id", "natural_key", "seq", "version_id", "prev_id", "next_id", "digest", "size")
    by = ["series_id", "natural_key"]
    ranged = placed.repartitionByRange(partitions, *by) if partitions else placed.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by, "seq").mapInArrow(_merge, SCHEMA)
