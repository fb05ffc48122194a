"""Mixed timestamp notations and zones, normalised to microseconds since 1970 UTC.

An ordered cascade of anchored patterns is tried; the first that fits decides, and its
fields are then checked strictly (calendar, clock, weekday, offset). A value without zone
is wall-clock time of the default zone handed in per row; what to do with a wall-clock
time that the zone shows twice or never is an explicit policy.

Scale: a scalar Arrow function, so it runs where the rows are, without any shuffle; the
default zone comes by a join with the (small, broadcast by its known size) run table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lodeworks.functions.jsonwalk import records

MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
DAYS = {d: i for i, d in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))}
#: Instants that can be true: microseconds from, and up to but not including.
Span = tuple[int, int]
#: Epochs of bare numbers: (name, microseconds from 1970 to the epoch, ticks per second).
EPOCHS = (
    ("unix_s", 0, 1),
    ("unix_ms", 0, 10**3),
    ("unix_us", 0, 10**6),
    ("unix_ns", 0, 10**9),
    ("cocoa_s", 978_307_200_000_000, 1),
    ("cocoa_ns", 978_307_200_000_000, 10**9),
    ("hfs_s", -2_082_844_800_000_000, 1),
    ("filetime", -11_644_473_600_000_000, 10**7),
    ("webkit_us", -11_644_473_600_000_000, 10**6),
)
_DAY = 86_400_000_000
_ORDINAL = date(1970, 1, 1).toordinal()

_CLOCK = r"(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,](?P<f>\d{1,12}))?"
_OFFSET = r"(?P<off>[+-]\d\d(?::?\d\d)?)"
_ABBR = r"(?P<abbr>[A-Za-z]{1,6})"
_NAME = r"(?P<zone>[A-Za-z][A-Za-z0-9_+\-]*(?:/[A-Za-z0-9_+\-]+)*)"
#: Tried in this order; all anchored by fullmatch.
CASCADE = tuple(
    re.compile(p)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<mo>\d\d)-(?P<d>\d\d)[Tt ]{_CLOCK} ?(?:{_OFFSET}|{_ABBR})?(?:\[{_NAME}\])?",
        r"(?P<y>\d{4})(?P<mo>\d\d)(?P<d>\d\d)T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?:[.,](?P<f>\d{1,12}))?" + rf"(?:{_OFFSET}|{_ABBR})?",
        r"(?P<num>-?\d{1,25}(?:\.\d{1,25})?)",
        rf"(?P<wd>[A-Za-z]{{3}}), (?P<d>\d{{1,2}}) (?P<mon>[A-Za-z]{{3}}) (?P<y>\d{{4}}) {_CLOCK} (?:{_OFFSET}|{_ABBR})",
        rf"(?P<d>\d\d)/(?P<mon>[A-Za-z]{{3}})/(?P<y>\d{{4}}):{_CLOCK}(?: {_OFFSET})?",
        rf"(?P<mo>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}}),? (?P<h>\d{{1,2}}):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,](?P<f>\d{{1,12}}))?(?: ?(?P<ap>[AaPp][Mm]))?",
        rf"(?P<d>\d{{1,2}})\.(?P<mo>\d{{1,2}})\.(?P<y>\d{{4}}),? {_CLOCK}(?: ?(?:{_OFFSET}|{_ABBR}))?",
        rf"(?P<wd>[A-Za-z]{{3}}) (?P<mon>[A-Za-z]{{3}}) +(?P<d>\d{{1,2}}) {_CLOCK} (?:{_ABBR} )?(?P<y>\d{{4}})",
    )
)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # an unknown or malformed name
        return None


def _seconds(delta: timedelta | None) -> int:
    return 0 if delta is None else delta.days * 86_400 + delta.seconds


@lru_cache(maxsize=65_536)
def _steady(zone: str, day: date) -> int | None:
    """The offset that holds from the eve of a day to the day after it, if there is one."""
    z = _zone(zone)
    if not date.min + timedelta(days=3) < day < date.max - timedelta(days=3):
        return None
    noon = datetime(day.year, day.month, day.day, 12, tzinfo=z)
    offsets = {_seconds((noon + timedelta(hours=n)).utcoffset()) for n in range(-36, 37, 3)}
    return offsets.pop() if len(offsets) == 1 else None


def _local(zone: str, wall: datetime, ambiguous: str, nonexistent: str) -> int | None:
    """Offset in seconds of a wall-clock time, by policy where the zone shows it twice or never."""
    z = _zone(zone)
    if z is None:
        return None
    if (steady := _steady(zone, wall.date())) is not None:
        return steady
    first = _seconds(wall.replace(tzinfo=z).utcoffset())
    second = _seconds(wall.replace(tzinfo=z, fold=1).utcoffset())
    if first == second:
        return first
    policy = ambiguous if first > second else nonexistent
    return {"reject": None, "earlier": max(first, second), "later": min(first, second)}[policy]


def _by_abbreviation(zone: str, wall: datetime, abbr: str) -> int | None:
    if abbr in ("UTC", "GMT", "Z", "z", "UT"):
        return 0
    z = _zone(zone)
    if z is None:
        return None
    for fold in (0, 1):
        there = wall.replace(tzinfo=z, fold=fold)
        if there.tzname() == abbr:
            offset = _seconds(there.utcoffset())
            try:
                back = (wall - timedelta(seconds=offset)).replace(tzinfo=ZoneInfo("UTC")).astimezone(z)
            except OverflowError:  # at the first or last day of the calendar
                return None
            if back.replace(tzinfo=None, fold=0) == wall:
                return offset
    return None


def span(first_day: str, end_day: str) -> Span:
    """The span of instants from one UTC day up to, not including, another."""
    start, end = (date.fromisoformat(d).toordinal() - _ORDINAL for d in (first_day, end_day))
    return start * _DAY, end * _DAY


def _number(text: str, true_span: Span | None) -> int | None:
    """The reading of a bare number in the one epoch that puts it into the span; without a span its epoch can't be told."""
    whole, _, fraction = text.partition(".")
    if true_span is None:
        return None
    sign, whole = (-1, whole[1:]) if whole.startswith("-") else (1, whole)
    found = set()
    for _name, start, ticks in EPOCHS:
        scaled = sign * int(whole + fraction) * 10**6
        us = scaled // (ticks * 10 ** len(fraction)) + start
        if true_span[0] <= us < true_span[1]:
            found.add(us)
    return found.pop() if len(found) == 1 else None


def instant(text: str | None, zone: str | None, ambiguous: str = "reject", nonexistent: str = "reject", true_span: Span | None = None) -> int | None:
    """Microseconds since 1970-01-01 UTC of the one instant a value denotes, else None.

    None for null, blank and unreadable values, impossible dates and clocks, weekdays that
    contradict the date, dates without a time, a missing or unknown zone where one is
    needed. Digits finer than a microsecond are cut off. ``ambiguous`` and ``nonexistent``
    (reject, earlier or later offset) say what becomes of local times that the zone's clock
    shows twice or never. With a ``true_span`` instants outside it give None too, and bare
    numbers are read in the one known epoch that puts them inside; without one they give None.
    """
    if text is None:
        return None
    text = text.strip()
    for pattern in CASCADE:
        if m := pattern.fullmatch(text):
            break
    else:
        return None
    g = m.groupdict()
    if g.get("num"):
        return _number(g["num"], true_span)
    month = int(g["mo"]) if g.get("mo") else MONTHS.get(g["mon"].lower(), 0)
    hour, minute, second = int(g["h"]), int(g["mi"]), int(g["s"])
    if half := g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half.lower() == "pm")
    try:
        wall = datetime(int(g["y"]), month, int(g["d"]), hour, minute, second)
    except ValueError:
        return None
    if (wd := g.get("wd")) and DAYS.get(wd.lower()) != wall.weekday():
        return None
    named, offset = g.get("zone"), None
    if off := g.get("off"):
        digits = off[1:].replace(":", "").ljust(4, "0")
        if int(digits[:2]) > 18 or int(digits[2:]) > 59:
            return None
        offset = (int(digits[:2]) * 3600 + int(digits[2:]) * 60) * (-1 if off[0] == "-" else 1)
    elif abbr := g.get("abbr"):
        offset = _by_abbreviation(named or zone or "", wall, abbr)
    else:
        offset = _local(named or zone or "", wall, ambiguous, nonexistent)
    if offset is None:
        return None
    micros = int((g.get("f") or "0")[:6].ljust(6, "0"))
    us = (wall.toordinal() - _ORDINAL) * _DAY + (hour * 3600 + minute * 60 + second - offset) * 1_000_000 + micros
    return us if true_span is None or true_span[0] <= us < true_span[1] else None


#: The cascade for whole columns, anchored on both sides.
_COLUMNS = tuple(r"\A(?:" + p.pattern + r")\z" for p in CASCADE)
_MONTH_NAMES, _DAY_NAMES = pa.array(list(MONTHS)), pa.array(list(DAYS))
_AS_UTC = pa.array(["UTC", "GMT", "Z", "z", "UT"])


def _ints(text: pa.Array) -> np.ndarray:
    return pc.cast(text, pa.int64()).to_numpy(zero_copy_only=False)


def _fields(found: pa.StructArray) -> dict[str, pa.Array]:
    return {f.name: found.field(i) for i, f in enumerate(found.type)}


def _offsets(zones: pa.Array, days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset in seconds, known, whether the day needs a closer look) of days in named zones."""
    coded = pc.dictionary_encode(zones)
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    offset, known, closer = np.zeros(len(days), dtype=np.int64), np.zeros(len(days), dtype=bool), np.zeros(len(days), dtype=bool)
    for code, zone in enumerate(coded.dictionary.to_pylist()):
        if _zone(zone) is None:
            continue
        mine = np.flatnonzero(codes == code)
        each, back = np.unique(days[mine], return_inverse=True)
        steady = [_steady(zone, date.fromordinal(int(d) + _ORDINAL)) for d in each]
        offset[mine] = np.array([x or 0 for x in steady], dtype=np.int64)[back]
        closer[mine] = np.array([x is None for x in steady], dtype=bool)[back]
        known[mine] = ~closer[mine]
    return offset, known, closer


def _numbers(text: pa.Array, true_span: Span | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_judge`` of bare numbers: whole ones of up to 18 digits are read in every epoch that puts them into the span."""
    n = len(text)
    us, hits = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if true_span is None:
        return us, hits > 0, hits > 0
    plain = pc.match_substring_regex(text, r"^\d{1,18}$").to_numpy(zero_copy_only=False)
    whole = pc.cast(text.filter(pa.array(plain)), pa.int64()).to_numpy(zero_copy_only=False)
    value, seen = np.zeros(len(whole), dtype=np.int64), np.zeros(len(whole), dtype=np.int64)
    for _name, start, ticks in EPOCHS:
        # Number of ticks at which the span begins and ends, rounded up.
        low, high = (-((start - edge) * ticks // 10**6) for edge in true_span)
        here = (whole >= max(low, 0)) & (whole < min(high, 2**62)) if high > 0 else np.zeros(len(whole), dtype=bool)
        at = np.where(here, whole, 0) * (10**6 // ticks) + start if ticks <= 10**6 else whole // (ticks // 10**6) + start
        fresh = here & ((seen == 0) | (at != value))
        value = np.where(fresh, at, value)
        seen += fresh
    us[plain], hits[plain] = value, seen
    return us, hits == 1, ~plain


def _judge(g: dict[str, pa.Array], zones: pa.Array, true_span: Span | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(microseconds, whether they hold, whether the value needs a closer look) of values of one pattern."""
    n = len(zones)
    if "num" in g:
        return _numbers(g["num"], true_span)
    year, day, hour, minute, second = (_ints(g[k]) for k in ("y", "d", "h", "mi", "s"))
    month = _ints(g["mo"]) if "mo" in g else pc.fill_null(pc.index_in(pc.utf8_lower(g["mon"]), _MONTH_NAMES), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    valid = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (minute < 60) & (second < 60)
    if "ap" in g:
        half = pc.utf8_lower(g["ap"]).to_numpy(zero_copy_only=False)
        told = half != ""
        valid &= ~told | ((hour >= 1) & (hour <= 12))
        hour = np.where(told, hour % 12 + 12 * (half == "pm"), hour)
    valid &= hour < 24
    first = np.where(valid, year - 1970, 0).astype("M8[Y]").astype("M8[M]") + np.where(valid, month - 1, 0)
    valid &= day <= ((first + 1).astype("M8[D]") - first.astype("M8[D]")).astype(np.int64)
    days = np.where(valid, first.astype("M8[D]").astype(np.int64) + day - 1, 0)
    if "wd" in g:
        valid &= pc.fill_null(pc.index_in(pc.utf8_lower(g["wd"]), _DAY_NAMES), -1).to_numpy(zero_copy_only=False) == (days + 3) % 7
    offset, settled, closer = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if "off" in g:
        sign = pc.utf8_slice_codeunits(g["off"], 0, 1).to_numpy(zero_copy_only=False)
        digits = pc.utf8_rpad(pc.utf8_slice_codeunits(pc.replace_substring(g["off"], ":", ""), 1, 5), 4, "0")
        hours, minutes = (_ints(pc.utf8_slice_codeunits(digits, i, i + 2)) for i in (0, 2))
        settled = sign != ""
        valid &= ~settled | ((hours <= 18) & (minutes <= 59))
        offset = np.where(settled, (hours * 3600 + minutes * 60) * np.where(sign == "-", -1, 1), 0)
    if "abbr" in g:
        named = ~settled & (g["abbr"].to_numpy(zero_copy_only=False) != "")
        closer |= named & ~pc.is_in(g["abbr"], value_set=_AS_UTC).to_numpy(zero_copy_only=False)
        settled |= named
    if "zone" in g:
        closer |= ~settled & (g["zone"].to_numpy(zero_copy_only=False) != "")
        settled |= closer
    local = np.flatnonzero(valid & ~settled)
    if len(local):
        offset[local], known, look = _offsets(zones.take(pa.array(local)), days[local])
        valid[local] &= known | look
        closer[local] |= look
    us = days * _DAY + (hour * 3600 + minute * 60 + second - offset) * 1_000_000
    if "f" in g:
        us += _ints(pc.utf8_rpad(pc.utf8_slice_codeunits(g["f"], 0, 6), 6, "0"))
    return us, valid & ~closer, valid & closer


def instants(values: pa.Array, zones: pa.Array, ambiguous: str = "reject", nonexistent: str = "reject", true_span: Span | None = None) -> pa.Array:
    """``instant`` of whole columns.

    Patterns, calendar and offsets run over the column; ``instant`` itself decides on what
    is left: numbers with a fraction, zone abbreviations, days on which a clock changes, and values no
    pattern fits.
    """
    text = pc.utf8_trim_whitespace(values)
    us, holds = np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    rest = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    closer: list[np.ndarray] = []
    for pattern in _COLUMNS:
        if not len(rest):
            break
        found = pc.extract_regex(text.take(pa.array(rest)), pattern)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        if hit.any():
            rows = rest[hit]
            us[rows], holds[rows], look = _judge(_fields(found.filter(pa.array(hit))), zones.take(pa.array(rows)), true_span)
            closer.append(rows[look])
        rest = rest[~hit]
    if true_span is not None:
        holds &= (us >= true_span[0]) & (us < true_span[1])
    for rows in (*closer, rest):
        at = pa.array(rows)
        for row, v, z in zip(rows.tolist(), values.take(at).to_pylist(), zones.take(at).to_pylist()):
            one = instant(v, z, ambiguous, nonexistent, true_span)
            if one is not None:
                us[row], holds[row] = one, True
    return pa.array(us, mask=~holds)


def epoch_us(value: Column, zone: Column, ambiguous: str = "reject", nonexistent: str = "reject", true_span: Span | None = None) -> Column:
    """``instants`` of Arrow batches."""

    @arrow_udf("long")
    def convert(values: pa.Array, zones: pa.Array) -> pa.Array:
        return instants(values, zones, ambiguous, nonexistent, true_span)

    return convert(value, zone)


def version_zones(versions: DataFrame) -> DataFrame:
    """(version_id, zone) from the run table's metadata; a version without zone gets none."""
    return versions.select(F.col("id").alias("version_id"), F.get_json_object("metadata", "$.zone").alias("zone"))


def file_instants(files: DataFrame, versions: DataFrame, fields: tuple[str, ...] = ("observed_time", "modified_time"), true_span: Span | None = None) -> DataFrame:
    """entity_table, row_id, record_pos, field, epoch_us of every value that denotes one instant."""
    zoned = files.select("id", "source_version_id", *fields).join(version_zones(versions), F.col("source_version_id") == F.col("version_id"), "left")
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    values = zoned.select(F.col("id").alias("row_id"), "zone", F.inline(named)).where(F.col("value").isNotNull())
    return values.select(F.lit("files").alias("entity_table"), "row_id", F.lit(0).cast("long").alias("record_pos"), "field", epoch_us(F.col("value"), F.col("zone"), true_span=true_span).alias("epoch_us")).where(F.col("epoch_us").isNotNull())


def event_times(bodies: DataFrame) -> DataFrame:
    """raw_id, record_pos, value: each record's eventTime as written (numbers as their text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, values = [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                for pos, record in enumerate(records(body.as_py(), numbers_as_text=True)):
                    when = record.get("eventTime") if isinstance(record, dict) else None
                    if isinstance(when, str):
                        ids.append(doc)
                        places.append(pos)
                        values.append(when)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(values, pa.string())], ["raw_id", "record_pos", "value"])

    return bodies.select(F.col("raw_id").cast("long"), "body").mapInArrow(read, "raw_id long, record_pos long, value string")


def record_instants(bodies: DataFrame, zone: str = "UTC", true_span: Span | None = None) -> DataFrame:
    times = event_times(bodies)
    return times.select(F.lit("sample_records").alias("entity_table"), F.col("raw_id").alias("row_id"), "record_pos", F.lit("eventTime").alias("field"), epoch_us(F.col("value"), F.lit(zone), true_span=true_span).alias("epoch_us")).where(F.col("epoch_us").isNotNull())
