"""P5 operator: notations, zones and impossible times."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from lodeworks.operators.timestamps import EPOCHS, epoch_us, file_instants, instant, instants, span

NY, BERLIN, SYDNEY = "America/New_York", "Europe/Berlin", "Australia/Sydney"
AT = datetime(2025, 8, 30, 2, 12, 34, 567890, tzinfo=UTC)
US = int((AT - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
WHOLE = US // 1_000_000 * 1_000_000
SPAN = span("2023-01-01", "2027-01-01")


def test_notations():
    local = AT.astimezone(ZoneInfo(NY))
    assert instant("2025-08-30T02:12:34.567890Z", NY) == US
    assert instant("2025-08-30T02:12:34.567890999Z", NY) == US
    assert instant("  2025-08-30 02:12:34,567890+0000 ", NY) == US
    assert instant("20250830T021234Z", NY) == WHOLE
    assert instant("Sat, 30 Aug 2025 02:12:34 GMT", NY) == WHOLE
    assert instant("29/Aug/2025:22:12:34 -0400", BERLIN) == WHOLE
    assert instant("08/29/2025 10:12:34 PM", NY) == WHOLE
    assert instant("29.08.2025 22:12:34", NY) == WHOLE
    assert instant("2025-08-29 22:12:34 EDT", NY) == WHOLE
    assert instant("Fri Aug 29 22:12:34.567890 EDT 2025", NY) == US
    assert instant(local.strftime("%Y-%m-%dT%H:%M:%S") + "-04:00[America/New_York]", None) == WHOLE
    assert instant("2025-08-30T14:57:34+12:45", NY) == WHOLE


def test_numbers():
    s = WHOLE // 1_000_000
    for text in (str(s), f"{s}.0", str(s * 1000), str(s * 1_000_000), str(s * 10**9), str(s - 978_307_200), str(s + 2_082_844_800), str((s + 11_644_473_600) * 10**7)):
        assert instant(text, None, true_span=SPAN) == WHOLE, text
        assert instant(text, None) is None
    assert instant("778214025.25", None, true_span=SPAN) == (778_214_025 + 978_307_200) * 1_000_000 + 250_000
    for text in ("0", "12", "-5", "99999999999999999999999", "1.5"):
        assert instant(text, NY, true_span=SPAN) is None
    assert instant("-864000", None, true_span=span("1969-12-20", "1969-12-25")) == -864_000_000_000


def test_any_year_and_a_span_that_is_handed_in():
    for year in (1901, 1969, 2021, 2030, 2150, 9998):
        want = int((datetime(year, 5, 6, 7, 8, 9, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(seconds=1)) * 1_000_000
        for text in (f"{year}-05-06T07:08:09Z", f"06.05.{year} 07:08:09", f"05/06/{year} 07:08:09"):
            assert instant(text, "UTC") == want, text
            assert instant(text, "UTC", true_span=SPAN) is None
    assert instant("0001-01-01T00:00:00", NY) is not None and instant("9999-12-31 23:59:59 EST", NY) is None
    assert instant(str(1_000_000_000), None, true_span=span("2001-09-01", "2001-10-01")) == 10**15


def test_clock_changes():
    assert instant("2025-11-02 01:30:00", NY) is None and instant("2025-03-09 02:30:00", NY) is None
    assert instant("2025-11-02 01:30:00", NY, ambiguous="later") - instant("2025-11-02 01:30:00", NY, ambiguous="earlier") == 3_600_000_000
    assert instant("2025-11-02 01:30:00 EST", NY) - instant("2025-11-02 01:30:00 EDT", NY) == 3_600_000_000
    assert instant("2025-03-09 02:30:00", NY, nonexistent="earlier") is not None
    assert instant("2025-10-26 02:30:00", BERLIN) is None and instant("2025-10-26 01:59:59", BERLIN) is not None
    assert instant("2025-10-05 02:30:00", SYDNEY) is None
    assert instant("2025-11-02 02:00:00", NY) is not None and instant("2025-11-02 00:59:59", NY) is not None


def test_every_hour_of_a_year_against_zoneinfo():
    for name in (NY, BERLIN, SYDNEY, "Australia/Lord_Howe"):
        zone = ZoneInfo(name)
        for h in range(0, 24 * 366, 1):
            for minute in (0, 45):
                wall = datetime(2025, 1, 1) + timedelta(hours=h, minutes=minute)
                a, b = (wall.replace(tzinfo=zone, fold=f) for f in (0, 1))
                same = a.utcoffset() == b.utcoffset()
                got = instant(wall.strftime("%Y-%m-%d %H:%M:%S"), name)
                want = int((a - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) if same else None
                assert got == want, (name, wall)


def test_refused():
    for text in (None, "", "-", "n/a", "pending", "2025-02-30T08:15:00Z", "2025-06-31", "0000-00-00 00:00:00", "2025-01-01T24:00:00Z", "2025-01-01T00:60:00Z", "Sun, 30 Aug 2025 02:12:34 GMT", "1999-01-01T00:00:00Z", "13/13/2025 01:00:00 PM", "08/29/2025 13:12:34 PM", "2025-08-30T02:12:34+19:00", "x" * 100_000, "2025-08-30 02:12:34 PST"):
        assert instant(text, NY, true_span=SPAN) is None, text
    assert instant("2025-08-30 02:12:34", None) is None and instant("2025-08-30 02:12:34", "No/Where") is None


def test_columns_and_tables(spark):
    df = spark.createDataFrame([("2025-08-30T02:12:34Z", None), (None, NY), ("29.08.2025 22:12:34", NY)], "v string, z string")
    assert [r[0] for r in df.select(epoch_us(df.v, df.z)).collect()] == [WHOLE, None, WHOLE]
    versions = spark.createDataFrame([(1, '{"zone": "America/New_York"}', 5), (2, None, 5)], "id long, metadata string, zone int")
    files = spark.createDataFrame([(10, 1, "29.08.2025 22:12:34", None, "z"), (11, 2, "29.08.2025 22:12:34", str(WHOLE // 10**6), "z"), (12, 9, None, "", "z")], "id long, source_version_id long, observed_time string, modified_time string, zone string")
    rows = sorted(tuple(r) for r in file_instants(files, versions, true_span=SPAN).collect())
    assert rows == [("files", 10, 0, "observed_time", WHOLE), ("files", 11, 0, "modified_time", WHOLE)]
    assert file_instants(files.limit(0), versions).collect() == []


def test_columns_agree_with_single_values():
    import random

    import pyarrow as pa

    rng = random.Random(6)
    forms = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S,%f+05:30", "%Y%m%dT%H%M%SZ", "%Y%m%dT%H%M%S.%f-08", "%a, %d %b %Y %H:%M:%S GMT", "%a, %d %b %Y %H:%M:%S EST", "%d/%b/%Y:%H:%M:%S -0400", "%d/%b/%Y:%H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y, %H:%M:%S", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y, %H:%M:%S CET", "%a %b %d %H:%M:%S.%f EDT %Y", "%Y-%m-%d %H:%M:%S EDT", "%Y-%m-%dT%H:%M:%S-04:00[America/New_York]", "%Y-%m-%dT%H:%M:%S[Europe/Berlin]", "  %Y-%m-%d %H:%M:%S +1900 "]
    values, zones = [], []
    for _ in range(6000):
        at = datetime(rng.choice([1, 1905, 1970, 2021, 2024, 2025, 2026, 9999]), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), rng.randint(0, 999999))
        if rng.random() < 0.3:
            at = at.replace(year=2025, month=rng.choice([3, 10, 11]), day=rng.choice([2, 5, 9, 26, 30]), hour=rng.randint(0, 3))
        text = list(at.strftime(rng.choice(forms)))
        if rng.random() < 0.3 and text:
            text[rng.randrange(len(text))] = rng.choice("0123456789 :-/TZapm٣")
        values.append("".join(text))
        zones.append(rng.choice([NY, BERLIN, SYDNEY, "No/Where", "", None]))
    for _ in range(800):
        one = rng.randint(1_672_000_000, 1_799_000_000)
        values.append(str(rng.choice([one, one * 1000 + 7, one * 10**6 + 1, one * 10**9 + 5, one - 978_307_200, (one - 978_307_200) * 10**9, one + 2_082_844_800, (one + 11_644_473_600) * 10**7 + 3, (one + 11_644_473_600) * 10**6, rng.randint(0, 10**12), 10**17 + rng.randint(0, 10**17), -one])))
        zones.append(None)
    for edge in SPAN:
        for _, start, ticks in EPOCHS:
            values += [str((edge - start) * ticks // 10**6 + d) for d in (-1, 0, 1)]
            zones += [None] * 3
    values += [None, "", " ", "n/a", "1751352558583", "1722486337.559", "-5", "2025-02-29T00:00:00Z", "٢٠٢٥-01-01T00:00:00Z"]
    zones += [NY] * 9
    for ambiguous, nonexistent, limits in (("reject", "reject", SPAN), ("earlier", "later", None)):
        want = [instant(v, z, ambiguous, nonexistent, limits) for v, z in zip(values, zones)]
        got = instants(pa.array(values, pa.string()), pa.array(zones, pa.string()), ambiguous, nonexistent, limits).to_pylist()
        assert got == want, [x for x in zip(values, zones, got, want) if x[2] != x[3]][:5]
        assert sum(x is not None for x in want) > 1000
