"""Timestamps against Python's datetime and zone rules."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from lathe.functions.timestamps import parse_instants

UTC = timezone.utc


def us(d):
    return round((d - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def parse(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, zone string, first boolean")
    return [r.instant_us for r in parse_instants(df, "v", "zone", "first").orderBy("i").collect()]


def test_forms(spark):
    want = [
        ("2024-02-07T14:59:13+00:00", "Asia/Tokyo", True, datetime(2024, 2, 7, 14, 59, 13, tzinfo=UTC)),
        ("2024-08-13T05:55:13.105278853-07:00", None, None, datetime(2024, 8, 13, 12, 55, 13, 105278, tzinfo=UTC)),
        ("2024-07-28 11:49:35Z", "Asia/Tokyo", True, datetime(2024, 7, 28, 11, 49, 35, tzinfo=UTC)),
        ("2024-04-07", "Asia/Tokyo", True, datetime(2024, 4, 6, 15, tzinfo=UTC)),
        ("31.12.2024 00:11", "UTC", False, datetime(2024, 12, 31, 0, 11, tzinfo=UTC)),
        ("04/07/2024 2:05 PM", "UTC", True, datetime(2024, 7, 4, 14, 5, tzinfo=UTC)),
        ("04/07/2024 2:05 PM", "UTC", False, datetime(2024, 4, 7, 14, 5, tzinfo=UTC)),
        ("12/31/2024 12:05 am", "UTC", False, datetime(2024, 12, 31, 0, 5, tzinfo=UTC)),
        ("2025-08-04T20:23:23[Australia/Sydney]", "UTC", True, datetime(2025, 8, 4, 10, 23, 23, tzinfo=UTC)),
        ("1721433072", None, None, datetime(2024, 7, 19, 23, 51, 12, tzinfo=UTC)),
        ("1753308488276103", None, None, datetime(2025, 7, 23, 22, 8, 8, 276103, tzinfo=UTC)),
        ("Sun, 07 Jul 2024 19:52:17 +0900", None, None, datetime(2024, 7, 7, 10, 52, 17, tzinfo=UTC)),
        ("20250509T032500Z", None, None, datetime(2025, 5, 9, 3, 25, tzinfo=UTC)),
        ("Mar 11, 2024 9:38 PM EDT", "America/New_York", True, datetime(2024, 3, 12, 1, 38, tzinfo=UTC)),
        ("2024-06-28 01:17:00 NDT", "America/St_Johns", True, datetime(2024, 6, 28, 3, 47, tzinfo=UTC)),
        ("2024-11-03T01:30:00", "America/Chicago", True, datetime(2024, 11, 3, 6, 30, tzinfo=UTC)),
        ("2024-03-10 02:30:00", "America/Chicago", True, datetime(2024, 3, 10, 8, 30, tzinfo=UTC)),
        ("  2024-03-13T09:11+00:00 ", None, None, datetime(2024, 3, 13, 9, 11, tzinfo=UTC)),
        ("agosto de 2010", None, None, datetime(2010, 8, 1, tzinfo=UTC)),
        ("MÄRZ 2017", None, None, datetime(2017, 3, 1, tzinfo=UTC)),
        ("12 Sep 2009", None, None, datetime(2009, 9, 12, tzinfo=UTC)),
        ("07/2013", None, None, datetime(2013, 7, 1, tzinfo=UTC)),
        ("2014", None, None, datetime(2014, 1, 1, tzinfo=UTC)),
        (" " * 10_000 + "2024-06-01" + "\u00a0" * 10_000, None, None, datetime(2024, 6, 1, tzinfo=UTC)),
        ("2024-06-01T10:00:00." + "123456789" * 500 + "Z", None, None, datetime(2024, 6, 1, 10, 0, 0, 123456, tzinfo=UTC)),
        ("2012-06-01 12:00 MSK", "Europe/Moscow", True, datetime(2012, 6, 1, 8, tzinfo=UTC)),
        ("2009-01-01 12:00 MSK", "Europe/Moscow", True, datetime(2009, 1, 1, 9, tzinfo=UTC)),
        ("2024-06-01 12:00 MSK", "Europe/Moscow", True, datetime(2024, 6, 1, 9, tzinfo=UTC)),
        ("2017-01-01 12:00 KST", "Asia/Pyongyang", True, datetime(2017, 1, 1, 3, 30, tzinfo=UTC)),
        ("2020-01-01 12:00 KST", "Asia/Pyongyang", True, datetime(2020, 1, 1, 3, tzinfo=UTC)),
        ("2050-01-01 12:00 EST", "America/New_York", True, datetime(2050, 1, 1, 17, tzinfo=UTC)),
        ("2024-07-01 12:00 EST", "America/New_York", True, datetime(2024, 7, 1, 17, tzinfo=UTC)),
        ("févr. 2021", None, None, datetime(2021, 2, 1, tzinfo=UTC)), ("Dez. 2020", None, None, datetime(2020, 12, 1, tzinfo=UTC)), ("ott 2019", None, None, datetime(2019, 10, 1, tzinfo=UTC)),
        ("5 października 2018", None, None, datetime(2018, 10, 5, tzinfo=UTC)), ("paź 2018", None, None, datetime(2018, 10, 1, tzinfo=UTC)), ("2021年3月", None, None, datetime(2021, 3, 1, tzinfo=UTC)),
    ]
    assert parse(spark, [w[:3] for w in want]) == [us(w[3]) for w in want]


def test_no_instants(spark):
    bad = ["", " ", None, "n/a", "yesterday", "0000-00-00", "2025-02-29", "31/04/2024", "2024-13-01", "2024-01-01 25:00", "2024-01-01 13:00 PM", "Foo 2024", "2024-01-01[No/Zone]", "x" * 100_000, "2024-01-01 10:00" + " " * 50_000 + "x",
           " " * 50_000, "\x012024", "2024-06-01 12:00 XYZ", "2024-06-01 12:00 EST"]
    assert parse(spark, [(b, "UTC", True) for b in bad]) == [None] * len(bad)


def test_wall_times_of_zones(spark):
    r = random.Random(5)
    rows, want = [], []
    for _ in range(300):
        z = r.choice(["Europe/Berlin", "America/St_Johns", "Australia/Adelaide", "Asia/Kolkata", "America/New_York"])
        t = datetime(2024, 1, 1) + timedelta(minutes=r.randrange(2 * 365 * 24 * 60))
        rows.append((t.strftime("%Y-%m-%d %H:%M:%S"), z, True))
        want.append(us(t.replace(tzinfo=ZoneInfo(z)).astimezone(UTC)))
    assert parse(spark, rows) == want


def test_month_names_are_told_apart():
    from lathe.functions.timestamps import MONTHS

    seen = {}
    for line in MONTHS.values():
        names = line.split()
        assert len(names) == 12
        for i, n in enumerate(names):
            assert seen.setdefault(n, i) == i


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([("2024", "UTC", True, "x")], "v string, zone string, first boolean, abbreviations string")
    out = parse_instants(df, "v", "zone", "first")
    assert out.columns == ["v", "zone", "first", "abbreviations", "instant_us"] and out.count() == 1
    assert parse_instants(df.limit(0), "v", "zone", "first").count() == 0
