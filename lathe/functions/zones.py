"""Zones: their offsets over a year, sets of them, and those that a text names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.dates import utc_offset_minutes

# Abbreviations in prose and the IANA zones that they stand for.
ABBREVIATIONS = {
    "utc": "UTC", "gmt": "UTC", "cet": "Europe/Berlin", "cest": "Europe/Berlin", "eet": "Europe/Athens", "bst": "Europe/London", "est": "America/New_York", "edt": "America/New_York", "et": "America/New_York",
    "cst": "America/Chicago", "cdt": "America/Chicago", "mst": "America/Denver", "mdt": "America/Denver", "pst": "America/Los_Angeles", "pdt": "America/Los_Angeles", "pt": "America/Los_Angeles", "ist": "Asia/Kolkata", "jst": "Asia/Tokyo",
}


def year_offsets(zone: Column | str, year: int) -> Column:
    """array<int>: offsets from UTC, in minutes, that a zone has at noon UTC of the days of a year."""
    z = F.col(zone) if isinstance(zone, str) else zone
    days = F.sequence(F.lit(f"{year}-01-01 12:00:00").cast("timestamp"), F.lit(f"{year}-12-31 12:00:00").cast("timestamp"), F.expr("INTERVAL 1 DAY"))
    return F.transform(days, lambda t: utc_offset_minutes(t, z))


def offset_range(zones: DataFrame, zone: str, year: int) -> DataFrame:
    """(zone, lo, hi, seasonal) of each distinct zone in a year."""
    z = zones.where(F.col(zone).isNotNull()).select(zone).distinct().withColumn("__o", year_offsets(zone, year))
    return z.select(zone, F.array_min("__o").alias("lo"), F.array_max("__o").alias("hi"), (F.array_min("__o") != F.array_max("__o")).alias("seasonal"))


def zone_sets(members: DataFrame, owner: str, zone: str, year: int) -> DataFrame:
    """(owner, lo, hi, clocks): the union of an owner's zones as a range of offsets, and how many different clocks it has.

    Zones that agree on every day of the year are one clock.
    """
    z = members.where(F.col(zone).isNotNull()).select(zone).distinct().withColumn("__o", year_offsets(zone, year))
    both = members.select(owner, zone).distinct().join(z, zone)
    each = both.groupBy(owner).agg(F.min(F.array_min("__o")).alias("lo"), F.max(F.array_max("__o")).alias("hi"), F.countDistinct(F.xxhash64("__o")).alias("clocks"))
    return each


def zones_named(c: Column | str) -> Column:
    """array<string>: zones and offsets in a text, in order: IANA names, upper-case abbreviations, UTC+2 and its like as ``+02:00``."""
    c = F.col(c) if isinstance(c, str) else c
    short = "|".join(sorted((a.upper() for a in ABBREVIATIONS), key=lambda a: (-len(a), a)))
    regions = "Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific"
    found = F.regexp_extract_all(c, F.lit(rf"\b((?:UTC|GMT)\s?[+-]\d{{1,2}}(?::?\d{{2}})?|(?:{regions})/[A-Za-z_]+(?:/[A-Za-z_]+)?|(?:{short})\b)"), 1)
    names = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k.upper(), v)])

    def one(x: Column) -> Column:
        sign, hours, minutes = (F.regexp_extract(x, r"([+-])(\d{1,2})(?::?(\d{2}))?$", i) for i in (1, 2, 3))
        return F.when(sign != "", F.concat(sign, F.lpad(hours, 2, "0"), F.lit(":"), F.rpad(minutes, 2, "0"))).otherwise(F.coalesce(names[x], x))

    return F.transform(found, one)
