"""Timestamps of any form to one UTC instant, inside the JVM.

All formats are one regular expression with named groups. It runs once for a
value: the replacement lists the groups of each component side by side, so
whichever alternative matched, the components come out in fixed places.
Calendar ranges are checked on integers, and the instant is put together by
integer day arithmetic; only wall times of a zone need the zone's rules.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes of abbreviations are known up to this year; later ones keep the last meaning.
YEARS_TO = 2038

# Month names as exports of several languages write them, January first.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de short": "jan feb mär apr mai jun jul aug sept okt nov dez",
    "fr short": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es short": "ene feb mar abr may jun jul ago sept oct nov dic",
    "pt short": "jan fev mar abr mai jun jul ago set out nov dez",
    "it short": "gen feb mar apr mag giu lug ago set ott nov dic",
    "nl short": "jan feb mrt apr mei jun jul aug sep okt nov dec",
    "pl short": "sty lut mar kwi maj cze lip sie wrz paź lis gru",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "pl as named": "styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik listopad grudzień",
}

_MONTH_OF = {name: i + 1 for line in MONTHS.values() for i, name in enumerate(line.split())}

_CLOCK = r"(?<h{n}>\d{{1,2}}):(?<mi{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?\s*+(?<ap{n}>[AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*+(?<z{n}>[Zz]|[+-]\d{{2}}(?::?\d{{2}})?|\p{{L}}{{2,5}})?\s*+(?:\[(?<r{n}>[\w/+\-]+)\])?"
_TIME = rf"(?:(?:[Tt]|,?\s++){_CLOCK}{_ZONE})?"
_WEEKDAY = r"(?:\p{{L}}{{2,4}}\.?,?\s++)?"
_NAME = r"(?<{k}{n}>\p{{L}}{{3,12}})\.?"

#: One alternative for each form; {n} keeps the names of its groups apart.
_FORMS = [
    r"(?<y{n}>\d{{4}})[-/.](?<m{n}>\d{{1,2}})[-/.](?<d{n}>\d{{1,2}})" + _TIME,
    r"(?<y{n}>\d{{4}})(?<m{n}>\d{{2}})(?<d{n}>\d{{2}})(?:[Tt](?<h{n}>\d{{2}})(?<mi{n}>\d{{2}})(?<s{n}>\d{{2}})?(?:[.,](?<f{n}>\d+))?" + _ZONE + ")?",
    r"(?<a{n}>\d{{1,2}})/(?<b{n}>\d{{1,2}})/(?<y{n}>\d{{4}})" + _TIME,
    r"(?<d{n}>\d{{1,2}})[.\-](?<m{n}>\d{{1,2}})[.\-](?<y{n}>\d{{4}})" + _TIME,
    _WEEKDAY + r"(?<d{n}>\d{{1,2}})\.?(?:\s++de)?[\s-]++" + _NAME.replace("{k}", "k") + r"(?:\s++de)?[\s-]++(?<y{n}>\d{{4}})" + _TIME,
    _WEEKDAY + _NAME.replace("{k}", "k") + r"\s++(?<d{n}>\d{{1,2}}),?\s++(?<y{n}>\d{{4}})" + _TIME,
    _NAME.replace("{k}", "k") + r"(?:\s++de)?,?\s++(?<y{n}>\d{{4}})",
    r"(?<y{n}>\d{{4}})年(?<m{n}>\d{{1,2}})月(?:(?<d{n}>\d{{1,2}})日" + _TIME + ")?",
    r"(?<m{n}>\d{{1,2}})[/.](?<y{n}>\d{{4}})",
    r"(?<y{n}>\d{{4}})[-/.](?<m{n}>\d{{1,2}})",
    r"(?<y{n}>\d{{4}})",
    r"(?<e{n}>\d{{9,19}})",
]

#: What stands before each component in the replacement, and the components in their order.
MARK = "\x01"
PARTS = ["y", "m", "d", "a", "b", "k", "h", "mi", "s", "f", "ap", "z", "r", "e"]


def _alternation() -> tuple[str, str]:
    forms = [f.replace("{n}", f"{i}x").replace("{{", "{").replace("}}", "}") for i, f in enumerate(_FORMS)]
    whole = r"^[\s\u00a0]*+(?:" + "|".join(f"(?:{f})" for f in forms) + r")[\s\u00a0]*+$"
    out = MARK + MARK.join("".join(f"${{{p}{i}x}}" for i, f in enumerate(forms) if f"<{p}{i}x>" in f) for p in PARTS)
    return whole, out


PATTERN, REPLACEMENT = _alternation()


@lru_cache(maxsize=1)
def _zones() -> list[tuple[str, dict[str, list[tuple[int, int]]]]]:
    """IANA zones with what their abbreviations stand for: (from, offset) in seconds, in order of time.

    An abbreviation that always meant one offset has one entry. Where a zone
    changed its meaning, the instant of the change is found to the second.
    """
    from zoneinfo import ZoneInfo, available_timezones

    first, month = datetime(1970, 1, 1, tzinfo=timezone.utc), 2_629_746
    samples = [first + timedelta(seconds=month * k) for k in range(12 * (YEARS_TO - 1970))]
    out = []
    for name in sorted(available_timezones()):
        zone = ZoneInfo(name)

        def said(at, zone=zone):
            local = at.astimezone(zone)
            return local.tzname().upper(), int(local.utcoffset().total_seconds())

        runs: dict[str, list[tuple[int, int]]] = {}
        before: dict[str, datetime] = {}
        for at in samples:
            short, offset = said(at)
            known = runs.setdefault(short, [])
            if not known or known[-1][1] != offset:
                lo, hi = before.get(short, at), at
                while hi - lo > timedelta(seconds=1):
                    mid = lo + (hi - lo) // 2
                    mid = mid.replace(microsecond=0) if mid.replace(microsecond=0) > lo else mid
                    lo, hi = (lo, mid) if said(mid) == (short, offset) else (mid, hi)
                known.append((int((hi - first).total_seconds()) if known else -(2**60), offset))
            before[short] = at
        out.append((name, runs))
    return out


def zone_table(spark: SparkSession) -> DataFrame:
    """(zone, abbreviations): some 600 rows, as many as IANA has zones."""
    return spark.createDataFrame(_zones(), "zone string, abbreviations map<string,array<struct<since:long,offset:int>>>")


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, on integers only."""
    div = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = div(yy, 400)
    yoe = yy - era * 400
    doy = div((m + F.when(m > 2, -3).otherwise(9)) * 153 + 2, 5) + d - 1
    return era * 146097 + yoe * 365 + div(yoe, 4) - div(yoe, 100) + doy - 719468


def parse_instants(df: DataFrame, value: str, zone: str, day_first: str, out: str = "instant_us") -> DataFrame:
    """Add ``out``: microseconds since 1970-01-01 UTC of the text in ``value``.

    ``zone`` names the column with the IANA zone for wall times (null or unknown:
    UTC), ``day_first`` a boolean column for the order in slashed dates (null:
    true). Placeholders, blank and null texts, impossible dates, clock times,
    offsets and unknown zones give null. A wall time that occurs twice is the
    first, a skipped one is read with the offset before; finer digits are cut.
    """
    zones = zone_table(df.sparkSession)
    ours = zones.select(F.col("zone").alias("__own"), F.col("abbreviations").alias("__short"))
    theirs = zones.select(F.col("zone").alias("__named"))
    month_of = F.create_map(*[F.lit(x) for kv in _MONTH_OF.items() for x in kv])
    cols = df.columns
    # The pattern runs once: what it replaced starts with the mark, all else stays as it was.
    df = df.withColumn("__p", F.regexp_replace(value, PATTERN, REPLACEMENT))
    df = df.withColumn("__p", F.when(F.col("__p").startswith(MARK) & ~F.contains(F.col(value), F.lit(MARK)), F.split("__p", MARK)))
    part = {k: F.col("__p")[i + 1] for i, k in enumerate(PARTS)}
    first = F.coalesce(F.col(day_first), F.lit(True))
    a, b = _int(part["a"]), _int(part["b"])
    df = df.select(
        *cols,
        _int(part["y"]).alias("__y"),
        F.coalesce(_int(part["m"]), F.when(a.isNotNull(), F.when(first, b).otherwise(a)), F.when(part["k"] != "", F.coalesce(month_of[F.lower(part["k"])], F.lit(0))), F.lit(1)).alias("__m"),
        F.coalesce(_int(part["d"]), F.when(a.isNotNull(), F.when(first, a).otherwise(b)), F.lit(1)).alias("__d"),
        F.coalesce(_int(part["h"]), F.lit(0)).alias("__h"), F.coalesce(_int(part["mi"]), F.lit(0)).alias("__mi"), F.coalesce(_int(part["s"]), F.lit(0)).alias("__s"),
        F.coalesce(F.rpad(F.substring(part["f"], 1, 6), 6, "0").cast("long"), F.lit(0)).alias("__f"),
        F.lower(F.substring(part["ap"], 1, 1)).alias("__ap"), F.upper(part["z"]).alias("__z"), F.nullif(part["r"], F.lit("")).alias("__r"),
        F.nullif(part["e"], F.lit("")).alias("__e"),
    )
    df = df.join(F.broadcast(ours), F.col(zone) == F.col("__own"), "left").join(F.broadcast(theirs), F.col("__r") == F.col("__named"), "left")

    y, m, d, h, z = (F.col(f"__{x}") for x in ("y", "m", "d", "h", "z"))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    clock = F.when(F.col("__ap") == "", h).when(h.between(1, 12), h % 12 + F.when(F.col("__ap") == "p", 12).otherwise(0))
    valid = y.between(1, 9999) & m.between(1, 12) & d.between(1, length) & clock.between(0, 23) & F.col("__mi").between(0, 59) & F.col("__s").between(0, 59)
    wall = (((days_from_civil(y, m, d) * 24 + clock) * 60 + F.col("__mi")) * 60 + F.col("__s")) * 1_000_000 + F.col("__f")

    hours, minutes = F.substring(z, 2, 2).cast("int"), F.coalesce(F.nullif(F.regexp_extract(z, r"(\d{2})$", 1), F.lit("")).cast("int"), F.lit(0))
    minutes = F.when(F.length(z) > 3, minutes).otherwise(0)
    signed = F.when((hours <= 18) & (minutes <= 59), (hours * 60 + minutes) * 60 * F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1))
    # Of an abbreviation's meanings the last one that had begun at the instant it gives.
    seconds = F.floor(wall / 1_000_000)
    meant = F.col("__short")[z]
    begun = F.filter(meant, lambda x: seconds - x["offset"] >= x["since"])
    offset = F.when(z.isin("Z", "UTC", "GMT", "UT"), 0).when(z.rlike(r"^[+-]"), signed).when(z != "", F.get(begun, F.size(begun) - 1)["offset"])
    place = F.when(F.col("__r").isNotNull(), F.col("__named")).otherwise(F.coalesce(F.col("__own"), F.lit("UTC")))
    at_place = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), place))
    digits = F.length("__e")
    # Epoch values by their number of digits: seconds, milliseconds, microseconds, nanoseconds.
    n = F.expr("try_cast(__e as long)")
    epoch = F.when(digits <= 11, n * 1_000_000).when(digits <= 14, n * 1000).when(digits <= 17, n).otherwise(F.expr("try_cast(__e as long) div 1000"))
    instant = F.when(F.col("__e").isNotNull(), epoch).when(valid, F.when(z != "", wall - offset * F.lit(1_000_000).cast("long")).otherwise(at_place))
    return df.select(*cols, instant.alias(out))
