"""Dates, clocks and periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def whole_days(later, earlier) -> Column:
    """Whole days between two instants, rounded towards the past."""
    micros = F.unix_micros(_c(later).cast("timestamp_ltz")) - F.unix_micros(_c(earlier).cast("timestamp_ltz"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def age_class(later, earlier, fresh_hours: int = 24, aging_hours: int = 72) -> Column:
    """fresh, aging or stale by the hours that passed; null without both instants."""
    h = (F.unix_micros(_c(later).cast("timestamp_ltz")) - F.unix_micros(_c(earlier).cast("timestamp_ltz"))) / F.lit(3_600_000_000)
    return F.when(h <= fresh_hours, "fresh").when(h <= aging_hours, "aging").when(h.isNotNull(), "stale")


def month_index(year, month) -> Column:
    """Months since year 0 of a partial date; a missing month counts as January."""
    return _c(year) * 12 + F.coalesce(_c(month), F.lit(1)) - 1


def periods_overlap(a_from, a_to, b_from, b_to) -> Column:
    """Whether two periods share a moment; an unknown end never overlaps."""
    return F.coalesce((_c(a_from) <= _c(b_to)) & (_c(b_from) <= _c(a_to)), F.lit(False))


def utc_offset_minutes(instant, zone) -> Column:
    """Offset from UTC, in minutes, that a zone has at an instant."""
    t = _c(instant)
    return ((F.unix_seconds(F.from_utc_timestamp(t, _c(zone))) - F.unix_seconds(t)) / 60).cast("int")


def local_instant(wall, zone) -> Column:
    """Instant of a wall time: the earlier of a repeated one, the first moment after a gap for a skipped one."""
    w, z = _c(wall), _c(zone)
    t = F.to_utc_timestamp(w, z)
    back = F.from_utc_timestamp(t, z)
    # In a gap the wall time read back is later by the gap; the hour before has the offset in force before.
    gap = F.unix_micros(back) - F.unix_micros(w)
    return F.when(gap > 0, F.timestamp_micros(F.unix_micros(t) - _past_gap(t, z, gap))).otherwise(t)


def _past_gap(t: Column, z: Column, gap: Column) -> Column:
    """Microseconds from the end of the gap to the instant that the wall time was read as."""
    # Gaps start on a minute: halving steps find the first instant with the later offset.
    after = lambda u: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(u), z)) - u
    at, new = F.unix_micros(t), F.unix_micros(F.from_utc_timestamp(t, z)) - F.unix_micros(t)
    steps = F.sequence(F.lit(0), F.lit(180))
    minute = F.lit(60_000_000).cast("long")
    start = at - (at % minute)
    held = F.filter(steps, lambda i: after(start - i * minute) == new)
    return at - (start - F.array_max(held) * minute)


def in_quiet_hours(minute, start, end) -> Column:
    """Whether a minute of the day is in [start, end), which may pass midnight; equal ends mean never."""
    m, s, e = _c(minute), _c(start), _c(end)
    return F.when(s < e, (m >= s) & (m < e)).when(s > e, (m >= s) | (m < e)).otherwise(F.lit(False))


def weekday_allowed(mask, day) -> Column:
    """Whether a bit mask, Monday lowest, has the weekday of a date."""
    return F.getbit(_c(mask).cast("int"), F.weekday(_c(day))) == 1


def backoff_seconds(failures, base: int, cap: int) -> Column:
    """base * 2^failures, at most ten doublings and at most ``cap``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(_c(failures), F.lit(10))), F.lit(cap)).cast("long")


def range_distance_hours(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Hours between two ranges of offsets in minutes; 0 where they meet."""
    return F.greatest(_c(b_lo) - _c(a_hi), _c(a_lo) - _c(b_hi), F.lit(0)) / 60
