"""Time column expressions. Timestamps stay without a zone (TIMESTAMP_NTZ) throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def seconds(ts: Column) -> Column:
    """Seconds since 1970, with fractions."""
    return micros(ts) / F.lit(1_000_000.0)


def elapsed_s(before: Column, after: Column) -> Column:
    """Seconds between two timestamps, exact to the microsecond."""
    return (micros(after) - micros(before)) / F.lit(1_000_000.0)


def minute_gap(before: Column, after: Column) -> Column:
    """Minute boundaries between two timestamps, not elapsed minutes."""
    minute = lambda ts: F.floor(micros(ts) / 60_000_000)
    return minute(after) - minute(before)


def floor_bin(ts: Column, minutes: int) -> Column:
    """Start of the bin of so many minutes, counted from 1970."""
    width = minutes * 60_000_000
    return F.timestamp_add("MICROSECOND", (F.floor(micros(ts) / width) * width).cast("long"), F.expr(_EPOCH))


def round_bin_s(ts: Column, width_s: int) -> Column:
    """Seconds since 1970 rounded to a multiple of width_s, ties to even."""
    return (F.rint(seconds(ts) / width_s) * width_s).cast("long")


def bus_period(ts: Column) -> Column:
    """AM_peak from 6 to 10, PM_peak from 17 to 21, else off_peak."""
    h = F.hour(ts)
    return F.when((h >= 6) & (h < 10), "AM_peak").when((h >= 17) & (h < 21), "PM_peak").otherwise("off_peak")


def telecom_period(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when((h >= 7) & (h < 10), "AM_PEAK").when((h >= 10) & (h < 16), "MIDDAY").when((h >= 16) & (h < 19), "PM_PEAK").when((h >= 19) & (h < 22), "EVENING").otherwise("NIGHT")


def is_monsoon(ts: Column) -> Column:
    return F.month(ts).between(6, 9)


def sunday_zero(ts: Column) -> Column:
    """Day of the week, Sunday 0."""
    return F.dayofweek(ts) - 1


def day_type(ts: Column) -> Column:
    d = F.weekday(ts)
    return F.when(d == 5, "SATURDAY").when(d == 6, "SUNDAY").otherwise("WEEKDAY")


def effective_day(ts: Column, start_hour: int = 3) -> Column:
    """The date, where a day begins at start_hour."""
    return F.to_date(F.timestamp_add("HOUR", F.lit(-start_hour), ts))


def in_hours(ts: Column, start: int, end: int) -> Column:
    """Whether the hour is in [start, end), past midnight if start is after end."""
    h = F.hour(ts)
    return (h >= start) & (h < end) if start <= end else (h >= start) | (h < end)


def clock_minutes(text: Column) -> Column:
    """Minutes of H:MM:SS or HHMMSS; hours may exceed 24; null for anything else."""
    part = lambda p, i: F.regexp_extract(text, p, i).cast("double")
    colon, plain = r"^(\d{1,2}):(\d{2}):(\d{2})$", r"^(\d{2})(\d{2})(\d{2})$"
    of = lambda p: part(p, 1) * 60 + part(p, 2) + part(p, 3) / 60
    return F.when(text.rlike(colon), of(colon)).when(text.rlike(plain), of(plain))


def canonical_clock(text: Column) -> Column:
    """H:MM:SS or HHMMSS as HH:MM:SS, else null."""
    colon, plain = r"^(\d{1,2}):(\d{2}):(\d{2})$", r"^(\d{2})(\d{2})(\d{2})$"
    of = lambda p: F.concat_ws(":", F.lpad(F.regexp_extract(text, p, 1), 2, "0"), F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 3))
    return F.when(text.rlike(colon), of(colon)).when(text.rlike(plain), of(plain))


def minutes_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60.0 + F.minute(ts) + F.second(ts) / 60.0


def circular_minutes(a: Column, b: Column) -> Column:
    """Least distance of two times of day, in minutes."""
    d = F.pmod(F.abs(a - b), F.lit(1440.0))
    return F.least(d, 1440 - d)


def parse_timestamp(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """(sine, cosine) of a value's place in its period."""
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)
