"""Dates, times and durations. A duration is a struct of months, days, seconds, nanos; a time with zone one of nanos, offset."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PARTS = ("months", "days", "seconds", "nanos")


def date(value: Column | None = None, **parts: Column) -> Column:
    """A date from text, from year, month and day, or today."""
    if parts:
        return F.make_date(parts["year"], parts.get("month", F.lit(1)), parts.get("day", F.lit(1)))
    return F.current_date() if value is None else F.to_date(value)


def local_datetime(value: Column | None = None, **parts: Column) -> Column:
    """A date and time without zone."""
    if parts:
        names = ("year", "month", "day", "hour", "minute", "second")
        return F.make_timestamp_ntz(*(parts.get(n, F.lit(1 if n in ("month", "day") else 0)) for n in names))
    return F.localtimestamp() if value is None else F.to_timestamp_ntz(value)


def local_time(value: Column) -> Column:
    """Nanoseconds since midnight of a text HH[:MM[:SS[.fraction]]]."""
    part = lambda i: F.coalesce(F.get(F.split(value, ":"), F.lit(i)).cast("double"), F.lit(0.0))
    return F.round((part(0) * 3600 + part(1) * 60 + part(2)) * 1e9).cast("bigint")


def time(value: Column) -> Column:
    """Struct of nanos and offset (seconds) of a text with Z or +HH:MM."""
    zone = F.regexp_extract(value, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.when(zone.isin("Z", ""), 0).otherwise(sign * (F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60))
    clock = F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.struct(local_time(clock).alias("nanos"), offset.cast("int").alias("offset"))


#: Fields of dates and times, and the names by which Spark extracts them.
FIELDS = {
    "year": "YEAR", "quarter": "QUARTER", "month": "MONTH", "week": "WEEK", "weekYear": "YEAROFWEEK", "day": "DAY",
    "ordinalDay": "DOY", "dayOfWeek": "DAYOFWEEK_ISO", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND",
}


def part(value: Column, field: str) -> Column:
    """A field of a date or time: those of FIELDS, dayOfQuarter, epochSeconds."""
    if field == "dayOfQuarter":
        return F.datediff(F.to_date(value), F.to_date(F.date_trunc("quarter", value))) + 1
    if field == "epochSeconds":
        return F.unix_seconds(value.cast("timestamp"))
    return F.extract(F.lit(FIELDS[field]), value).cast("int")


def duration(months: Column | int = 0, days: Column | int = 0, seconds: Column | int = 0, nanos: Column | int = 0) -> Column:
    given = (months, days, seconds, nanos)
    return F.struct(*((F.lit(v) if isinstance(v, int) else v).cast("bigint").alias(n) for n, v in zip(PARTS, given, strict=True)))


def add(a: Column, b: Column) -> Column:
    return F.struct(*((a[n] + b[n]).alias(n) for n in PARTS))


def times(a: Column, k: Column | float) -> Column:
    """A duration times a number; what is left of a month goes to days (a twelfth of a mean year each), of a day to seconds, and so on."""
    k = F.lit(float(k)) if isinstance(k, (int, float)) else k.cast("double")
    months = a["months"] * k
    days = a["days"] * k + (months - months.cast("bigint")) * 30.436875
    seconds = a["seconds"] * k + (days - days.cast("bigint")) * 86_400
    nanos = a["nanos"] * k + (seconds - seconds.cast("bigint")) * 1e9
    return F.struct(*(v.cast("bigint").alias(n) for n, v in zip(PARTS, (months, days, seconds, nanos), strict=True)))


def plus(value: Column, d: Column) -> Column:
    """A timestamp and a duration: months first, then days, then the clock."""
    moved = F.add_months(value, d["months"].cast("int"))
    clock = F.unix_micros(value.cast("timestamp")) - F.unix_micros(F.to_date(value).cast("timestamp"))
    day = F.date_add(moved, d["days"].cast("int"))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + clock + d["seconds"] * 1_000_000 + (d["nanos"] / 1000).cast("bigint"))
