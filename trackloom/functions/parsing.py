"""Durations, years and whole numbers from text; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.normalize import text


# Forms of durations and years.
ISO_DURATION = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
YEAR = r"\b((?:19|20)\d\d)\b"


def whole(value: Column) -> Column:
    """A number in text, cut to a whole one ("3.7" is 3)."""
    number = value.cast("string").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 2**31), number).try_cast("int")


def clock(value: Column) -> Column:
    """``M:SS`` or ``H:MM:SS`` in seconds."""
    parts = F.split(value, ":")
    n = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    return F.when(F.size(parts) == 2, n(0) * 60 + n(1)).when(F.size(parts) == 3, n(0) * 3600 + n(1) * 60 + n(2))


def duration(value: Column) -> Column:
    """Seconds. Whole numbers over 1000 are milliseconds, so 1200 seconds become 1; 2.5 is 2."""
    value = value.cast("string")
    digits = value.try_cast("long")
    seconds = F.when(value.rlike(r"^\d+$"), F.when(digits > 1000, F.floor(digits / 1000)).otherwise(digits))
    return F.when(text(value) == "", None).when(value.rlike(r"^\d+$"), seconds.cast("int")).when(value.contains(":"), clock(value)).otherwise(whole(value))


def iso_duration(value: Column) -> Column:
    """``PT1H2M3S`` in seconds, 0 as null; anything else as :func:`duration`."""
    n = lambda i: F.coalesce(F.regexp_extract(value, ISO_DURATION, i).try_cast("int"), F.lit(0))
    total = n(1) * 3600 + n(2) * 60 + n(3)
    return F.when(value.startswith("PT"), F.nullif(total, F.lit(0))).otherwise(duration(value))


def playlist_time(value: Column) -> Column:
    """As :func:`duration` but without the milliseconds rule."""
    value = F.trim(value.cast("string"))
    return F.when(text(value) == "", None).when(value.contains(":"), clock(value)).otherwise(whole(value))


def milliseconds(value: Column) -> Column:
    return F.floor(value.cast("string").try_cast("double") / 1000).try_cast("int")


def year(value: Column) -> Column:
    value = value.cast("string")
    found = F.nullif(F.regexp_extract(value, YEAR, 1), F.lit(""))
    return F.coalesce(found.try_cast("int"), whole(value))


def time_text(seconds: Column) -> Column:
    """``H:MM:SS`` from an hour on, else ``M:SS``; null is empty."""
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    long = F.format_string("%d:%02d:%02d", hours, minutes, rest)
    return F.when(seconds.isNull(), F.lit("")).when(hours > 0, long).otherwise(F.format_string("%d:%02d", F.floor(seconds / 60), rest))


def percent(value: Column) -> Column:
    return F.round(value * 100, 2)
