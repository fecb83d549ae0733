"""Instants are 20-digit zero-padded epoch milliseconds as strings: their order as strings is their order in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import trimmed


def as_ms(ts: Column) -> Column:
    return ts.cast("bigint")


def stamp(ms: Column) -> Column:
    return F.lpad(ms.cast("string"), 20, "0")


def now_literal(ms: int) -> str:
    return str(ms).rjust(20, "0")


def add_ms(ts: Column, ms: Column | int) -> Column:
    """Not of digits: null."""
    n = ms if isinstance(ms, Column) else F.lit(ms)
    return F.when(ts.rlike("^[0-9]+$"), stamp(as_ms(ts) + n))


def sub_ms(ts: Column, ms: Column | int) -> Column:
    """Not below zero."""
    n = ms if isinstance(ms, Column) else F.lit(ms)
    return F.when(ts.rlike("^[0-9]+$"), stamp(F.greatest(F.lit(0), as_ms(ts) - n)))


def minutes_between(start: Column, stop: Column) -> Column:
    """Truncated towards zero; may be negative."""
    d = (as_ms(stop) - as_ms(start)) / 60000
    return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("bigint")


def lenient_ms(value: Column) -> Column:
    """The digits of a text as a number; 0 without any."""
    return F.coalesce(F.regexp_replace(value, r"[^0-9]", "").try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def normalize_event_time(value: Column) -> Column:
    """Digits or an ISO date-time to a stamp; negative or unreadable: null."""
    value = trimmed(value)
    digits = F.when(value.rlike("^0*[0-9]{1,18}$"), value.cast("bigint"))
    parsed = F.unix_millis(F.try_to_timestamp(value))
    ms = F.coalesce(digits, F.when(parsed >= 0, parsed))
    return F.when(ms.isNotNull(), stamp(ms))


def cutoff(now: str, seconds: int) -> str:
    return str(max(0, int(now) - seconds * 1000)).rjust(20, "0")
