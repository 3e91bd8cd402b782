"""Decimal time stamps YYYYMMDDHHMISS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 1601 to 1970.
EPOCH = 11_644_473_600_000_000


def stamp(timestamp: Column, digits: int = 14) -> Column:
    """As a long of 14 digits, or 12 without seconds."""
    return F.date_format(timestamp, "yyyyMMddHHmmss" if digits == 14 else "yyyyMMddHHmm").cast("long")


def file_time(ticks: Column, zone: str = "UTC") -> Column:
    """Stamp of a count of 100 ns since 1601 UTC, in the zone's time of that date; 0 if it isn't positive or beyond the year 9999."""
    micros = F.floor(ticks / 10).cast("long") - F.lit(EPOCH)
    usable = (ticks > 0) & (micros < F.lit(253_402_300_800_000_000))
    return F.when(usable, stamp(F.from_utc_timestamp(F.timestamp_micros(F.when(usable, micros)), zone))).otherwise(F.lit(0).cast("long"))


def civil_from_days(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def parse_stamp(value: Column) -> Column:
    """Timestamp of a stamp of 12 or 14 digits; null for anything else."""
    text = value.cast("string")
    return F.when(F.length(text) == 14, F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))).when(F.length(text) == 12, F.try_to_timestamp(text, F.lit("yyyyMMddHHmm")))


def month_folder(value: Column) -> Column:
    return F.date_format(parse_stamp(value), "yyyy-MM")
