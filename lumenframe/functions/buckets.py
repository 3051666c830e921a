"""Calendar bucket labels: day, week, month, quarter and year as text."""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import Bucket

UNITS = ("day", "week", "month", "quarter", "year")
DAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def parse_bucket(unit: str, zone: str | None = None, week_start: str | None = None) -> Bucket:
    """A bucket from its text arguments; raises ValueError with the reason."""
    unit = (unit or "").strip().lower()
    if unit not in UNITS:
        raise ValueError(f"Unknown time bucket '{unit}'; expected one of {', '.join(UNITS)}")
    zone = (zone or "").strip() or "UTC"
    try:
        ZoneInfo(zone)
    except Exception as e:
        raise ValueError(f"Unknown time zone '{zone}'") from e
    start = (week_start or "").strip().upper()
    if start and unit != "week":
        raise ValueError("A week start is only allowed with week buckets")
    matches = [d for d in DAYS if start and d.startswith(start) and len(start) >= 3]
    if start and not matches:
        raise ValueError(f"Unknown week start '{week_start}'")
    return Bucket(unit, zone, matches[0] if start else "MONDAY")


def describe(bucket: Bucket) -> str:
    return ":".join([bucket.unit.upper(), bucket.zone, *([bucket.week_start] if bucket.unit == "week" else [])])


def bucket_label(ts: Column, bucket: Bucket) -> Column:
    """The label of a timestamp (without zone: taken as UTC); null for null."""
    at = ts.cast("timestamp_ntz")
    if bucket.zone != "UTC":
        at = F.convert_timezone(F.lit("UTC"), F.lit(bucket.zone), at)
    if bucket.unit == "day":
        return F.date_format(at, "yyyy-MM-dd")
    if bucket.unit == "month":
        return F.date_format(at, "yyyy-MM")
    if bucket.unit == "year":
        return F.date_format(at, "yyyy")
    if bucket.unit == "quarter":
        return F.concat(F.date_format(at, "yyyy"), F.lit("-Q"), F.quarter(at).cast("string"))
    # A week belongs to the year that holds its fourth day.
    day = at.cast("date")
    iso = F.pmod(F.dayofweek(day) + 5, F.lit(7))  # Monday is 0
    start = F.date_sub(day, F.pmod(iso - DAYS.index(bucket.week_start), F.lit(7)))
    pivot = F.date_add(start, 3)
    week = F.floor((F.dayofyear(pivot) - 1) / 7).cast("int") + 1
    return F.when(day.isNotNull(), F.format_string("%04d-W%02d", F.year(pivot), week))
