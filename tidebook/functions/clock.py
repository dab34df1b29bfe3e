"""Time columns: wire format, buckets and the KST business day."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wire formats and the business-day zone (UTC+9, no daylight saving).
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
BUCKET_LABEL = "yyyy-MM-dd'T'HH:mm:'00Z'"
FILE_STAMP = "yyyyMMdd'T'HHmmss'Z'"
KST_STAMP = "yyyyMMdd'T'HHmmss"
KST_HOURS = 9


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_MILLIS)


def parse_iso(text: Column) -> Column:
    """Wire timestamp to timestamp; anything else becomes null."""
    return F.try_to_timestamp(text, F.lit(ISO_MILLIS))


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the fixed-width bucket that holds `ts`, as unix seconds."""
    unix = F.unix_seconds(ts)
    return unix - F.pmod(unix, F.lit(seconds))


def bucket_label(unix: Column) -> Column:
    return F.date_format(F.timestamp_seconds(unix), BUCKET_LABEL)


def kst_date(ts: Column) -> Column:
    return (ts + F.expr(f"interval {KST_HOURS} hours")).cast("date")


def kst_hour(ts: Column) -> Column:
    return F.date_format(ts + F.expr(f"interval {KST_HOURS} hours"), "yyyy-MM-dd HH:00 'KST'")


def kst_day(day: str | date) -> tuple[datetime, datetime]:
    """UTC bounds [from, to) of one KST day."""
    if isinstance(day, str):
        day = date.fromisoformat(day)
    start = datetime(day.year, day.month, day.day, tzinfo=timezone.utc) - timedelta(hours=KST_HOURS)
    return start, start + timedelta(days=1)


def moment(value: datetime | str) -> datetime:
    """Aware UTC datetime from a datetime or ISO text; naive input is read as UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value


def within(ts: Column, start=None, end=None) -> Column:
    """Half-open filter start <= ts < end on the bare column, so that it reaches the scan."""
    test = F.lit(True)
    if start is not None:
        test = test & (ts >= F.lit(moment(start)))
    if end is not None:
        test = test & (ts < F.lit(moment(end)))
    return test
