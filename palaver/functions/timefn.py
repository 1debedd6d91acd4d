"""Time expressions on zone-less timestamps (the session runs in UTC)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# The source clock starts in 2001; larger raw values are nanoseconds.
SOURCE_EPOCH_US = 978_307_200_000_000
NANOSECOND_THRESHOLD = 10**12
BUCKETS = ("day", "week", "month")


def source_time(raw: Column) -> Column:
    """Source clock value to a UTC timestamp; zero and null give null."""
    micros = F.when(raw > NANOSECOND_THRESHOLD, F.round(raw / 1000).cast("long")).otherwise(raw * 1_000_000)
    return F.when(
        raw.isNotNull() & (raw != 0), F.timestamp_micros(micros + F.lit(SOURCE_EPOCH_US)).cast("timestamp_ntz")
    )


def local_time(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def second_of(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Number of second boundaries crossed."""
    return second_of(end) - second_of(start)


def bucket(unit: str, ts: Column) -> Column:
    if unit not in BUCKETS:
        raise ValueError(f"bucket must be one of {sorted(BUCKETS)}")
    return F.date_format(F.date_trunc(unit, ts), "yyyy-MM-dd")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def year_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy")


def weekday(ts: Column) -> Column:
    """0 = Sunday."""
    return F.dayofweek(ts) - 1


def on_day(ts: Column, day: str) -> Column:
    """Range form of day equality, so that min/max statistics prune."""
    first = F.lit(day).cast("timestamp_ntz")
    return (ts >= first) & (ts < first + F.expr("INTERVAL 1 DAY"))


def since(ts: Column, as_of: str, days: int | None) -> Column:
    """Rolling window ending at ``as_of``; zero or None keeps everything."""
    if not days:
        return F.lit(True)
    return ts >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAY")
