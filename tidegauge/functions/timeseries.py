"""Time buckets and the first/last family of aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the width units; months and years are calendar units.
UNITS = {"s": 1, "second": 1, "sec": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}
CALENDAR = {"mon": 1, "month": 1, "y": 12, "year": 12}


def width_of(width: int | str) -> tuple[int, int]:
    """(seconds, months) of a width: a number of seconds, or a number with a unit such as '300s' or '400000hour'."""
    if isinstance(width, int):
        seconds, months = width, 0
    else:
        found = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", width)
        if not found:
            raise ValueError(f"not a bucket width: {width!r}")
        number, unit = int(found[1]), found[2].lower()
        unit = unit if unit in UNITS or unit in CALENDAR else unit.rstrip("s")
        if unit not in UNITS and unit not in CALENDAR:
            raise ValueError(f"not a unit of time: {found[2]!r}")
        seconds, months = number * UNITS.get(unit, 0), number * CALENDAR.get(unit, 0)
    if seconds <= 0 and months <= 0:
        raise ValueError("a bucket width must be positive")
    return seconds, months


def time_bucket(ts: str | Column, width: int | str) -> Column:
    """Start of the bucket of `ts`; buckets are counted from 1970-01-01 in UTC, months and years from its first month."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds, months = width_of(width)
    if months:
        at = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
        start = F.floor(at / months) * months
        return F.make_timestamp((F.lit(1970) + F.floor(start / 12)).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    micros = F.unix_micros(ts.cast("timestamp"))
    step = seconds * 1_000_000
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(step)))


def _known(x: Column, ts: Column, bound: str | None) -> Column:
    known = x.isNotNull()
    return known if bound is None else known & (ts <= F.lit(bound).cast("timestamp"))


def first(x: Column, ts: Column) -> Column:
    """Value of the earliest row where x is not null."""
    return F.min_by(x, F.when(x.isNotNull(), ts))


def last(x: Column, ts: Column, bound: str | None = None) -> Column:
    """Value of the latest row where x is not null, at `bound` or before."""
    return F.max_by(x, F.when(_known(x, ts, bound), ts))


def firstts(x: Column, ts: Column) -> Column:
    return F.min(F.when(x.isNotNull(), ts))


def lastts(x: Column, ts: Column, bound: str | None = None) -> Column:
    return F.max(F.when(_known(x, ts, bound), ts))


def first_row(x: Column, ts: Column) -> Column:
    """Value of the earliest row, null or not."""
    return F.min_by(x, ts)


def last_row(x: Column, ts: Column) -> Column:
    return F.max_by(x, ts)


def first_row_ts(ts: Column) -> Column:
    return F.min(ts)


def last_row_ts(ts: Column) -> Column:
    return F.max(ts)


def star(kind: str, columns: list[str], ts: str) -> list[Column]:
    """first(*), last(*), first_row(*), last_row(*): one aggregate for each column, named like `last(col)`."""
    of = {"first": first, "last": last, "first_row": first_row, "last_row": last_row}[kind]
    return [of(F.col(c), F.col(ts)).alias(f"{kind}({c})") for c in columns]
