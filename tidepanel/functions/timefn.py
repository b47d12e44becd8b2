"""Time arithmetic on instants, days and months (session time zone is UTC)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

MICROS = 1_000_000

Split = tuple[str, str, str | None]


def micros(col: Column) -> Column:
    return F.unix_micros(col)


def floor_micros(us: Column, width_us: int) -> Column:
    """Largest multiple of the width at or below the value, in exact integer arithmetic."""
    return us - F.pmod(us, F.lit(width_us))


def floor_to(col: Column, seconds: int) -> Column:
    """Floor an instant to a UTC-aligned bucket."""
    return F.timestamp_micros(floor_micros(micros(col), seconds * MICROS))


def plus_seconds(col: Column, seconds: int) -> Column:
    return F.timestamp_micros(micros(col) + F.lit(seconds * MICROS))


def period_bounds(kind: Column, period: Column) -> tuple[Column, Column]:
    """Half-open bounds of a ``YYYY-MM`` month or ``YYYY-MM-DD`` day; NULL for anything else."""
    month = F.try_to_date(F.concat(period, F.lit("-01")), "yyyy-MM-dd")
    day = F.try_to_date(period, "yyyy-MM-dd")
    start = F.when(kind == "monthly", month).when(kind == "daily", day)
    end = F.when(kind == "monthly", F.add_months(month, 1)).when(kind == "daily", F.date_add(day, 1))
    return start.cast("timestamp"), end.cast("timestamp")


def last_completed_month(col: Column) -> Column:
    return F.date_format(F.add_months(F.trunc(col, "MM"), -1), "yyyy-MM")


def is_utc_instant_text(col: Column) -> Column:
    """Canonical ISO text of a UTC instant: seconds or microseconds, ending in Z, a real date."""
    shape = col.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.(?!0{6})\d{6})?Z\z")
    return F.coalesce(shape & F.try_to_timestamp(col).isNotNull(), F.lit(False))


def is_utc_day_text(col: Column) -> Column:
    """Canonical text of a UTC midnight."""
    shape = col.rlike(r"^\d{4}-\d{2}-\d{2}T00:00:00Z\z")
    return F.coalesce(shape & F.try_to_timestamp(col).isNotNull(), F.lit(False))


def age_days(at: Column, anchor: Column) -> Column:
    return (micros(at) - micros(anchor)) / F.lit(86_400 * MICROS)


def classify_split(col: Column, splits: Sequence[Split]) -> Column:
    """Name of the closed range holding the instant; NULL outside; a later definition wins."""
    result = F.lit(None).cast("string")
    for name, start, end in splits:
        inside = col >= F.lit(start).cast("timestamp")
        if end is not None:
            inside = inside & (col <= F.lit(end).cast("timestamp"))
        result = F.when(inside, F.lit(name)).otherwise(result)
    return result


def horizon_in_split(signal: Column, endpoint: Column, splits: Sequence[Split]) -> Column:
    """True only where both instants lie in one and the same split."""
    same = classify_split(signal, splits) == classify_split(endpoint, splits)
    return F.coalesce(same, F.lit(False))


def page_ranges(start: Column, cutoff: Column, page_hours: int) -> Column:
    """Array of half-open [start, end) pages covering the hours up to the cutoff; the last is short."""
    first = floor_micros(micros(start), 3600 * MICROS)
    last = floor_micros(micros(cutoff), 3600 * MICROS)
    step = page_hours * 3600 * MICROS
    starts = F.sequence(first, last - F.lit(1), F.lit(step))
    pages = F.transform(
        starts,
        lambda s: F.struct(
            F.timestamp_micros(s).alias("page_start"),
            F.timestamp_micros(F.least(s + F.lit(step), last)).alias("page_end"),
        ),
    )
    return F.when(first < last, pages)
