"""Strict casts: exact or NULL, never truncated. A violation is "non-null in, null out"."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

MAX_EPOCH_MILLIS = 99_999_999_999_999


def _in_range(value: Column, minimum: int | None, maximum: int | None) -> Column:
    if minimum is not None:
        value = F.when(value >= F.lit(minimum), value)
    if maximum is not None:
        value = F.when(value <= F.lit(maximum), value)
    return value


def strict_integer(
    col: Column,
    dtype: T.DataType | None = None,
    minimum: int | None = None,
    maximum: int | None = None,
) -> Column:
    """Exact integer as bigint. ``dtype`` is the column's type (text when omitted).

    Text must be an optionally signed digit string; floats must be finite and integral; booleans
    are never integers.
    """
    dtype = dtype or T.StringType()
    if isinstance(dtype, T.StringType):
        value = F.when(col.rlike(r"^[+-]?[0-9]+\z"), col.try_cast("bigint"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        exact = ~F.isnan(col) & (F.abs(col) < F.lit(9.2e18)) & (F.floor(col) == col)
        value = F.when(exact, col.try_cast("bigint"))
    elif isinstance(dtype, T.IntegralType):
        value = col.cast("bigint")
    else:
        value = F.lit(None).cast("bigint")
    return _in_range(value, minimum, maximum)


def epoch_millis(col: Column, dtype: T.DataType | None = None) -> Column:
    """Plausible non-negative Unix milliseconds as an instant, else NULL."""
    return F.timestamp_millis(strict_integer(col, dtype, 0, MAX_EPOCH_MILLIS))


def strict_double(col: Column) -> Column:
    """Numeric text as a finite-or-null double; junk becomes NULL."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def cast_violation(raw: Column, parsed: Column) -> Column:
    return raw.isNotNull() & parsed.isNull()
