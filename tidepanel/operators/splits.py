"""Chronological split guards."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.timefn import Split, classify_split


class SplitAccessError(PermissionError):
    """Rows lie outside all splits or in a split the caller was not allowed to read."""


def with_split(df: DataFrame, splits: Sequence[Split], time: str = "open_time") -> DataFrame:
    return df.withColumn("split", classify_split(F.col(time), splits))


def split_counts(df: DataFrame, splits: Sequence[Split], time: str = "open_time") -> DataFrame:
    return with_split(df, splits, time).groupBy("split").agg(F.count(F.lit(1)).alias("row_count"))


def guard_splits(
    df: DataFrame,
    splits: Sequence[Split],
    allowed: Sequence[str] | None = None,
    time: str = "open_time",
) -> None:
    """Fail when a row lies outside the splits or in one not allowed.

    Only distinct split names reach the driver, at most one per defined split plus NULL.
    """
    seen = with_split(df, splits, time).select("split").distinct().collect()
    require_splits({row[0] for row in seen}, allowed)


def require_splits(seen: Collection[str | None], allowed: Sequence[str] | None = None) -> None:
    """Fail when a split name is missing (a row outside all splits) or not allowed."""
    permitted = set(allowed or fv.DEFAULT_ALLOWED_SPLITS)
    if None in seen:
        raise SplitAccessError("rows lie outside the registered splits")
    if set(seen) - permitted:
        raise SplitAccessError(f"split access denied for {sorted(set(seen) - permitted)}")
