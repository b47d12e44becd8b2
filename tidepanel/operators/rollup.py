"""Strict rollup of bars to a coarser grid, with diagnostics for every rejected group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.timefn import MICROS, floor_micros, micros
from tidepanel.schemas import require_columns

_NEEDED = [
    "symbol", "open_time", "open", "high", "low", "close",
    "base_volume", "quote_volume", "trade_count", "close_time",
]


def _exact_offsets(counts: Column) -> Column:
    return F.forall(counts, lambda n: n == 1)


def rollup_groups(
    bars: DataFrame, source_seconds: int = 3600, target_seconds: int = 14_400
) -> DataFrame:
    """All target groups, accepted or not, from one hash aggregation with map-side partials.

    ``offset_counts[i]`` is the number of source bars at offset i. It holds the same information
    as the sorted list of offsets but has a fixed size, whatever a broken source repeats. Ordering
    columns are primitive, so the aggregate stays a hash aggregate.
    """
    require_columns(bars, _NEEDED, "bars")
    slots = target_seconds // source_seconds
    group_us = floor_micros(micros(F.col("open_time")), target_seconds * MICROS)
    offset_us = micros(F.col("open_time")) - group_us
    keyed = bars.select(
        *_NEEDED,
        F.timestamp_micros(group_us).alias("group_open"),
        F.floor(offset_us / F.lit(source_seconds * MICROS)).cast("int").alias("slot"),
    )
    return (
        keyed.groupBy("symbol", "group_open")
        .agg(
            F.min_by("open", "open_time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"),
            F.sum("base_volume").alias("base_volume"),
            F.sum("quote_volume").alias("quote_volume"),
            F.sum("trade_count").alias("trade_count"),
            F.max_by("close_time", "open_time").alias("close_time"),
            F.count(F.lit(1)).alias("source_hour_count"),
            *[F.count_if(F.col("slot") == i).alias(f"__slot{i}") for i in range(slots)],
        )
        .withColumn("offset_counts", F.array(*[F.col(f"__slot{i}") for i in range(slots)]))
        .withColumn("is_accepted", _exact_offsets(F.col("offset_counts")))
        .drop(*[f"__slot{i}" for i in range(slots)])
        .withColumnRenamed("group_open", "open_time")
    )


def _bars_of(groups: DataFrame) -> DataFrame:
    return groups.filter("is_accepted").select(
        "symbol", "open_time", "open", "high", "low", "close", "base_volume", "quote_volume",
        "trade_count", "close_time", "source_hour_count",
    )


def rollup_strict(
    bars: DataFrame, source_seconds: int = 3600, target_seconds: int = 14_400
) -> DataFrame:
    """Completed target bars: every source slot present exactly once, nothing filled."""
    return _bars_of(rollup_groups(bars, source_seconds, target_seconds))


def rollup_rejected(
    bars: DataFrame, source_seconds: int = 3600, target_seconds: int = 14_400
) -> DataFrame:
    """Rejected groups with their size, distinct opens and offsets.

    ``offsets`` lists the distinct offsets; repeats are in ``offset_counts``. Distinct opens are
    counted on the grid: validated bars open exactly on it.
    """
    slots = target_seconds // source_seconds
    present = F.filter(
        F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.get(F.col("offset_counts"), i) > 0
    )
    return (
        rollup_groups(bars, source_seconds, target_seconds)
        .filter(~F.col("is_accepted"))
        .withColumn("offsets", present)
        .select(
            "symbol", "open_time", "source_hour_count",
            F.size("offsets").cast("bigint").alias("unique_hour_count"),
            "offsets", "offset_counts",
        )
    )


def unexplained_rejects(
    rejected: DataFrame, boundaries: DataFrame, cutoff: Column, target_seconds: int = 14_400
) -> DataFrame:
    """Rejected groups that no lifecycle boundary and no cutoff explains.

    ``boundaries`` has ``(symbol, point)``. A group is explained when a point lies strictly inside
    it, so the test is an equality on the group that holds the point, not a range join.
    """
    width = target_seconds * MICROS
    group_us = floor_micros(micros(F.col("point")), width)
    inner = (
        boundaries.filter(micros(F.col("point")) > group_us)
        .select("symbol", F.timestamp_micros(group_us).alias("open_time"))
        .distinct()
    )
    start = micros(F.col("open_time"))
    holds_cutoff = (start < micros(cutoff)) & (micros(cutoff) < start + F.lit(width))
    return rejected.filter(~F.coalesce(holds_cutoff, F.lit(False))).join(
        inner, ["symbol", "open_time"], "left_anti"
    )
