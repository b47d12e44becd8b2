"""Gaps of series against expected ranges and active lifecycle intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.timefn import MICROS, micros
from tidepanel.operators.eligibility import exploded_intervals
from tidepanel.operators.series import series_steps

# Days per chunk keep a chunk of hourly points near a few thousand rows.
_CHUNK_STEPS = 4096


def _shift(col: Column, us: int) -> Column:
    return F.timestamp_micros(micros(col) + F.lit(us))


def _gap(kind: str, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("gap_start"), end.alias("gap_end"))


def _range_gaps(
    points: DataFrame, expected: DataFrame, keys: list[str], step_seconds: int, kinds: dict[str, str]
) -> DataFrame:
    """Empty, leading, interior and trailing gaps of ``points`` within their expected range.

    ``points`` has ``(*keys, open_time)``, already restricted to the range; ``expected`` has
    ``(*keys, range_start, range_end)``. Bounds come from a map-side combined min/max and interior
    gaps from chunked steps, so a single huge series is spread over many tasks.
    """
    step = step_seconds * MICROS
    bounds = points.groupBy(*keys).agg(
        F.min("open_time").alias("first"), F.max("open_time").alias("last")
    )
    first, last = F.col("first"), F.col("last")
    # At most two gaps lie at the edges of a range; all are read off one joined row.
    edges = F.array_compact(F.array(
        F.when(first.isNull() & (F.col("range_start") < F.col("range_end")), _gap(kinds["empty"], F.col("range_start"), F.col("range_end"))),
        F.when(first > F.col("range_start"), _gap(kinds["leading"], F.col("range_start"), first)),
        F.when(_shift(last, step) < F.col("range_end"), _gap(kinds["trailing"], _shift(last, step), F.col("range_end"))),
    ))
    outer = expected.join(bounds, keys, "left").select(*keys, F.inline(edges))
    steps = series_steps(points, keys, "open_time", _CHUNK_STEPS * step_seconds)
    interior = steps.filter(micros(F.col("current")) - micros(F.col("previous")) > F.lit(step))
    return outer.unionByName(
        interior.select(*keys, _gap(kinds["interior"], _shift(F.col("previous"), step), F.col("current")).alias("__gap"))
        .select(*keys, "__gap.*")
    )


def classify_gaps(bars: DataFrame, expected: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Source gaps per symbol; ``expected`` has (symbol, range_start, range_end), NULL if open.

    All points of a symbol count, as the series is what it is; symbols without any point are
    reported as a missing planned source.
    """
    kinds = {
        "empty": "unexplained_missing_planned_archive",
        "leading": "leading_source_gap",
        "interior": "interior_source_gap",
        "trailing": "trailing_source_gap",
    }
    return _range_gaps(bars.select("symbol", "open_time"), expected, ["symbol"], step_seconds, kinds)


def active_ranges(
    catalog: DataFrame, clip_start: Column, clip_end: Column, nested: bool = True
) -> DataFrame:
    """Active hours of every instrument, clipped to a window: (symbol, episode, start, end).

    Starts are floored to the hour, ends are the hour after the last trade; open episodes reach the
    end of the window. Without intervals the contract's own anchor and last trade are used.
    """
    if nested:
        source = exploded_intervals(catalog).select(
            "symbol",
            F.col("lifecycle_episode_id").alias("episode"),
            F.col("age_live_anchor_at").alias("__from"),
            F.col("last_trading_at").alias("__last"),
        )
    else:
        source = catalog.select(
            "symbol",
            F.concat("symbol", F.lit(":1")).alias("episode"),
            F.coalesce("eligibility_age_anchor_at", "first_observed_trade_at").alias("__from"),
            F.col("last_trading_at").alias("__last"),
        ).filter(F.col("__from").isNotNull())
    hour = 3600 * MICROS
    start = F.date_trunc("hour", F.col("__from"))
    end = F.coalesce(_shift(F.date_trunc("hour", F.col("__last")), hour), clip_end)
    return source.select(
        "symbol",
        "episode",
        F.greatest(start, clip_start).alias("range_start"),
        F.least(end, clip_end).alias("range_end"),
    ).filter("range_start < range_end")


def active_gaps(bars: DataFrame, ranges: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Gaps inside active lifecycle ranges; must be empty before a stage is accepted.

    The join is an equality on the symbol with the range as a residual; an instrument has a handful
    of ranges, so no bar is multiplied beyond the ranges that really hold it.
    """
    kinds = {
        "empty": "active_interval_empty",
        "leading": "leading_active_gap",
        "interior": "interior_active_gap",
        "trailing": "trailing_active_gap",
    }
    held = bars.select("symbol", "open_time").join(ranges, "symbol").filter(
        (F.col("open_time") >= F.col("range_start")) & (F.col("open_time") < F.col("range_end"))
    )
    return _range_gaps(
        held.select("symbol", "episode", "open_time"), ranges, ["symbol", "episode"],
        step_seconds, kinds,
    )


def active_between(ranges: DataFrame, periods: DataFrame) -> DataFrame:
    """Periods of a symbol during which it was active at any moment.

    ``periods`` has (symbol, period, period_start, period_end), half-open. The join is an equality
    on the symbol; overlap is a residual test on a handful of ranges.
    """
    overlap = (F.col("range_start") < F.col("period_end")) & (
        F.col("range_end") > F.col("period_start")
    )
    pairs = ranges.join(periods, "symbol").filter(overlap)
    return pairs.select("symbol", "period", "period_start", "period_end").distinct()


def active_months(ranges: DataFrame, first: Column, last: Column) -> DataFrame:
    """Months from ``first`` to ``last`` in which each instrument was active.

    Each range is clipped and exploded into its own months, so nothing is paired that does not
    overlap.
    """
    start = F.greatest(F.trunc(F.col("range_start"), "MM"), F.trunc(first, "MM"))
    # The range end is exclusive: the month of the last covered microsecond is the last one.
    final = F.least(
        F.trunc(F.timestamp_micros(micros(F.col("range_end")) - F.lit(1)), "MM"),
        F.trunc(last, "MM"),
    )
    months = F.when(start <= final, F.sequence(start, final, F.expr("INTERVAL 1 MONTH")))
    return (
        ranges.select("symbol", F.explode(months).alias("month_start"))
        .distinct()
        .withColumn("period", F.date_format("month_start", "yyyy-MM"))
    )


def missing_months(ranges: DataFrame, observed: DataFrame, first: Column, last: Column) -> DataFrame:
    """Active months without an observed file; ``observed`` has (symbol, period)."""
    wanted = active_months(ranges, first, last).select("symbol", "period")
    return wanted.join(observed.select("symbol", "period"), ["symbol", "period"], "left_anti")


def unordered_intervals(intervals: DataFrame) -> DataFrame:
    """Episodes followed by another although not terminated, or not terminated before it starts."""
    order = Window.partitionBy("symbol").orderBy(
        F.element_at(F.split("lifecycle_episode_id", ":"), -1).cast("bigint")
    )
    following = F.lead("age_live_anchor_at", 1).over(order)
    finding = (
        F.when(F.col("last_trading_at").isNull(), "not_terminated")
        .when(F.col("last_trading_at") >= F.col("__next"), "overlaps_next")
    )
    return (
        intervals.withColumn("__next", following)
        .filter(F.col("__next").isNotNull())
        .withColumn("finding", finding)
        .filter(F.col("finding").isNotNull())
        .select("symbol", "lifecycle_episode_id", "finding")
    )
