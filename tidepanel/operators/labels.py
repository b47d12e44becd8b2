"""Forward-looking outcome labels that never cross a split or a gap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.timefn import Split, horizon_in_split, micros
from tidepanel.operators.rank import group_medians, rankable
from tidepanel.operators.series import Grid, chunk_window, in_chunks, own_rows
from tidepanel.operators.splits import guard_splits

HORIZONS = {"1d": 6, "3d": 18, "7d": 42}
PATH_HORIZONS = ("3d", "7d")


def barrier(
    highs: Column, lows: Column, close: Column, atr: Column, bars: int,
    upper_atr: float = 2.0, lower_atr: float = 1.0,
) -> Column:
    """First barrier hit among the next bars: success, failure, ambiguous (same bar) or censored.

    ``highs``/``lows`` list the following bars in order and may be longer than this horizon.
    """
    upper, lower = close + F.lit(upper_atr) * atr, close - F.lit(lower_atr) * atr

    def first_hit(values: Column, hit) -> Column:
        return F.array_position(F.transform(F.slice(values, 1, bars), hit), F.lit(True))

    up = first_hit(highs, lambda h: h >= upper)
    down = first_hit(lows, lambda v: v <= lower)
    return (
        F.when((up == 0) & (down == 0), "censored")
        .when(up == down, "ambiguous")
        .when((down == 0) | ((up > 0) & (up < down)), "success")
        .otherwise("failure")
    )


def with_futures(
    chunked: DataFrame, grid: Grid, splits: Sequence[Split],
    horizons: Mapping[str, int] = HORIZONS, path_horizons: Sequence[str] = PATH_HORIZONS,
) -> DataFrame:
    """What lies ahead of each bar: completeness, closes, extremes and the path.

    Windows run over the series, not the segment: a horizon is complete when the bar k rows ahead
    lies exactly k intervals ahead and in the same split. The forward halo must cover the longest
    horizon.
    """
    w = chunk_window(grid)
    now = F.col(grid.time)
    ahead = {}
    for label, bars in horizons.items():
        endpoint = F.lead(grid.time, bars).over(w)
        on_time = micros(endpoint) - micros(now) == F.lit(grid.step_us * bars)
        ahead[f"__complete_{label}"] = F.coalesce(
            on_time & horizon_in_split(now, endpoint, splits), F.lit(False)
        )
        ahead[f"__close_{label}"] = F.lead("close", bars).over(w)
    for label in path_horizons:
        frame = w.rowsBetween(1, horizons[label])
        ahead[f"__top_{label}"] = F.max("high").over(frame)
        ahead[f"__bottom_{label}"] = F.min("low").over(frame)
    if path_horizons:
        longest = w.rowsBetween(1, max(horizons[p] for p in path_horizons))
        # A missing high or low never hits a barrier but keeps its place in the list.
        never_high, never_low = F.lit(float("-inf")), F.lit(float("inf"))
        ahead["__highs"] = F.collect_list(F.coalesce("high", never_high)).over(longest)
        ahead["__lows"] = F.collect_list(F.coalesce("low", never_low)).over(longest)
    return chunked.withColumns(ahead)


def labels_from_futures(
    df: DataFrame, horizons: Mapping[str, int] = HORIZONS,
    path_horizons: Sequence[str] = PATH_HORIZONS,
) -> DataFrame:
    """Labels from the columns of ``with_futures``; barriers also need ``atr_14``."""
    close = F.col("close")
    price = F.nullif(close, F.lit(0.0))
    labels = {}
    for label, bars in horizons.items():
        done = F.col(f"__complete_{label}")
        labels[f"fwd_return_{label}"] = F.when(done, F.col(f"__close_{label}") / price - 1)
        labels[f"future_bar_count_{label}"] = F.when(done, F.lit(bars)).otherwise(0)
        if label in path_horizons:
            labels[f"mfe_{label}"] = F.when(done, F.col(f"__top_{label}") / price - 1)
            labels[f"mae_{label}"] = F.when(done, F.col(f"__bottom_{label}") / price - 1)
            path = (F.col("__highs"), F.col("__lows"), close, F.col("atr_14"), bars)
            labels[f"barrier_{label}"] = F.when(done & (F.col("atr_14") > 0), barrier(*path))
    helpers = [f"__{part}_{h}" for part in ("complete", "close", "top", "bottom") for h in horizons]
    return df.withColumns(labels).drop("__highs", "__lows", *helpers)


def label_columns(
    horizons: Mapping[str, int] = HORIZONS, path_horizons: Sequence[str] = PATH_HORIZONS
) -> list[str]:
    names = []
    for label in horizons:
        names += [f"fwd_return_{label}", f"future_bar_count_{label}"]
        if label in path_horizons:
            names += [f"mfe_{label}", f"mae_{label}", f"barrier_{label}"]
    return names


def add_symbol_labels(
    observations: DataFrame, splits: Sequence[Split], grid: Grid = Grid(),
    horizons: Mapping[str, int] = HORIZONS, path_horizons: Sequence[str] = PATH_HORIZONS,
) -> DataFrame:
    """Forward returns, bar counts, excursions and barrier labels (one shuffle)."""
    chunked = in_chunks(observations, grid, ahead=max(horizons.values()))
    futures = own_rows(with_futures(chunked, grid, splits, horizons, path_horizons))
    labelled = labels_from_futures(futures, horizons, path_horizons)
    return labelled.select(*observations.columns, *label_columns(horizons, path_horizons))


def duplicate_benchmarks(df: DataFrame, benchmark: str = fv.BENCHMARK_SYMBOL) -> DataFrame:
    """Timestamps with more than one benchmark row; must be empty."""
    rows = df.filter(F.col("symbol") == benchmark).groupBy("open_time")
    return rows.agg(F.count(F.lit(1)).alias("benchmark_rows")).filter("benchmark_rows > 1")


def add_benchmark_relative(
    df: DataFrame, benchmark: str = fv.BENCHMARK_SYMBOL, horizons: Sequence[str] = tuple(HORIZONS),
    panel: DataFrame | None = None,
) -> DataFrame:
    """Forward returns minus the benchmark's at the same timestamp.

    Joins the benchmark rows, one per timestamp, which AQE can broadcast or skew-split. ``panel`` holds the
    same rows in stored form, where ``df`` is a plan that had better not be run twice.
    """
    rows = (df if panel is None else panel).filter(F.col("symbol") == benchmark).groupBy("open_time").agg(
        *[F.max(f"fwd_return_{h}").alias(f"btc_fwd_return_{h}") for h in horizons]
    )
    with_benchmark = df.join(rows, "open_time", "left")
    return with_benchmark.withColumns(
        {
            f"btc_relative_return_{h}": F.col(f"fwd_return_{h}") - F.col(f"btc_fwd_return_{h}")
            for h in horizons
        }
    )


def add_median_excess(
    df: DataFrame, horizons: Sequence[str] = tuple(HORIZONS), panel: DataFrame | None = None
) -> DataFrame:
    """Forward return minus the median of rankable rows at the same timestamp, for all rows.

    ``panel`` as in ``add_benchmark_relative``.
    """
    names = [f"fwd_return_{h}" for h in horizons]
    medians = group_medians((df if panel is None else panel).filter(rankable()), "open_time", names)
    renamed = medians.select("open_time", *[F.col(n).alias(f"__median_{n}") for n in names])
    joined = df.join(renamed, "open_time", "left")
    return joined.withColumns(
        {
            f"cross_sectional_excess_return_{h}": F.col(f"fwd_return_{h}")
            - F.col(f"__median_fwd_return_{h}")
            for h in horizons
        }
    ).drop(*[f"__median_{n}" for n in names])


def add_outcome_labels(
    observations: DataFrame, splits: Sequence[Split] = tuple(fv.DEFAULT_SPLITS),
    allowed: Sequence[str] | None = None, grid: Grid = Grid(),
    horizons: Mapping[str, int] = HORIZONS, path_horizons: Sequence[str] = PATH_HORIZONS,
    benchmark: str = fv.BENCHMARK_SYMBOL, strict: bool = True,
) -> DataFrame:
    """All outcome labels. ``strict`` runs the split and benchmark guards first."""
    if strict:
        guard_splits(observations, splits, allowed)
        if not duplicate_benchmarks(observations, benchmark).isEmpty():
            raise ValueError("the benchmark must have one row per timestamp")
    labelled = add_symbol_labels(observations, splits, grid, horizons, path_horizons)
    relative = add_benchmark_relative(labelled, benchmark, tuple(horizons))
    return add_median_excess(relative, tuple(horizons))
