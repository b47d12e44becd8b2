"""The flagship plan: scope, eligibility, features, ranks, episodes and labels in one DAG."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.timefn import Split, classify_split
from tidepanel.operators.eligibility import apply_eligibility
from tidepanel.operators.episodes import add_episodes
from tidepanel.operators.features import (
    FeatureSpec,
    feature_columns,
    segment_carry,
    segmented,
    with_segment_features,
    with_structure_tags,
)
from tidepanel.operators.labels import (
    HORIZONS,
    PATH_HORIZONS,
    add_benchmark_relative,
    add_median_excess,
    label_columns,
    labels_from_futures,
    with_futures,
)
from tidepanel.operators.rank import add_cross_sectional_ranks
from tidepanel.operators.scope import filter_scope, semi_scope
from tidepanel.operators.series import Grid
from tidepanel.operators.splits import require_splits
from tidepanel.session import materialize


@dataclass(frozen=True)
class SliceSpec:
    """Parameters of the slice; defaults are those of 4-hour bars."""

    grid: Grid = Grid()
    features: FeatureSpec = field(default_factory=FeatureSpec)
    horizons: Mapping[str, int] = field(default_factory=lambda: dict(HORIZONS))
    path_horizons: Sequence[str] = PATH_HORIZONS
    splits: Sequence[Split] = tuple(fv.DEFAULT_SPLITS)
    stablecoins: Sequence[str] = tuple(fv.STABLECOIN_UNDERLYINGS)
    minimum_age_days: int = 30
    benchmark: str = fv.BENCHMARK_SYMBOL


def features_and_labels(eligible: DataFrame, spec: SliceSpec) -> DataFrame:
    """Features, tags and per-symbol labels from one shuffle by (symbol, chunk).

    Labels need later rows, features earlier ones; a halo on both sides lets them share the
    shuffle. A horizon is complete only inside one split, so rows outside the splits can stay in
    until the end without touching any label.
    """
    grid = spec.features.fit(spec.grid)
    ahead = max(spec.horizons.values())
    chunked = segmented(eligible, grid, spec.features.lookback, ahead)
    featured = with_segment_features(chunked, grid, spec.features)
    carry = segment_carry(featured, grid, spec.features)
    futures = with_futures(featured, grid, spec.splits, spec.horizons, spec.path_horizons)
    tagged = with_structure_tags(futures, carry, grid, spec.features)
    labelled = labels_from_futures(tagged, spec.horizons, spec.path_horizons)
    return labelled.select(
        *eligible.columns, *feature_columns(spec.features),
        *label_columns(spec.horizons, spec.path_horizons),
    )


@dataclass(frozen=True)
class PanelProfile:
    """What one narrow pass over a panel tells the guards."""

    row_count: int
    benchmark_repeats: int
    split_names: frozenset[str | None]


def profile_panel(bars: DataFrame, spec: SliceSpec) -> PanelProfile:
    """One job, one map-side combined aggregate over (symbol, open_time) alone."""
    per_time = (
        bars.select("symbol", "open_time").groupBy("open_time")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("symbol") == spec.benchmark).alias("b"))
        .agg(
            F.sum("n").alias("rows"),
            F.count_if(F.col("b") > 1).alias("repeats"),
            # At most one name per defined split, plus the mark for rows outside all of them.
            F.collect_set(
                F.coalesce(classify_split(F.col("open_time"), spec.splits), F.lit(""))
            ).alias("names"),
        )
    )
    found = per_time.first()
    return PanelProfile(
        found["rows"] or 0, found["repeats"], frozenset(name or None for name in found["names"])
    )


def observations_from_eligible(eligible: DataFrame, spec: SliceSpec = SliceSpec()) -> DataFrame:
    """Ranks, relative labels and episodes on top of an eligibility stage.

    Three shuffles of wide rows: by (symbol, chunk) for features and labels, by timestamp for
    ranks, benchmark and medians, by series for episode numbers. Rows outside every split are
    dropped last, after episodes were numbered; they carry no labels and whole timestamps fall
    away, so nothing else depends on when they go. The wide panel is stored before the cross-sections,
    which all read narrow columns of that one table, and again before episodes are numbered.
    """
    horizons = tuple(spec.horizons)
    panel = materialize(features_and_labels(eligible, spec), "panel")
    relative = add_benchmark_relative(add_cross_sectional_ranks(panel), spec.benchmark, horizons, panel)
    scored = materialize(add_median_excess(relative, horizons, panel), "scored")
    episodic = add_episodes(scored, spec.grid)
    return episodic.filter(classify_split(F.col("open_time"), spec.splits).isNotNull())


def build_slice(
    bars: DataFrame,
    contracts: DataFrame,
    spec: SliceSpec = SliceSpec(),
    allowed: Sequence[str] | None = None,
) -> DataFrame:
    """From completed bars and contract rows to labelled observations.

    Fail-closed checks (scope not empty, splits allowed, one benchmark row per timestamp, sound
    contracts) run first: one narrow job over the bars and one over the contracts.
    """
    scoped_contracts = filter_scope(contracts, spec.stablecoins)
    scoped = semi_scope(bars, scoped_contracts)
    profile = profile_panel(scoped, spec)
    if not profile.row_count:
        raise ValueError("no bars remain after instrument scope classification")
    require_splits(profile.split_names, allowed)
    if profile.benchmark_repeats:
        raise ValueError("the benchmark must have one row per timestamp")
    eligible = apply_eligibility(
        scoped, scoped_contracts, spec.minimum_age_days, benchmark=spec.benchmark
    )
    return observations_from_eligible(eligible, spec)


def analysis_window(observations: DataFrame, start: str, end: str) -> DataFrame:
    """Closed-range analysis filter."""
    bounds = [F.lit(t).cast("timestamp") for t in (start, end)]
    return observations.filter(F.col("open_time").between(*bounds))
