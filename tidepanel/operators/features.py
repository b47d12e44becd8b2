"""Gap-safe, past-only features of a bar panel.

All windows live inside one continuity segment (a run of bars exactly one interval apart). One
shuffle by (symbol, chunk) feeds every feature; see ``series`` for the chunk scheme.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidepanel.operators.series import (
    CHUNK,
    OWN,
    Grid,
    attach_carry,
    carry_in,
    chunk_window,
    follows_previous,
    in_chunks,
    own_rows,
)
from tidepanel.functions.timefn import micros
from tidepanel.schemas import require_columns

SEGMENT = "__segment"
OWN_BREAKS = "__own_breaks"
BREAK = "__break"

# exp(600) leaves ample room below the largest double for price-sized factors.
_MAX_EXPONENT = 600.0
# exp(-745) is the smallest positive double: older contributions to an average are exactly zero.
_VANISHED = 745.0


@dataclass(frozen=True)
class FeatureSpec:
    """Window lengths in bars."""

    returns: dict[str, int] = field(default_factory=lambda: {"1d": 6, "3d": 18, "7d": 42})
    volume_base: int = 30
    sum_bars: int = 6
    sum_base: int = 20
    liquidity: int = 180
    high_bars: int = 120
    atr_period: int = 14
    approaching: tuple[float, float] = (0.0, 0.75)
    early_bars: int = 3
    extended_atr: float = 2.0

    @property
    def decay(self) -> float:
        """Loss of weight per bar of the recursive average, as an exponent."""
        return math.log(self.atr_period / (self.atr_period - 1)) if self.atr_period > 1 else math.inf

    @property
    def lookback(self) -> int:
        """Bars of history needed before a chunk so that every bounded window is exact."""
        return max(
            *self.returns.values(),
            self.volume_base + 1,
            self.sum_bars + self.sum_base + 1,
            self.sum_bars + self.liquidity,
            self.high_bars + 2,
            self.atr_period + 1,
        )

    def fit(self, grid: Grid) -> Grid:
        """Chunks long enough for every look-back; how fast the average forgets does not matter."""
        return grid.with_chunk(max(grid.chunk_bars, self.lookback))

    @property
    def block_bars(self) -> int:
        """Bars over which powers of the average's decay stay inside the range of a double."""
        return max(1, int(_MAX_EXPONENT / self.decay)) if self.atr_period > 1 else 1

    def carried_chunks(self, grid: Grid) -> int:
        """Earlier chunks that can still weigh anything in the recursive average."""
        return 1 + math.ceil(_VANISHED / (grid.chunk_bars * self.decay))


def segmented(bars: DataFrame, grid: Grid, back: int, ahead: int = 0) -> DataFrame:
    """Chunked bars with a chunk-local segment id and the number of breaks among own rows so far."""
    require_columns(bars, [grid.key, grid.time], "bars")
    w = chunk_window(grid)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    halo = in_chunks(bars, grid, max(back, 1), ahead)
    marked = halo.withColumn(BREAK, (~follows_previous(grid, w)).cast("int"))
    return marked.withColumns(
        {
            SEGMENT: F.sum(BREAK).over(running),
            OWN_BREAKS: F.sum(F.when(F.col(OWN), F.col(BREAK)).otherwise(0)).over(running),
        }
    )


def _segment_window(grid: Grid) -> WindowSpec:
    return Window.partitionBy(grid.key, CHUNK, SEGMENT).orderBy(grid.time)


def _full(values: Column, n: int, frame: WindowSpec, how) -> Column:
    """An aggregate over a frame that counts only when all n values are present."""
    return F.when(F.count(values).over(frame) == n, how(values).over(frame))


def _median(values: Column, n: int, frame: WindowSpec) -> Column:
    """Median of exactly n values in the frame, else NULL.

    Sorting the collected frame is several times faster here than ``percentile``, which builds a
    hash map per row; NULLs are not collected, so the list size is the completeness test.
    """
    ordered = F.sort_array(F.collect_list(values).over(frame))
    upper = F.get(ordered, F.lit(n // 2))
    middle = upper if n % 2 else (F.get(ordered, F.lit(n // 2 - 1)) + upper) / 2
    return F.when(F.size(ordered) == n, middle)


def _positive(col: Column) -> Column:
    return F.when(col > 0, col)


def with_segment_features(
    chunked: DataFrame, grid: Grid, spec: FeatureSpec
) -> DataFrame:
    """Bounded-window features of segmented bars (all halo rows still present)."""
    w = _segment_window(grid)
    close, high, low, volume = (F.col(c) for c in ("close", "high", "low", "quote_volume"))
    before = F.lag("close", 1).over(w)
    first = {
        f"return_{label}": close / F.nullif(F.lag("close", k).over(w), F.lit(0.0)) - 1
        for label, k in spec.returns.items()
    }
    first |= {
        "vol_exp_4h_baseline": _median(
            volume, spec.volume_base, w.rowsBetween(-spec.volume_base, -1)
        ),
        "current_24h_quote_volume": _full(
            volume, spec.sum_bars, w.rowsBetween(1 - spec.sum_bars, 0), F.sum
        ),
        # Only rows with a full frame of non-null highs count; running counts keep the test O(1).
        "__highs": F.count(high).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "__prior_high": F.max(high).over(w.rowsBetween(-spec.high_bars, -1)),
        "true_range": F.greatest(high - low, F.abs(high - before), F.abs(low - before)),
        "__rn": F.row_number().over(w),
    }
    daily = F.col("current_24h_quote_volume")
    highs_in_frame = F.lag("__highs", 1).over(w) - F.coalesce(
        F.lag("__highs", spec.high_bars + 1).over(w), F.lit(0)
    )
    second = {
        "vol_exp_4h_raw": volume / _positive(F.col("vol_exp_4h_baseline")),
        "vol_exp_24h_baseline": _median(daily, spec.sum_base, w.rowsBetween(-spec.sum_base, -1)),
        "median_30d_daily_quote_volume": _median(
            daily, spec.liquidity, w.rowsBetween(1 - spec.liquidity, 0)
        ),
        "prev_20d_high": F.when(highs_in_frame == spec.high_bars, F.col("__prior_high")),
    }
    third = {
        "vol_exp_24h_raw": daily / _positive(F.col("vol_exp_24h_baseline")),
        "is_fresh_breakout": F.coalesce(
            (close > F.col("prev_20d_high")) & (before <= F.lag("prev_20d_high", 1).over(w)),
            F.lit(False),
        ),
    }
    featured = chunked.withColumns(first).withColumns(second)
    if spec.atr_period == 1 or grid.chunk_bars + spec.lookback <= spec.block_bars:
        featured = featured.withColumns(_average_parts(spec.atr_period, w))
    else:
        featured = _blockwise_average_parts(featured, grid, spec)
    return featured.withColumns(third).drop("__highs", "__prior_high", "__rn")


def _average_parts(period: int, w: WindowSpec) -> dict[str, Column]:
    """Running sums from which the Wilder average of a chunk is put together.

    With q = (p-1)/p the recursion seeded by the mean of the first p values equals
    q^i * sum_j(TR_j / p * q^-max(j, p)) for a segment whose start is visible (``__avg_local``).
    For a segment running in from an earlier chunk it equals q^k * average_before + the same sum
    over own bars only (``__avg_own``), k counting own bars. All terms are positive, so nothing
    cancels. Used where a chunk is short enough to keep every power inside the range of a double.
    """
    tr, rn = F.col("true_range"), F.col("__rn")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if period == 1:
        return {"__avg_local": tr, "__avg_own": tr, "__k": F.lit(0)}
    q = F.lit((period - 1) / period)
    seeded = tr / period * F.pow(q, -F.greatest(rn, F.lit(period)))
    plain = F.when(F.col(OWN), tr / period * F.pow(q, -rn)).otherwise(0.0)
    return {
        "__avg_local": F.when(rn >= period, F.pow(q, rn) * F.sum(seeded).over(running)),
        "__avg_own": F.pow(q, rn) * F.sum(plain).over(running),
        "__k": F.count_if(F.col(OWN)).over(running),
    }


def _blockwise_average_parts(df: DataFrame, grid: Grid, spec: FeatureSpec) -> DataFrame:
    """The columns of ``_average_parts`` where q^-(bars of a chunk) is no double.

    A block of bars maps the average before it by x -> q^bars * x + (its rescaled sum). Inside a block sums are
    rescaled by its own start; the maps of the blocks before are composed at their last bars. q^block_bars is
    e^-600, so what lies two whole blocks back is below the smallest double and two maps are the whole chain.
    """
    period, size = spec.atr_period, spec.block_bars
    w = _segment_window(grid)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(grid.key, CHUNK, SEGMENT, "__block").orderBy(grid.time).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    q, rn, i = F.lit((period - 1) / period), F.col("__rn"), F.col("__in_block")
    share = F.col("true_range") / period
    kinds = ("__avg_local", "__avg_own")

    def of(mark: str, make) -> dict[str, Column]:
        return {f"{kind}_{mark}": make(kind) for kind in kinds}

    def at_end(col: Column) -> Column:
        return F.last(F.when(i == size, col), ignorenulls=True).over(earlier)

    df = df.withColumns(
        {
            "__block": F.floor((rn - 1) / size),
            "__in_block": (rn - 1) % size + 1,
            "__avg_local_term": F.when(rn == period, F.sum(share).over(running)).when(rn > period, share),
            "__avg_own_term": F.when(F.col(OWN), share).otherwise(0.0),
            "__k": F.count_if(F.col(OWN)).over(running),
        }
    )
    df = df.withColumns(
        of("sum", lambda kind: F.coalesce(F.pow(q, i) * F.sum(F.col(f"{kind}_term") * F.pow(q, -i)).over(inside), F.lit(0.0)))
    )
    df = df.withColumns(of("last", lambda kind: F.coalesce(at_end(F.col(f"{kind}_sum")), F.lit(0.0))))
    whole = F.pow(q, F.lit(size))
    df = df.withColumns(
        of("before", lambda kind: F.coalesce(at_end(F.col(f"{kind}_sum") + whole * F.col(f"{kind}_last")), F.lit(0.0)))
    )
    known = {kind: F.count(f"{kind}_term").over(running) > 0 for kind in kinds}
    df = df.withColumns(
        {kind: F.when(known[kind], F.col(f"{kind}_sum") + F.pow(q, i) * F.col(f"{kind}_before")) for kind in kinds}
    )
    marks = [f"{kind}_{mark}" for kind in kinds for mark in ("term", "sum", "last", "before")]
    return df.drop("__block", "__in_block", *marks)


def _average(period: int) -> Column:
    """The Wilder average of own bars once the carry is joined in."""
    if period == 1:
        return F.col("__avg_local")
    decayed = F.pow(F.lit((period - 1) / period), F.col("__k")) * F.col("__average_in")
    runs_in = (F.col(OWN_BREAKS) == 0) & F.col("__average_in").isNotNull()
    return F.when(runs_in, decayed + F.col("__avg_own")).otherwise(F.col("__avg_local"))


def segment_carry(featured: DataFrame, grid: Grid, spec: FeatureSpec) -> DataFrame:
    """Segment count, segment start, last breakout and average of everything before a chunk.

    The average is a linear recurrence over chunks. A segment that runs through a chunk multiplies
    it by q^bars, so only the few chunks that still weigh more than zero are folded.
    """
    own = F.col(OWN)
    broke = own & (F.col(BREAK) == 1)
    fired = own & F.col("is_fresh_breakout")
    at = F.when(own, F.col(grid.time))
    carry = carry_in(
        featured,
        grid,
        totals={"__breaks_in": F.sum(F.when(own, F.col(BREAK)).otherwise(0))},
        latest={
            "__start_in": F.max(F.when(broke, F.col(grid.time))),
            "__trigger_in": F.max(F.when(fired, F.col(grid.time))),
            "__level_in": F.max_by("prev_20d_high", F.when(fired, F.col(grid.time))),
        },
        recent={
            "__average_in": (
                spec.carried_chunks(grid),
                {
                    "started": F.max(broke),
                    "local": F.max_by("__avg_local", at),
                    "own": F.max_by("__avg_own", at),
                    "bars": F.max("__k"),
                },
                lambda chunks: _fold_average(chunks, spec.atr_period),
            )
        },
    )
    return carry


def _fold_average(chunks: Column, period: int) -> Column:
    q = F.lit((period - 1) / period if period > 1 else 0.0)
    return F.aggregate(
        chunks,
        F.lit(None).cast("double"),
        lambda before, c: F.when(c["started"] | before.isNull(), c["local"]).otherwise(
            F.pow(q, c["bars"]) * before + c["own"]
        ),
    )


def add_continuity_segment(
    bars: DataFrame, grid: Grid = Grid()
) -> DataFrame:
    """Number the gap-free runs of every series: 1 for the first, plus 1 after every gap."""
    chunked = segmented(bars, grid, 1)
    carry = carry_in(
        chunked, grid,
        totals={"__breaks_in": F.sum(F.when(F.col(OWN), F.col(BREAK)).otherwise(0))}, latest={},
    )
    numbered = attach_carry(own_rows(chunked), carry, grid).withColumn(
        "continuity_segment", F.col(OWN_BREAKS) + F.col("__breaks_in")
    )
    return numbered.select(*bars.columns, "continuity_segment")


def with_structure_tags(
    featured: DataFrame, carry: DataFrame, grid: Grid, spec: FeatureSpec
) -> DataFrame:
    """Average true range, breakout level, bars since breakout and stage (own rows only).

    The last trigger of a segment is found in the chunk or, failing that, in the carry; a carried
    trigger counts only if it is not older than the start of the running segment. Inside a segment
    bars are one interval apart, so elapsed time is a bar count.
    """
    w = _segment_window(grid).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fired = F.col("is_fresh_breakout")
    local = featured.withColumns(
        {
            "__trigger": F.last(F.when(fired, F.col(grid.time)), ignorenulls=True).over(w),
            "__level": F.last(F.when(fired, F.col("prev_20d_high")), ignorenulls=True).over(w),
        }
    )
    joined = attach_carry(own_rows(local), carry, grid)
    continues = (
        (F.col(OWN_BREAKS) == 0)
        & F.col("__trigger").isNull()
        & (F.col("__trigger_in") >= F.col("__start_in"))
    )
    settled = joined.withColumns(
        {
            "continuity_segment": F.col(OWN_BREAKS) + F.col("__breaks_in"),
            "__trigger": F.when(continues, F.col("__trigger_in")).otherwise(F.col("__trigger")),
            "breakout_level": F.when(continues, F.col("__level_in")).otherwise(F.col("__level")),
            "atr_14": _average(spec.atr_period),
        }
    )
    elapsed = (micros(F.col(grid.time)) - micros(F.col("__trigger"))) / F.lit(grid.step_us)
    above = (F.col("close") - F.col("breakout_level")) / _positive(F.col("atr_14"))
    distance = (F.col("prev_20d_high") - F.col("close")) / _positive(F.col("atr_14"))
    near = F.col("distance_to_20d_high_atr").between(*spec.approaching)
    tagged = settled.withColumns(
        {"bars_since_breakout": elapsed.cast("bigint"), "distance_to_20d_high_atr": distance}
    )
    early = F.col("bars_since_breakout").between(1, spec.early_bars) & (above <= spec.extended_atr)
    extended = F.col("breakout_level").isNotNull() & (above > spec.extended_atr)
    stage = (
        F.when(F.col("is_fresh_breakout"), "TRIGGERED")
        .when(early, "EARLY_TREND")
        .when(extended, "EXTENDED")
        .when(near, "APPROACHING")
        .otherwise("OTHER")
    )
    return tagged.withColumn("stage", stage).drop(
        "__trigger", "__level", "__trigger_in", "__level_in", "__start_in", "__breaks_in",
        "__average_in", "__avg_local", "__avg_own", "__k",
    )


WINDOW_COLUMNS = [
    "vol_exp_4h_baseline", "vol_exp_4h_raw", "current_24h_quote_volume", "vol_exp_24h_baseline",
    "vol_exp_24h_raw", "median_30d_daily_quote_volume", "prev_20d_high", "true_range",
    "is_fresh_breakout",
]
CARRIED_COLUMNS = [
    "atr_14", "distance_to_20d_high_atr", "continuity_segment", "breakout_level",
    "bars_since_breakout", "stage",
]


def feature_columns(spec: FeatureSpec) -> list[str]:
    return [f"return_{label}" for label in spec.returns] + WINDOW_COLUMNS + CARRIED_COLUMNS


def add_window_features(
    bars: DataFrame, spec: FeatureSpec = FeatureSpec(), grid: Grid = Grid()
) -> DataFrame:
    """Features that need bounded history only; unused ones are pruned by Catalyst."""
    grid = spec.fit(grid)
    featured = with_segment_features(segmented(bars, grid, spec.lookback), grid, spec)
    returns = [f"return_{label}" for label in spec.returns]
    return own_rows(featured).select(*bars.columns, *returns, *WINDOW_COLUMNS)


def add_time_series_features(
    bars: DataFrame, spec: FeatureSpec = FeatureSpec(), grid: Grid = Grid()
) -> DataFrame:
    """All features and structure tags of a panel."""
    grid = spec.fit(grid)
    featured = with_segment_features(segmented(bars, grid, spec.lookback), grid, spec)
    tagged = with_structure_tags(featured, segment_carry(featured, grid, spec), grid, spec)
    return tagged.select(*bars.columns, *feature_columns(spec))
