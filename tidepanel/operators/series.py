"""Series windows that stay balanced when one key holds a large share of all rows.

A plain ``Window.partitionBy(symbol)`` puts a whole series into one task. Bars sit on a fixed time
grid, so a bounded look-back of k rows inside a gap-free run is also a bounded look-back of
k intervals. Series are therefore cut into time chunks; each chunk receives the rows it needs from
its neighbours (its halo), and one shuffle by ``(key, chunk)`` serves every window. What reaches
further back than any halo (segment numbers, last trigger, episode ordinals) is carried between
chunks through a small per-chunk summary.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidepanel.functions.timefn import MICROS, floor_micros, micros

CHUNK = "__chunk"
OWN = "__own"


@dataclass(frozen=True)
class Grid:
    """A bar grid: the series key, the time column, the bar interval and the chunk length in bars."""

    interval_seconds: int = 14_400
    key: str = "symbol"
    time: str = "open_time"
    chunk_bars: int = 4096

    @property
    def step_us(self) -> int:
        return self.interval_seconds * MICROS

    def with_chunk(self, chunk_bars: int) -> Grid:
        return Grid(self.interval_seconds, self.key, self.time, chunk_bars)


def chunk_id(grid: Grid) -> Column:
    span = grid.chunk_bars * grid.step_us
    return (floor_micros(micros(F.col(grid.time)), span) / F.lit(span)).cast("bigint")


def in_chunks(df: DataFrame, grid: Grid, back: int = 0, ahead: int = 0) -> DataFrame:
    """Assign rows to chunks, with copies for the halos of the neighbouring chunks.

    ``back``/``ahead`` are the halo widths in bars. A row is copied at most once per side, so the
    added volume is (back + ahead) / chunk_bars of the input.
    """
    if max(back, ahead) > grid.chunk_bars:
        raise ValueError("halo is wider than a chunk; use longer chunks")
    span = grid.chunk_bars * grid.step_us
    own = chunk_id(grid)
    if not back and not ahead:
        return df.withColumns({CHUNK: own, OWN: F.lit(True)})
    offset = F.pmod(micros(F.col(grid.time)), F.lit(span))
    copies = [own]
    if back:
        copies.append(F.when(offset >= F.lit(span - back * grid.step_us), own + 1))
    if ahead:
        copies.append(F.when(offset < F.lit(ahead * grid.step_us), own - 1))
    # Never empty, hence the outer form: it spares the guard Spark adds below a plain explode.
    spread = df.withColumn(CHUNK, F.explode_outer(F.array_compact(F.array(*copies))))
    return spread.withColumn(OWN, F.col(CHUNK) == chunk_id(grid))


def chunk_window(grid: Grid) -> WindowSpec:
    return Window.partitionBy(grid.key, CHUNK).orderBy(grid.time)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OWN)).drop(OWN)


def follows_previous(grid: Grid, window: WindowSpec) -> Column:
    """The previous row of the series lies exactly one interval earlier (needs a halo of one bar)."""
    gap = micros(F.col(grid.time)) - micros(F.lag(grid.time, 1).over(window))
    return F.coalesce(gap == F.lit(grid.step_us), F.lit(False))


Recent = tuple[int, dict[str, Column], Callable[[Column], Column]]


def carry_in(
    chunked: DataFrame,
    grid: Grid,
    totals: dict[str, Column],
    latest: dict[str, Column] | None = None,
    recent: dict[str, Recent] | None = None,
) -> DataFrame:
    """What each chunk inherits from the earlier chunks of the same key.

    ``totals``/``latest`` map output names to aggregates over one chunk: sums and last non-null
    values over all earlier chunks. ``recent`` folds the aggregates of the last few chunks with a
    function over their array. The per-chunk summary is smaller than the input by the chunk
    length, so its window is small even for a key that holds most rows.
    """
    latest, recent = latest or {}, recent or {}
    folded = {n: F.struct(*[e.alias(k) for k, e in parts.items()]) for n, (_, parts, _) in recent.items()}
    summary = chunked.groupBy(grid.key, CHUNK).agg(
        *[expr.alias(name) for name, expr in {**totals, **latest, **folded}.items()]
    )
    order = Window.partitionBy(grid.key).orderBy(CHUNK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: F.coalesce(F.sum(n).over(before), F.lit(0)) for n in totals}
    carried |= {n: F.last(n, ignorenulls=True).over(before) for n in latest}
    for name, (depth, _, fold) in recent.items():
        carried[name] = fold(F.collect_list(name).over(order.rowsBetween(-depth, -1)))
    return summary.select(grid.key, CHUNK, *[expr.alias(n) for n, expr in carried.items()])


def attach_carry(chunked: DataFrame, carry: DataFrame, grid: Grid) -> DataFrame:
    """Join the carry back; the chunked side keeps its (key, chunk) partitioning."""
    return chunked.join(carry, [grid.key, CHUNK], "left")


def series_steps(df: DataFrame, keys: list[str], time: str, chunk_seconds: int) -> DataFrame:
    """Consecutive distinct instants of every series as ``(keys, previous, current)``.

    Pairs inside a time chunk come from a chunk-local window, pairs across chunks from the chunk
    bounds; no task sees a whole series.
    """
    span = chunk_seconds * MICROS
    chunk = (floor_micros(micros(F.col(time)), span) / F.lit(span)).cast("bigint")
    points = (
        df.select(*keys, F.col(time).alias("current"), chunk.alias(CHUNK))
        .filter(F.col("current").isNotNull())
        .groupBy(*keys, CHUNK, "current")
        .agg(F.lit(1).alias("__one"))
    )
    inside = points.withColumn(
        "previous", F.lag("current", 1).over(Window.partitionBy(*keys, CHUNK).orderBy("current"))
    ).filter(F.col("previous").isNotNull())
    bounds = points.groupBy(*keys, CHUNK).agg(
        F.min("current").alias("current"), F.max("current").alias("__last")
    )
    across = bounds.withColumn(
        "previous", F.lag("__last", 1).over(Window.partitionBy(*keys).orderBy(CHUNK))
    ).filter(F.col("previous").isNotNull())
    columns = [*keys, "previous", "current"]
    return inside.select(*columns).unionByName(across.select(*columns))
