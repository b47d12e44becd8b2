"""Sessionise consecutive top-bucket bars into numbered episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.operators.series import (
    OWN,
    Grid,
    attach_carry,
    carry_in,
    chunk_window,
    follows_previous,
    in_chunks,
    own_rows,
)


def add_episodes(
    observations: DataFrame, grid: Grid = Grid(), flag: str = "is_hot"
) -> DataFrame:
    """A run of flagged bars, each one interval after the last, is one episode.

    Starts are decided in time chunks and their counts carried from chunk to chunk, so a series of
    any length is spread over many tasks; the carry evaluates the input a second time, for the flag
    only.
    """
    placed, w = in_chunks(observations, grid, back=1), chunk_window(grid)
    hot = F.coalesce(F.col(flag), F.lit(False))
    continued = F.coalesce(F.lag(flag, 1).over(w), F.lit(False)) & follows_previous(grid, w)
    started = placed.withColumn("is_episode_start", hot & ~continued)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordinal = F.count_if(F.col("is_episode_start")).over(running)
    starts = F.count_if(F.col(OWN) & F.col("is_episode_start"))
    carry = carry_in(started, grid, totals={"__starts_in": starts})
    own = own_rows(started).withColumn("__starts", ordinal)
    numbered = attach_carry(own, carry, grid).withColumn(
        "__ordinal", F.col("__starts") + F.col("__starts_in")
    )
    label = F.format_string("%s-HOT-%06d", F.col(grid.key), F.col("__ordinal"))
    return numbered.withColumn("episode_id", F.when(hot, label)).select(
        *observations.columns, "is_episode_start", "episode_id"
    )
