"""Cross-sectional ranks with average ties, score, deciles and medians per timestamp.

One plan at every size: ranks are taken over the distinct values of a timestamp, cut into
order-preserving buckets, in narrow rows, and joined back once. NaN counts as missing (NULL); both
infinities rank at the ends; -0.0 and 0.0 are one value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.session import materialize

SCORE_SOURCES = {
    "return_1d": "rs_1d_pct",
    "return_3d": "rs_3d_pct",
    "return_7d": "rs_7d_pct",
    "vol_exp_4h_raw": "vol_exp_4h_pct",
    "vol_exp_24h_raw": "vol_exp_24h_pct",
}
RANK_SOURCES = {**SCORE_SOURCES, "median_30d_daily_quote_volume": "liquidity_pct"}

# Buckets per factor e of the value; neighbouring values share a bucket only when within 0.1 %.
_BUCKETS_PER_E = 1024


def rankable() -> Column:
    """Rows that take part in a cross-section: eligible and not the benchmark."""
    return F.coalesce(F.col("is_eligible") & ~F.col("is_benchmark"), F.lit(False))


def present(value: Column) -> Column:
    """A value as it takes part in ranks and medians."""
    return F.when(~F.isnan(value.cast("double")), value)


def _bucket(value: Column) -> Column:
    """A coarse key that never decreases with the value."""
    # The logarithm of a finite double is below 710; infinities take the outermost buckets.
    size = F.floor(F.least(F.log(F.abs(value)), F.lit(800.0)) * _BUCKETS_PER_E) + F.lit(1_000_000)
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def ordered_counts(df: DataFrame, group: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct values of every group with multiplicity, rows below and group size.

    Ties are pre-aggregated on the map side, so a value shared by most rows is one row here; the
    distinct values are then split over (group, bucket) and stitched by bucket totals.
    """
    keys = list(group)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("ties"))
        .withColumn("__bucket", _bucket(F.col(value)))
    )
    per_bucket = counts.groupBy(*keys, "__bucket").agg(F.sum("ties").alias("__held"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket")
    offsets = per_bucket.select(
        *keys,
        "__bucket",
        (F.sum("__held").over(earlier) - F.col("__held")).alias("__offset"),
        F.sum("__held").over(Window.partitionBy(*keys)).alias("size"),
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value)
    return (
        counts.withColumn("__below", F.sum("ties").over(inside) - F.col("ties"))
        .join(offsets, [*keys, "__bucket"])
        .select(*keys, value, "ties", (F.col("__below") + F.col("__offset")).alias("below"), "size")
    )


def add_percentiles(
    df: DataFrame,
    sources: Mapping[str, str],
    mask: Column | None = None,
    group: str = "open_time",
) -> DataFrame:
    """Average-tie percentile rank of each source among masked, non-null rows of the group.

    A row's percentile is (rows below + (ties + 1) / 2) / size; rows outside the mask get NULL and
    do not count. Rows that agree in the group and all sources share one narrow row, which is ranked
    for all sources together and joined back to the wide rows once.
    """
    keyed = _keyed(df, sources, rankable() if mask is None else mask)
    return _join_back(keyed, _ranked_tuples(keyed, sources, group), list(sources.values()), len(sources), group)


def _value_names(count: int) -> list[str]:
    return [f"__v{i}" for i in range(count)]


def _keyed(df: DataFrame, sources: Mapping[str, str], mask: Column) -> DataFrame:
    """Rows with the values that take part in the ranks beside their own columns."""
    return df.withColumns(
        {v: F.when(mask, present(F.col(s))).cast("double") + F.lit(0.0) for s, v in zip(sources, _value_names(len(sources)), strict=True)}
    )


def _ranked_tuples(keyed: DataFrame, sources: Mapping[str, str], group: str) -> DataFrame:
    """Each distinct tuple of values of a group with its rows ``__n`` and the percentile of every value."""
    values = _value_names(len(sources))
    rows = keyed.groupBy(group, *values).agg(F.count(F.lit(1)).alias("__n"))
    cells = F.array(*[
        F.struct(F.lit(i).alias("__s"), F.col(v).alias("__x")) for i, v in enumerate(values)
    ])
    long = rows.select("*", F.explode(cells).alias("__c")).select(
        group, *values, "__n", "__c.__s", "__c.__x"
    ).where(F.col("__x").isNotNull())
    placed = ordered_counts(long, [group, "__s"], "__x", F.col("__n")).select(
        group, "__s", "__x", _average_place().alias("__pct")
    )
    return long.join(placed, [group, "__s", "__x"]).groupBy(group, *values).agg(
        F.max("__n").alias("__n"),
        *[F.max(F.when(F.col("__s") == i, F.col("__pct"))).alias(t) for i, t in enumerate(sources.values())],
    )


def _average_place() -> Column:
    return (F.col("below") + (F.col("ties") + 1) / 2) / F.col("size")


def _join_back(keyed: DataFrame, tuples: DataFrame, targets: list[str], count: int, group: str) -> DataFrame:
    """The wide rows with the columns of their tuple, in one join."""
    values = _value_names(count)
    renamed = {c: f"__r_{c}" for c in (group, *values)}
    right = tuples.select(group, *values, *targets).withColumnsRenamed(renamed)
    same = F.lit(True)
    for ours, theirs in renamed.items():
        same = same & keyed[ours].eqNullSafe(right[theirs])
    return keyed.drop(*targets).join(right, same, "left").drop(*values, *renamed.values())


def score_columns() -> dict[str, Column]:
    """Mean of the five component percentiles, present only when all five are."""
    total = None
    for name in SCORE_SOURCES.values():
        total = F.col(name) if total is None else total + F.col(name)
    return {"hot_score": total / len(SCORE_SOURCES)}


def decile(pct: Column, buckets: int = 10) -> Column:
    """ceil(pct * buckets) within 1..buckets. NULL must be tested first: least/greatest skip it."""
    bucket = F.greatest(F.lit(1), F.least(F.lit(buckets), F.ceil(pct * buckets)))
    return F.when(pct.isNotNull(), bucket.cast("int"))


def add_cross_sectional_ranks(df: DataFrame, group: str = "open_time") -> DataFrame:
    """Component percentiles, score, score percentile, decile and top-bucket flag.

    The score depends on the tuple of values alone, so it is formed and ranked on the narrow tuples, which
    are stored once; the wide rows are neither stored nor joined a second time.
    """
    keyed = _keyed(df, RANK_SOURCES, rankable())
    tuples = materialize(_ranked_tuples(keyed, RANK_SOURCES, group).withColumns(score_columns()), "ranked-tuples")
    placed = ordered_counts(tuples, [group], "hot_score", F.col("__n")).select(
        group, "hot_score", _average_place().alias("hot_score_pct")
    )
    scored = tuples.join(placed, [group, "hot_score"], "left").withColumn("hot_decile", decile(F.col("hot_score_pct")))
    targets = [*RANK_SOURCES.values(), "hot_score", "hot_score_pct", "hot_decile"]
    joined = _join_back(keyed, scored, targets, len(RANK_SOURCES), group)
    return joined.withColumn("is_hot", F.coalesce(F.col("hot_decile") == 10, F.lit(False)))


def top_decile(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_hot"))


def group_medians(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Exact median of every value column per group, without holding a group in one task.

    All columns are turned into rows and counted together: one pass over ``df``, whatever their number.
    A group without any value has no row.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("__s"), present(F.col(v)).cast("double").alias("__x")) for i, v in enumerate(values)])
    long = df.select(group, F.explode(cells).alias("__c")).select(group, "__c.__s", "__c.__x")
    placed = ordered_counts(long, [group, "__s"], "__x")
    low, high = F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2)
    last = F.col("below") + F.col("ties")
    middle = placed.where((F.col("below") <= high) & (low < last)).groupBy(group)

    def at(place: Column, i: int) -> Column:
        return F.max(F.when((F.col("__s") == i) & (F.col("below") <= place) & (place < last), F.col("__x")))

    return middle.agg(*[((at(low, i) + at(high, i)) / 2).alias(v) for i, v in enumerate(values)])
