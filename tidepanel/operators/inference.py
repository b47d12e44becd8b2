"""Outcome summaries that respect dependence: block bootstrap, baselines by stratum, ordered plateaus.

Overlapping windows make neighbouring outcomes depend on each other, so errors are clustered by time. Nothing
here copies observations: they are reduced to sums by (group, time) once, and all replicates work on those.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_RANGE = 1 << 32


def poisson_thresholds(rate: float) -> list[int]:
    """Upper ends of 0, 1, 2, ... events on a scale of 2**32, as far as they can be told apart."""
    total, term, ends = 0.0, math.exp(-rate), []
    for k in range(1, 40):
        total += term
        ends.append(math.floor(total * _RANGE))
        if ends[-1] >= _RANGE - 1 or (len(ends) > 1 and ends[-1] == ends[-2]):
            break
        term *= rate / k
    return ends


def block_starts(replicate: Column, index: Column, rate: float, seed: str) -> Column:
    """How many blocks of a replicate start at a time: a Poisson draw from a hash, the same on every machine."""
    text = F.concat_ws("/", F.lit(seed), replicate.cast("string"), index.cast("string"))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    count = F.lit(0)
    for end in poisson_thresholds(rate):
        count = count + (draw >= end).cast("int")
    return count


def block_bootstrap(
    outcomes: DataFrame, groups: Sequence[str], value: str, index: str, length: int = 3, replicates: int = 200,
    level: float = 0.95, seed: str = "block",
) -> DataFrame:
    """Mean of ``value`` by group with a moving-block bootstrap interval: n, mean, low, high.

    ``index`` numbers the times. In a replicate each time starts Poisson(1/length) blocks of ``length`` times, and an
    observation weighs as many as cover its time: moving blocks as weights, with no resampled rows. A replicate in
    which a group gets no weight is left out of that group's interval. Bounds are order statistics, not interpolated.
    """
    known = outcomes.filter(F.col(value).isNotNull() & F.col(index).isNotNull())
    sums = known.groupBy(*groups, index).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    times = known.select(index).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weight = sum(
        (block_starts(F.col("replicate"), F.col(index) - j, 1.0 / length, seed) for j in range(1, length)),
        block_starts(F.col("replicate"), F.col(index), 1.0 / length, seed),
    )
    weighted = sums.join(times.withColumn("w", weight).filter("w > 0"), index)
    means = weighted.groupBy(*groups, "replicate").agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum(F.col("w") * F.col("n")).alias("n"))
    ordered = means.groupBy(*groups).agg(F.array_sort(F.collect_list(F.col("s") / F.col("n"))).alias("m"))  # one per replicate
    tail = (1 - level) / 2
    at = lambda p: F.element_at("m", F.greatest(F.ceil(F.size("m") * F.lit(p)).cast("int"), F.lit(1)))
    bounds = ordered.select(*groups, at(tail).alias("low"), at(1 - tail).alias("high"))
    whole = sums.groupBy(*groups).agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return whole.join(bounds, list(groups), "left")


def plateau(means: DataFrame, order: str, mean: str, weight: str, steps: int = 10) -> DataFrame:
    """Add ``fitted``: the closest never-falling sequence of means (adjacent violators pooled, by weight).

    ``means`` has one row for each of at most ``steps`` ranks; value i of the fit is the largest, over starts up to i, of
    the least mean of the ranks from there to any end at or after i.
    """
    entry = F.struct(F.col(order).cast("int").alias("i"), F.col(mean).alias("m"), F.col(weight).cast("double").alias("w"))
    spans = (
        means.agg(F.collect_list(entry).alias("all"))  # one row, ``steps`` entries
        .select("all", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i"))
        .select("all", "i", F.explode(F.sequence(F.lit(1), F.col("i"))).alias("a"))
        .select("all", "i", "a", F.explode(F.sequence("i", F.lit(steps))).alias("b"))
    )
    held = F.filter("all", lambda e: (e["i"] >= F.col("a")) & (e["i"] <= F.col("b")))
    mass = F.aggregate(held, F.lit(0.0), lambda x, e: x + e["w"])
    total = F.aggregate(held, F.lit(0.0), lambda x, e: x + e["m"] * e["w"])
    pooled = spans.select("i", "a", F.when(mass > 0, total / mass).alias("m"))
    fits = pooled.groupBy("i", "a").agg(F.min("m").alias("m")).groupBy(F.col("i").alias(order)).agg(F.max("m").alias("fitted"))
    return means.join(F.broadcast(fits), order)  # ``steps`` rows


def baseline_strata(outcomes: DataFrame, baselines: dict[str, Column], strata: dict[str, Column], value: str) -> DataFrame:
    """Mean outcome of every baseline, over all and by stratum, with the means that leave out one symbol.

    baseline, stratum, level, symbols, n, mean, least and most (of the leave-one-symbol-out means; NULL for a
    single symbol). One GROUPING SETS pass gives the sums by symbol; what is left out comes from the same sums.
    """
    member = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in baselines.items()]))
    rows = outcomes.filter(F.col(value).isNotNull()).select(
        "symbol", F.explode(member).alias("baseline"), F.col(value).alias("__value"),
        *[F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in strata.items()],
    )
    keys = [F.col("baseline"), F.col("symbol")]
    sets = [keys, *[[*keys, F.col(n)] for n in strata]]
    sums = rows.groupingSets(sets, *keys, *[F.col(n) for n in strata]).agg(
        F.sum("__value").alias("__s"), F.count("__value").alias("__n"), *[F.grouping(n).alias(f"__of_{n}") for n in strata]
    )
    stratum, level = F.lit("all"), F.lit("all")
    for name in strata:
        stratum = F.when(F.col(f"__of_{name}") == 0, name).otherwise(stratum)
        level = F.when(F.col(f"__of_{name}") == 0, F.col(name)).otherwise(level)
    named = sums.select("baseline", stratum.alias("stratum"), level.alias("level"), "symbol", F.col("__s").alias("s"), F.col("__n").alias("n"))
    cell = Window.partitionBy("baseline", "stratum", "level")  # one row for each symbol
    without = (F.sum("s").over(cell) - F.col("s")) / F.nullif(F.sum("n").over(cell) - F.col("n"), F.lit(0))
    return named.withColumn("without", without).groupBy("baseline", "stratum", "level").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"),
        F.min("without").alias("least"), F.max("without").alias("most"),
    )
