"""Daily presence: discontinuities that no reviewed lifecycle boundary explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel import fixed_values as fv

RULES = [
    "interior_discontinuity",
    "reviewed_gap_changed",
    "activity_after_terminal",
    "activity_after_registry_terminal",
    "frontier_missing",
]


def _events(presence: DataFrame, reviewed_gaps: DataFrame, episodes: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """All four inputs as narrow rows of one type; each kind fills its own columns."""
    both = F.col("last_before").isNotNull() & F.col("first_after").isNotNull()
    exact = (F.col("review_status") == fv.ACCEPTED_CUTOFF) & F.col("terminal_day").isNotNull()
    kinds = [
        presence.select("symbol", F.col("day").alias("__day"), F.lit(True).alias("__seen")),
        reviewed_gaps.select(
            "symbol", F.when(both, F.struct("last_before", "first_after")).alias("__pair"),
            F.col("terminal_day").alias("__gap_terminal"),
        ),
        episodes.select(
            "symbol", F.col("position").cast("bigint").alias("__position"), F.col("terminated_day").alias("__terminated_day")
        ),
        cutoffs.where(exact).select(
            "symbol", F.struct(F.col("position").cast("bigint").alias("position"), "terminal_day").alias("__cutoff")
        ),
    ]
    events = kinds[0]
    for kind in kinds[1:]:
        events = events.unionByName(kind, allowMissingColumns=True)
    return events.where(F.col("symbol").isNotNull())


def _findings(rule: str, spans: Column) -> Column:
    """Spans (from, to) of an array as findings of a rule."""
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(RULES.index(rule)).alias("priority"), F.lit(rule).alias("finding"),
            s["from"].alias("detected_from"), s["to"].alias("detected_to"),
        ),
    )


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("from"), end.alias("to"))


def _if(condition: Column, start: Column, end: Column) -> Column:
    """One span where the condition holds, else none."""
    return F.filter(F.array(_span(start, end)), lambda _: F.coalesce(condition, F.lit(False)))


def presence_findings(
    presence: DataFrame,
    reviewed_gaps: DataFrame,
    episodes: DataFrame,
    cutoffs: DataFrame,
    horizon: Column,
) -> DataFrame:
    """The first finding per symbol, and the frontier finding after a registry terminal.

    presence       (symbol, day)                distinct trading days
    reviewed_gaps  (symbol, last_before, first_after, terminal_day)  at most one row per symbol
    episodes       (symbol, position, terminated_day); symbols without rows have one open episode
    cutoffs        (symbol, position, review_status, terminal_day)   reviewed registry rows
    horizon        exclusive date

    All inputs meet as events in one shuffle by symbol. A symbol's state is its set of days, built by partial
    aggregation: as long as the calendar, however many rows say so. Rules are expressions over that state, and
    precedence is the place in their array. Symbols without presence rows and the null symbol have no findings.
    """
    symbols = _events(presence, reviewed_gaps, episodes, cutoffs).groupBy("symbol").agg(
        F.bool_or("__seen").alias("__seen"),
        F.sort_array(F.collect_set(F.when(F.col("__day") < horizon, F.col("__day")))).alias("__days"),
        F.collect_set("__pair").alias("__pairs"),
        F.max("__gap_terminal").alias("__gap_terminal"),
        F.coalesce(F.max("__position"), F.lit(1).cast("bigint")).alias("__count"),
        F.max_by("__terminated_day", "__position").alias("__final"),
        F.max("__terminated_day").alias("__terminated"),
        F.collect_set("__cutoff").alias("__cutoffs"),
    ).where("__seen")
    days, size = F.col("__days"), F.size("__days")
    steps = F.when(
        size > 1,
        F.zip_with(
            F.slice(days, F.lit(1), size - 1), F.slice(days, F.lit(2), size - 1),
            lambda a, b: F.struct(a.alias("last_before"), b.alias("first_after")),
        ),
    ).otherwise(F.array().cast("array<struct<last_before:date,first_after:date>>"))
    state = symbols.withColumns(
        {
            "__steps": steps,
            "__last": F.get(days, size - 1),
            "__terminal": F.greatest("__terminated", "__gap_terminal"),
            "__open": F.col("__final").isNull() & ~F.exists("__cutoffs", lambda c: c["position"] == F.col("__count")),
        }
    )
    last, expected = F.col("__last"), F.date_sub(horizon, 1)
    jumps = F.filter(
        F.filter("__steps", lambda s: F.datediff(s["first_after"], s["last_before"]) > 1),
        lambda s: ~F.array_contains("__pairs", s),
    )
    changed = F.filter(
        "__pairs",
        lambda g: F.array_contains("__days", g["last_before"]) & F.array_contains("__days", g["first_after"])
        & ~F.array_contains("__steps", g),
    )
    passed = F.transform(
        F.filter("__cutoffs", lambda c: (c["position"] >= F.col("__count")) & (last > c["terminal_day"])),
        lambda c: c["terminal_day"],
    )
    as_span = lambda s: _span(s["last_before"], s["first_after"])
    state = state.withColumn("__passed", F.array_min(passed))
    found = F.concat(
        _findings("interior_discontinuity", F.slice(F.transform(jumps, as_span), 1, 1)),
        _findings("reviewed_gap_changed", F.transform(changed, as_span)),
        _findings(
            "activity_after_terminal", _if(~F.col("__open") & (last > F.col("__terminal")), F.col("__terminal"), last)
        ),
        _findings("activity_after_registry_terminal", _if(F.col("__passed").isNotNull(), F.col("__passed"), last)),
        _findings("frontier_missing", _if(F.col("__open") & (last.isNull() | (last < expected)), last, expected)),
    )
    lead = F.get("__found", F.lit(0))["priority"]
    registry, frontier = (RULES.index(r) for r in ("activity_after_registry_terminal", "frontier_missing"))
    kept = F.filter(
        "__found", lambda f: (f["priority"] == lead) | ((lead == registry) & (f["priority"] == frontier))
    )
    return state.select("symbol", found.alias("__found")).select("symbol", F.inline(kept)).drop("priority")
