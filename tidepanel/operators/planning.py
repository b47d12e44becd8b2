"""Source planning: which file or page supplies every hour of every instrument."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.keys import parse_object_key
from tidepanel.functions.timefn import MICROS, micros, page_ranges, period_bounds
from tidepanel.operators.contracts import ContractViolation
from tidepanel.operators.gaps import missing_months

SOURCE_COLUMNS = ["source_kind", "symbol", "source_key", "source_period", "range_start", "range_end"]
_DAY = 86_400 * MICROS


def parsed_keys(keys: DataFrame) -> DataFrame:
    """``(object_key)`` rows inside the key grammar, with their fields and half-open bounds."""
    # Exploding an array of one keeps the optimizer from copying the parse into every use of a field.
    start, end = period_bounds(F.col("__k.source_kind"), F.col("__k.period"))
    parsed = keys.select("object_key", F.explode(F.array(parse_object_key(F.col("object_key")))).alias("__k"))
    bounded = F.struct("__k.*", start.alias("range_start"), end.alias("range_end"))
    return parsed.filter("__k IS NOT NULL").select("object_key", F.explode(F.array(bounded)).alias("__k")).select(
        "object_key",
        F.col("__k.source_kind").alias("source_kind"),
        F.col("__k.symbol").alias("symbol"),
        F.col("__k.period").alias("source_period"),
        F.col("__k.filename").alias("filename"),
        F.col("__k.range_start").alias("range_start"),
        F.col("__k.range_end").alias("range_end"),
    )


def paged_ranges(tails: DataFrame, cutoff: Column, page_hours: int = fv.TAIL_PAGE_HOURS) -> DataFrame:
    """``(symbol, tail_start)`` rows as consecutive pages up to the cutoff."""
    pages = F.explode(page_ranges(F.col("tail_start"), cutoff, page_hours)).alias("p")
    return tails.select("symbol", pages).select("symbol", "p.page_start", "p.page_end")


def page_sources(pages: DataFrame) -> DataFrame:
    """Pages as source rows; the period is the request's millisecond span."""
    first = F.unix_millis("page_start").cast("string")
    last = (F.unix_millis("page_end") - 1).cast("string")
    period = F.concat_ws("-", first, last)
    return pages.select(
        F.lit("api").alias("source_kind"),
        "symbol",
        F.concat(F.col("symbol"), F.lit("?"), period).alias("source_key"),
        period.alias("source_period"),
        F.col("page_start").alias("range_start"),
        F.col("page_end").alias("range_end"),
    )


def _archive_rows(parsed: DataFrame) -> DataFrame:
    return parsed.withColumnRenamed("object_key", "source_key").select(*SOURCE_COLUMNS)


@dataclass(frozen=True)
class SourcePlan:
    """The selected sources and everything that must be empty for the plan to stand."""

    sources: DataFrame
    missing_months: DataFrame
    interior_day_gaps: DataFrame
    unknown_identities: DataFrame

    def require(self) -> DataFrame:
        for name in ("missing_months", "interior_day_gaps", "unknown_identities"):
            if not getattr(self, name).isEmpty():
                raise ContractViolation(f"source plan has {name}")
        return self.sources


def plan_source_tiers(
    monthly: DataFrame,
    daily: DataFrame,
    approved: DataFrame,
    candidates: DataFrame,
    ranges: DataFrame,
    warmup_month: Column,
    cutoff: Column,
    page_hours: int = fv.TAIL_PAGE_HOURS,
) -> SourcePlan:
    """``plan_from_keys`` for monthly and daily keys that were parsed apart."""
    return plan_from_keys(
        monthly.unionByName(daily), approved, candidates, ranges, warmup_month, cutoff, page_hours
    )


def _planning_state(keys: DataFrame, approved: DataFrame, candidates: DataFrame, ranges: DataFrame, hour: Column) -> DataFrame:
    """One row per symbol from one shuffle: its keys before the hour, its flags and how far it is live.

    A symbol's keys are one per month or day of the calendar, so its list is short.
    """
    key = F.struct("range_start", "range_end", F.col("object_key").alias("source_key"), "source_period", "source_kind")
    flag = F.lit(True)
    kinds = [
        keys.filter(F.col("range_end") <= hour).select("symbol", key.alias("__key")),
        approved.select("symbol", flag.alias("__ours")),
        candidates.select("symbol", flag.alias("__candidate")),
        ranges.filter(F.col("range_start") < hour).select("symbol", F.col("range_end").alias("__live")),
    ]
    events = kinds[0]
    for kind in kinds[1:]:
        events = events.unionByName(kind, allowMissingColumns=True)
    # Events without symbol belong to no instrument.
    return events.filter("symbol IS NOT NULL").groupBy("symbol").agg(
        F.sort_array(F.collect_list("__key")).alias("__keys"),
        F.coalesce(F.bool_or("__ours"), F.lit(False)).alias("__ours"),
        F.coalesce(F.bool_or("__candidate"), F.lit(False)).alias("__candidate"),
        F.max("__live").alias("__live_until"),
    )


def plan_from_keys(
    keys: DataFrame,
    approved: DataFrame,
    candidates: DataFrame,
    ranges: DataFrame,
    warmup_month: Column,
    cutoff: Column,
    page_hours: int = fv.TAIL_PAGE_HOURS,
) -> SourcePlan:
    """Monthly files before the cutoff month, daily files after it, then an hourly tail.

    ``keys`` are parsed keys, ``approved``/``candidates`` symbol tables and ``ranges`` the active ranges of
    the instruments (open ones reaching the cutoff). The first missing day of a symbol ends its daily
    tier; an observed day after it is an interior gap. Tiers, gaps and unknown identities are expressions
    over one row per symbol, so the plan takes one shuffle.
    """
    hour = F.date_trunc("hour", cutoff)
    boundary = F.date_trunc("month", hour)
    last_day_end = F.date_trunc("day", hour)
    warmup = F.date_trunc("month", warmup_month)

    state = _planning_state(keys, approved, candidates, ranges, hour)
    daily = F.filter("__keys", lambda k: k["source_kind"] == "daily")
    ours = state.filter("__ours").withColumns(
        {
            "__months": F.filter(
                "__keys",
                lambda k: (k["source_kind"] == "monthly") & (k["range_start"] >= warmup) & (k["range_end"] <= boundary),
            ),
            # The n-th observed day of a full run is the n-th day of the month.
            "__days": F.transform(
                F.filter(daily, lambda k: k["range_start"] >= boundary),
                lambda k, i: F.struct(
                    k.alias("key"), F.timestamp_micros(micros(boundary) + i * F.lit(_DAY)).alias("expected")
                ),
            ),
        }
    ).withColumns(
        {
            "__unbroken": F.transform(
                F.filter("__days", lambda d: d["key"]["range_start"] == d["expected"]), lambda d: d["key"]
            ),
            "__late": F.filter("__days", lambda d: d["key"]["range_start"] > d["expected"]),
        }
    ).withColumn(
        "__tail_start", F.coalesce(F.array_max(F.transform("__unbroken", lambda k: k["range_end"])), boundary)
    )

    # Ranges are clipped at the cutoff, so reaching past the tail start means being active in it.
    is_live = (F.col("__tail_start") < hour) & (F.col("__live_until") > F.col("__tail_start"))
    archives = ours.select(
        "symbol",
        F.inline(F.concat("__months", F.filter("__unbroken", lambda k: k["range_start"] < last_day_end))),
    ).select(*SOURCE_COLUMNS)
    tails = ours.filter(is_live).select("symbol", F.col("__tail_start").alias("tail_start"))
    broken = ours.filter(F.size("__late") > 0).select(
        "symbol",
        F.array_min(F.transform("__late", lambda d: d["expected"])).alias("missing_day"),
        F.array_max(F.transform("__late", lambda d: d["key"]["range_start"])).alias("latest_observed_day"),
    )
    gone = missing_months(
        ranges.join(approved.select("symbol").distinct(), "symbol", "left_semi"),
        ours.select("symbol", F.explode("__months").alias("m")).select("symbol", F.col("m.source_period").alias("period")),
        warmup_month,
        F.add_months(boundary.cast("date"), -1),
    )
    unknown = state.filter(~F.col("__candidate") & (F.size(daily) > 0)).select("symbol")
    # Both branches read one exchange: their plans are equal up to the aggregate.
    sources = archives.unionByName(page_sources(paged_ranges(tails, cutoff, page_hours)))
    return SourcePlan(sources, gone, broken, unknown)


def source_inventory(sources: DataFrame) -> DataFrame:
    """Source rows in canonical order."""
    return sources.orderBy("symbol", "range_start", "source_kind", "source_key")


def limit_sources(sources: DataFrame, n: int) -> DataFrame:
    """The first n planned sources; a partial run is never canonical."""
    return sources.orderBy("source_key").limit(n)


def source_overlaps(sources: DataFrame, cutoff: Column) -> DataFrame:
    """Findings about the planned ranges of each symbol; must be empty.

    A symbol's planned files are few (one per month, day or page), hence one window per symbol.
    """
    hour = F.date_trunc("hour", cutoff)
    order = Window.partitionBy("symbol").orderBy("range_start", "range_end", "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_page = F.col("source_kind") == "api"
    seen = sources.withColumns(
        {
            "__prev_end": F.lag("range_end", 1).over(order),
            "__page_before": F.coalesce(F.max(is_page).over(before), F.lit(False)),
            "__prev_page_end": F.last(F.when(is_page, F.col("range_end")), True).over(before),
            "__last_page_end": F.max(F.when(is_page, F.col("range_end"))).over(whole),
        }
    )
    known = F.col("source_kind").isin("monthly", "daily", "api")
    findings = F.array_compact(
        F.array(
            F.when(~known, F.lit("unsupported_kind")),
            F.when(
                (F.col("range_start") >= F.col("range_end")) | (F.col("range_end") > hour),
                F.lit("bad_range"),
            ),
            F.when(F.col("range_start") < F.col("__prev_end"), F.lit("overlap")),
            F.when(F.col("__page_before") & ~is_page, F.lit("archive_after_tail")),
            F.when(
                is_page & (F.col("__prev_page_end") != F.col("range_start")), F.lit("tail_not_contiguous")
            ),
            F.when(
                is_page & (F.col("range_end") == F.col("__last_page_end")) & (F.col("range_end") != hour),
                F.lit("tail_does_not_reach_cutoff"),
            ),
        )
    )
    return seen.select(
        "symbol", "source_kind", "source_key", F.explode(findings).alias("finding")
    )


def planned_period_keys(
    parsed: DataFrame, ready: DataFrame, first_period: Column, last_period: Column
) -> DataFrame:
    """Distinct monthly keys of ready instruments between two ``YYYY-MM`` periods, inclusive."""
    inside = F.col("source_period").between(first_period, last_period)
    return (
        parsed.filter((F.col("source_kind") == "monthly") & inside)
        .join(ready.select("symbol"), "symbol", "left_semi")
        .select("symbol", "object_key")
        .distinct()
    )


def monthly_keys(observations: DataFrame, approved: DataFrame) -> DataFrame:
    """Distinct observed keys of approved symbols from per-symbol key lists."""
    return (
        observations.join(approved.select("symbol"), "symbol", "left_semi")
        .select("symbol", F.explode("observed_archive_object_keys").alias("object_key"))
        .distinct()
    )


def archive_bounds(parsed: DataFrame) -> DataFrame:
    """First and last observed month and distinct file count per symbol."""
    return parsed.filter(F.col("source_kind") == "monthly").groupBy("symbol").agg(
        F.min("source_period").alias("first_archive_month"),
        F.max("source_period").alias("last_archive_month"),
        F.count_distinct("object_key").alias("unique_archive_count"),
    )


def archive_observations(parsed: DataFrame) -> DataFrame:
    """Every listed symbol with its monthly bounds; symbols with daily files only lie at the frontier."""
    month = F.when(F.col("source_kind") == "monthly", F.col("source_period"))
    return parsed.filter("symbol IS NOT NULL").groupBy("symbol").agg(
        F.min(month).alias("first_archive_month"), F.max(month).alias("last_archive_month"),
    ).withColumn(
        "archive_discovery_provenance", F.when(F.col("first_archive_month").isNull(), fv.FRONTIER_ONLY).otherwise("observed")
    )


def observed_key_lists(parsed: DataFrame) -> DataFrame:
    """Sorted key list per symbol (one key per month: a list of a few hundred at most)."""
    keys = parsed.filter(F.col("source_kind") == "monthly").select("symbol", "object_key").distinct()
    return keys.groupBy("symbol").agg(
        F.sort_array(F.collect_list("object_key")).alias("observed_archive_object_keys")
    )


def earliest_file(parsed: DataFrame) -> DataFrame:
    """Smallest (period, key) per symbol; both are text, so one comparable key decides."""
    rank = F.concat_ws("\u0001", "source_period", "object_key")
    best = parsed.groupBy("symbol").agg(F.min(rank).alias("__best"))
    parts = F.split("__best", "\u0001")
    return best.select(
        "symbol", parts[0].alias("source_period"), parts[1].alias("object_key")
    )


def first_trades(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest trade instant per key."""
    return trades.groupBy(*keys).agg(F.min("traded_at").alias("earliest_trade_timestamp"))


def unpaired_files(listing: DataFrame) -> DataFrame:
    """Data objects without their checksum object; ``listing`` has (symbol, object_key)."""
    is_sum = F.col("object_key").endswith(fv.CHECKSUM_SUFFIX)
    sums = listing.filter(is_sum).select(
        "symbol",
        F.expr(f"left(object_key, length(object_key) - {len(fv.CHECKSUM_SUFFIX)})").alias("object_key"),
    )
    return listing.filter(~is_sum).join(sums, ["symbol", "object_key"], "left_anti")


def attempt_findings(attempts: DataFrame, planned: DataFrame) -> DataFrame:
    """Actual against planned source keys: missing, unplanned, duplicated or unverified."""
    done = attempts.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.coalesce(F.col("status") != "verified", F.lit(True))).alias("unverified"),
    )
    plan = planned.select("source_key").distinct().withColumn("__planned", F.lit(True))
    both = done.join(plan, "source_key", "full_outer")
    finding = F.array_compact(
        F.array(
            F.when(F.col("attempts").isNull(), F.lit("missing")),
            F.when(F.col("__planned").isNull(), F.lit("unplanned")),
            F.when(F.col("attempts") > 1, F.lit("duplicated")),
            F.when(F.col("unverified") > 0, F.lit("unverified")),
        )
    )
    return both.select("source_key", F.explode(finding).alias("finding"))
