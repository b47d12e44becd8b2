"""Point-in-time eligibility from contract rows and lifecycle intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.identity import is_symbol_identity
from tidepanel.functions.timefn import MICROS, age_days, micros
from tidepanel.operators.contracts import ContractViolation
from tidepanel.schemas import as_timestamp, intervals_column, require_columns

CONTRACT_COLUMNS = [
    "symbol", "delisting_announcement_published_at", "scope_classification_status",
    "eligibility_age_anchor_at", "eligibility_age_anchor_basis", "first_observed_trade_at",
    "first_observed_trade_evidence_status",
]
_OUTPUT = ["contract_age_days", "is_eligible", "is_eth", "is_benchmark"]


def _is_verified(contracts: DataFrame) -> Column:
    verified = (
        (F.col("eligibility_age_anchor_basis") == fv.ANCHOR_BASIS)
        & (F.col("first_observed_trade_evidence_status") == fv.TRADE_EVIDENCE_STATUS)
        & (
            as_timestamp(contracts, "eligibility_age_anchor_at")
            == as_timestamp(contracts, "first_observed_trade_at")
        )
    )
    return F.coalesce(verified, F.lit(False))


def unverified_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts whose age anchor is not an exact, verified first trade; must be empty."""
    return contracts.filter(~_is_verified(contracts))


def exploded_intervals(contracts: DataFrame) -> DataFrame:
    """One row per lifecycle interval with (symbol, lifecycle_episode_id, ...)."""
    exploded = contracts.select(F.explode(intervals_column(contracts)).alias("i"))
    return exploded.select("i.*")


def interval_is_active(interval: Column, at: Column) -> Column:
    """Start and last trading instant are inclusive, the eligibility end is exclusive."""
    last, end = interval["last_trading_at"], interval["eligibility_end_at"]
    return (
        (at >= interval["age_live_anchor_at"].cast("timestamp"))
        & F.coalesce(at <= last.cast("timestamp"), F.lit(True))
        & F.coalesce(at < end.cast("timestamp"), F.lit(True))
    )


def overlapping_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals that start while an earlier one of the symbol can still be active."""
    order = Window.partitionBy("symbol").orderBy("age_live_anchor_at", "lifecycle_episode_id")
    far = F.lit("9999-12-31T00:00:00Z").cast("timestamp")
    # Active up to and including last trading, strictly before the end: the earlier bound decides.
    last = F.coalesce(F.col("last_trading_at"), far)
    end = F.coalesce(F.col("eligibility_end_at") - F.expr("INTERVAL 0.000001 SECOND"), far)
    reach = F.max(F.least(last, end)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("__reach", reach).filter(
        F.col("age_live_anchor_at") <= F.col("__reach")
    ).drop("__reach")


def contract_profile(contracts: DataFrame) -> Row:
    """Soundness of a contract table in one small job."""
    size = (
        F.coalesce(F.size(intervals_column(contracts)), F.lit(0))
        if "lifecycle_intervals" in contracts.columns
        else F.lit(0)
    )
    per_symbol = contracts.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~_is_verified(contracts)).alias("unverified"),
        F.max(size).alias("intervals"),
    )
    return per_symbol.agg(
        F.count_if(F.col("n") > 1).alias("repeated_symbols"),
        F.sum("unverified").alias("unverified"),
        F.count_if(~is_symbol_identity(F.col("symbol").cast("string"))).alias("malformed"),
        F.max(F.col("intervals") > 0).alias("has_intervals"),
    ).first()


def _require_sound(bars: DataFrame, contracts: DataFrame, time: str, profile: Row) -> None:
    if profile["unverified"]:
        raise ContractViolation("contracts lack an exact verified first-trade age anchor")
    if profile["repeated_symbols"]:
        raise ContractViolation("contracts must have one row per symbol")
    symbols = bars.select(F.col("symbol").cast("string").alias("symbol")).distinct()
    if profile["malformed"] or not symbols.filter(~is_symbol_identity(F.col("symbol"))).isEmpty():
        raise ContractViolation("malformed symbol identity")
    if profile["has_intervals"]:
        suspects = overlapping_intervals(exploded_intervals(contracts)).select("symbol").distinct()
        if suspects.isEmpty():
            return
        # Only bars of symbols with overlapping intervals can match twice.
        intervals = contracts.join(suspects, "symbol", "left_semi").select(
            "symbol", intervals_column(contracts).alias("__intervals")
        )
        hits = F.size(F.filter("__intervals", lambda i: interval_is_active(i, F.col("__at"))))
        clash = bars.select("symbol", as_timestamp(bars, time).alias("__at")).join(
            intervals, "symbol"
        )
        if not clash.filter(hits > 1).isEmpty():
            raise ContractViolation("overlapping lifecycle intervals select more than one episode")


def apply_eligibility(
    bars: DataFrame,
    contracts: DataFrame,
    minimum_age_days: int = 30,
    time: str = "close_time",
    benchmark: str = fv.BENCHMARK_SYMBOL,
    tagged: str = fv.TAGGED_SYMBOL,
    strict: bool = True,
) -> DataFrame:
    """Join contracts and decide eligibility at each bar's close.

    Intervals stay nested in the contract row, so the join is many-to-one and the active interval
    is picked by a filter on the array: no row is multiplied and no range join is needed. When any
    contract carries intervals, every anchor comes from intervals.
    """
    require_columns(contracts, CONTRACT_COLUMNS, "contract metadata")
    nested = False
    if strict or "lifecycle_intervals" in contracts.columns:
        profile = contract_profile(contracts)
        nested = bool(profile["has_intervals"])
        if strict:
            _require_sound(bars, contracts, time, profile)
    own = [c for c in contracts.columns if c != "symbol" and c not in bars.columns]
    casts = {
        c: as_timestamp(contracts, c)
        for c in ("delisting_announcement_published_at", "eligibility_age_anchor_at")
    }
    side = contracts.withColumns(casts).select("symbol", *own)
    if nested:
        side = side.withColumn("lifecycle_intervals", intervals_column(contracts))
    at = F.col("__at")
    joined = bars.join(side, "symbol", "left").withColumn("__at", as_timestamp(bars, time))
    selected_end = F.lit(None).cast("timestamp")
    added = list(_OUTPUT)
    if nested:
        active = F.filter("lifecycle_intervals", lambda i: interval_is_active(i, at))
        joined = joined.withColumn("__pick", F.get(active, F.lit(0)))
        joined = joined.withColumns(
            {
                "eligibility_age_anchor_at": F.col("__pick.age_live_anchor_at").cast("timestamp"),
                "eligibility_age_anchor_basis": F.col("__pick.anchor_basis"),
                "selected_lifecycle_episode_id": F.col("__pick.lifecycle_episode_id"),
            }
        )
        selected_end = F.col("__pick.eligibility_end_at").cast("timestamp")
        added.insert(0, "selected_lifecycle_episode_id")
    anchor = F.col("eligibility_age_anchor_at")
    announced = F.col("delisting_announcement_published_at")
    old_enough = micros(at) - micros(anchor) >= F.lit(minimum_age_days * 86_400 * MICROS)
    included = (
        F.col("scope_disposition") == fv.IN_SCOPE
        if "scope_disposition" in joined.columns
        else F.col("symbol") != benchmark
    )
    eligible = (
        # An unmatched contract has no status; it fails on the missing anchor, not here.
        F.coalesce(F.col("scope_classification_status") != fv.UNRESOLVED, F.lit(True))
        & included
        & (F.col("eligibility_age_anchor_basis") == fv.ANCHOR_BASIS)
        & old_enough
        & F.coalesce(at < announced, F.lit(True))
        & F.coalesce(at < selected_end, F.lit(True))
        & F.col("close").isNotNull()
    )
    return joined.withColumns(
        {
            "contract_age_days": age_days(at, anchor),
            "is_eligible": F.coalesce(eligible, F.lit(False)),
            "is_eth": F.col("symbol") == tagged,
            "is_benchmark": F.col("symbol") == benchmark,
        }
    ).select(*bars.columns, *own, *[c for c in added if c not in own])


ELIGIBILITY_COLUMNS = [
    "symbol", "open_time", "open", "high", "low", "close", "base_volume", "quote_volume",
    "trade_count", "close_time", "source_hour_count", "contract_age_days", "is_eligible", "is_eth",
    "is_benchmark",
]


def eligibility_projection(df: DataFrame) -> DataFrame:
    """The fixed stage columns, plus the selected episode where intervals were used."""
    extra = [c for c in ("selected_lifecycle_episode_id",) if c in df.columns]
    return df.select(*ELIGIBILITY_COLUMNS, *extra)
