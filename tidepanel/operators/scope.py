"""Instrument scope: classify from several voters, then keep what is positively in scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.identity import is_canonical_text, is_symbol_identity, is_tag_list, is_token
from tidepanel.schemas import require_columns

SCOPE_COLUMNS = [
    "symbol", "base_asset", "quote_asset", "margin_asset", "contract_type", "market_family",
    "product_family", "underlying_type", "underlying_subtype", "is_crypto_underlying",
    "is_stablecoin_underlying", "is_leveraged_token", "scope_classification_status",
    "scope_classification_provenance",
]


def _identity_holds() -> Column:
    tokens = F.lit(True)
    for name in ("quote_asset", "margin_asset", "contract_type", "underlying_type"):
        tokens = tokens & is_token(F.col(name))
    repeated = F.col("symbol") == F.concat("base_asset", "quote_asset")
    return (
        tokens
        & is_symbol_identity(F.col("symbol"))
        & is_symbol_identity(F.col("base_asset"))
        & is_tag_list(F.col("underlying_subtype"))
        & F.coalesce(repeated, F.lit(False))
    )


def _vote(votes: Column) -> tuple[Column, Column]:
    """(agreed value or NULL, conflict flag) of a list of nullable votes."""
    cast = F.array_distinct(F.array_compact(votes))
    conflict = F.size(cast) > 1
    return F.when(~conflict, F.get(cast, F.lit(0))), conflict


def classify_scope(
    instruments: DataFrame,
    reviews: DataFrame,
    stablecoins: Sequence[str] = tuple(fv.STABLECOIN_UNDERLYINGS),
) -> DataFrame:
    """Derive crypto, stablecoin and leveraged flags with their evidence status.

    ``reviews`` has ``(asset, dimension, value)`` with at most one row per asset and dimension.
    Tags and the configured list only ever vote "yes"; a review may vote either way; votes that
    disagree leave the flag NULL. Whether any identity field is malformed is decided first and
    blanks every derived flag.
    """
    stable_reviews = reviews.filter(F.col("dimension") == "stablecoin_underlying").select(
        F.col("asset").alias("base_asset"), F.col("value").alias("__stable_review")
    )
    lever_reviews = reviews.filter(F.col("dimension") == "leveraged_token").select(
        F.col("asset").alias("symbol"), F.col("value").alias("__lever_review")
    )
    joined = instruments.join(stable_reviews, "base_asset", "left").join(
        lever_reviews, "symbol", "left"
    )
    tags = F.transform(F.col("underlying_subtype"), F.upper)
    ok = F.col("__ok")
    stable_tag = ok & F.array_contains(tags, "STABLECOIN")
    lever_tag = ok & F.exists(tags, lambda tag: tag.contains("LEVERAGED"))
    configured = F.coalesce(F.col("base_asset").isin(list(stablecoins)), F.lit(False))
    yes = F.lit(True)
    stable, stable_conflict = _vote(
        F.array(F.when(stable_tag, yes), F.when(configured, yes), F.col("__stable_review"))
    )
    lever, lever_conflict = _vote(F.array(F.when(lever_tag, yes), F.col("__lever_review")))

    def status(conflict: Column, review: str, tag: Column, guard: Column | None) -> Column:
        chain = F.when(conflict, "conflicting_affirmative_evidence").when(
            F.col(review).isNotNull(), "accepted_reviewed_evidence"
        )
        if guard is not None:
            chain = chain.when(guard, "affirmative_configured_positive_guard")
        chain = chain.when(tag, "affirmative_exchange_info_subtype").otherwise(
            "unresolved_no_affirmative_negative_evidence"
        )
        return F.when(ok, chain).otherwise("unresolved_invalid_identity")

    def word(conflict: Column) -> Column:
        return F.when(conflict, "conflict").otherwise("none")

    voted = joined.withColumn("__ok", _identity_holds()).withColumns(
        {
            "__stable": stable, "__stable_conflict": stable_conflict,
            "__lever": lever, "__lever_conflict": lever_conflict,
            "stablecoin_evidence_status": status(
                stable_conflict, "__stable_review", stable_tag, configured
            ),
            "leveraged_evidence_status": status(lever_conflict, "__lever_review", lever_tag, None),
        }
    )
    resolved = ok & F.col("__stable").isNotNull() & F.col("__lever").isNotNull()
    return voted.select(
        *instruments.columns,
        F.when(ok, F.lit(fv.MARKET_FAMILY)).alias("market_family"),
        F.when(ok, F.lit(fv.PRODUCT_FAMILY)).alias("product_family"),
        F.when(ok, F.col("underlying_type") == "COIN").alias("is_crypto_underlying"),
        F.when(ok, F.col("__stable")).alias("is_stablecoin_underlying"),
        F.when(ok, F.col("__lever")).alias("is_leveraged_token"),
        "stablecoin_evidence_status",
        word(F.col("__stable_conflict")).alias("stablecoin_conflict_status"),
        "leveraged_evidence_status",
        word(F.col("__lever_conflict")).alias("leveraged_conflict_status"),
        F.when(ok, F.col("symbol") == fv.BENCHMARK_SYMBOL).alias("is_benchmark_btc"),
        F.when(ok, F.col("symbol") == fv.TAGGED_SYMBOL).alias("is_eth"),
        F.when(resolved, "resolved_reviewed_evidence")
        .otherwise(fv.UNRESOLVED)
        .alias("scope_classification_status"),
        F.when(resolved, "versioned_classification_evidence_and_positive_exclusion_guard").alias(
            "scope_classification_provenance"
        ),
    )


def in_scope(stablecoins: Sequence[str] = tuple(fv.STABLECOIN_UNDERLYINGS)) -> Column:
    """TRUE only for fully classified, well-formed, in-scope instruments; never NULL."""
    rule = (
        _identity_holds()
        & is_token(F.col("market_family"))
        & is_token(F.col("product_family"))
        & is_canonical_text(F.col("scope_classification_provenance"))
        & F.coalesce(F.col("scope_classification_status") != fv.UNRESOLVED, F.lit(True))
        & (F.col("quote_asset") == fv.QUOTE_ASSET)
        & (F.col("margin_asset") == fv.QUOTE_ASSET)
        & (F.col("contract_type") == fv.CONTRACT_TYPE)
        & (F.col("market_family") == fv.MARKET_FAMILY)
        & (F.col("product_family") == fv.PRODUCT_FAMILY)
        & F.col("is_crypto_underlying")
        & ~F.col("is_stablecoin_underlying")
        & ~F.col("is_leveraged_token")
        & ~F.col("base_asset").isin(list(stablecoins))
    )
    return F.coalesce(rule, F.lit(False))


def filter_scope(
    contracts: DataFrame, stablecoins: Sequence[str] = tuple(fv.STABLECOIN_UNDERLYINGS)
) -> DataFrame:
    require_columns(contracts, SCOPE_COLUMNS, "instrument classification")
    return contracts.filter(in_scope(stablecoins))


def semi_scope(bars: DataFrame, contracts: DataFrame) -> DataFrame:
    """Bars of the given instruments. Spark broadcasts the symbols while they are small enough."""
    return bars.join(contracts.select("symbol"), "symbol", "left_semi")


def ready_universe(
    catalog: DataFrame, stablecoins: Sequence[str] = tuple(fv.STABLECOIN_UNDERLYINGS)
) -> DataFrame:
    ready = F.col("historical_inclusion_readiness") == "ready"
    return filter_scope(catalog, stablecoins).filter(ready)


def unknown_identities(data: DataFrame, catalog: DataFrame) -> DataFrame:
    """Symbols in the data that the catalog does not list; must be empty."""
    return data.select("symbol").distinct().join(catalog.select("symbol"), "symbol", "left_anti")
