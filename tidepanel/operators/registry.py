"""Candidate sets, scope registries and reviewed cutoffs as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.identity import is_token


def union_candidates(layers: DataFrame) -> DataFrame:
    """Distinct identities over discovery layers, canonical ones told apart from quarantined.

    ``layers`` has (layer, identity).
    """
    return layers.groupBy("identity").agg(F.count_distinct("layer").alias("layer_count")).withColumn(
        "is_canonical", is_token(F.col("identity"))
    )


def daily_only_candidates(monthly: DataFrame, daily: DataFrame) -> DataFrame:
    """Identities of the daily layer without monthly files, as explicit blocked rows."""
    only = daily.select("symbol").distinct().join(monthly.select("symbol"), "symbol", "left_anti")
    return only.select(
        "symbol",
        F.lit(None).cast("string").alias("first_archive_month"),
        F.lit(None).cast("string").alias("last_archive_month"),
        F.lit(fv.FRONTIER_ONLY).alias("archive_discovery_provenance"),
        F.lit(0).cast("bigint").alias("unique_archive_count"),
    )


def candidate_diff(discovered: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Identities added to or removed from a reviewed registry."""
    left = discovered.select("identity").distinct().withColumn("__d", F.lit(True))
    right = reviewed.select("identity").distinct().withColumn("__r", F.lit(True))
    change = F.when(F.col("__r").isNull(), "added").when(F.col("__d").isNull(), "removed")
    return left.join(right, "identity", "full_outer").withColumn("change", change).filter(
        "change IS NOT NULL"
    ).select("identity", "change")


_EVIDENCE_FIELDS = [
    "source_name", "source_type", "source_identifier", "source_url", "reviewed_at",
    "evidence_summary", "review_version",
]


def _positive_evidence(exclusion: str) -> Column:
    direct = F.filter(
        F.col("evidence"),
        lambda e: (e["evidence_class"] == "direct_positive_exclusion") & (e["exclusion_class"] == exclusion),
    )

    def filled(e: Column) -> Column:
        ok = F.lit(True)
        for name in _EVIDENCE_FIELDS:
            ok = ok & (F.length(F.trim(F.coalesce(e[name], F.lit("")))) > 0)
        return ok

    return (F.size(direct) == 1) & F.forall(direct, filled)


def registry_findings(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings of a scope registry against the candidate set; must be empty.

    ``registry`` has (contract_identity, scope_audit_status, is_stablecoin_underlying,
    is_leveraged_token, stablecoin_evidence_status, leveraged_evidence_status, evidence).
    """
    listed = candidates.select(F.col("identity").alias("contract_identity")).withColumn(
        "__candidate", F.lit(True)
    )
    repeated = registry.groupBy("contract_identity").agg(F.count(F.lit(1)).alias("__n"))

    def flag_findings(flag: str, status: str, exclusion: str) -> list[Column]:
        on, off = F.col(flag) == F.lit(True), F.col(flag) == F.lit(False)
        positive = F.col(status).eqNullSafe(F.lit("positive_exclusion_evidence"))
        negative = F.col(status).eqNullSafe(F.lit("reviewed_finite_universe_negative"))
        proven = F.coalesce(_positive_evidence(exclusion), F.lit(False))
        return [
            F.when(on & ~positive, F.lit(f"{exclusion}_positive_wrong_status")),
            F.when(on & ~proven, F.lit(f"{exclusion}_positive_without_evidence")),
            F.when(off & ~negative, F.lit(f"{exclusion}_negative_wrong_status")),
        ]

    findings = F.array_compact(
        F.array(
            F.when(F.col("__candidate").isNull(), F.lit("not_a_candidate")),
            F.when(F.col("__n").isNull(), F.lit("missing_record")),
            F.when(F.col("__n") > 1, F.lit("duplicate_record")),
            F.when(
                F.col("__n").isNotNull() & ~F.col("scope_audit_status").eqNullSafe(F.lit("complete")),
                F.lit("incomplete_disposition"),
            ),
            *flag_findings("is_stablecoin_underlying", "stablecoin_evidence_status", "stablecoin"),
            *flag_findings("is_leveraged_token", "leveraged_evidence_status", "leveraged_token"),
        )
    )
    joined = registry.join(repeated, "contract_identity").join(
        listed, "contract_identity", "full_outer"
    )
    return joined.select("contract_identity", F.explode(findings).alias("finding")).distinct()


def propose_cutoffs(catalog_episodes: DataFrame) -> DataFrame:
    """One proposed cutoff row per episode of an in-scope instrument.

    ``catalog_episodes`` has (symbol, scope_disposition, position, episode_count,
    present_in_current_exchange_info, latest_known_status, lifecycle_episode_id,
    delisting_announcement_published_at, delisting_article_id, last_trading_at).
    """
    cutoff = F.col("delisting_announcement_published_at")
    current = (
        (F.col("position") == F.col("episode_count"))
        & F.coalesce("present_in_current_exchange_info", F.lit(False))
        & (F.col("latest_known_status") == "TRADING")
    )
    status = (
        F.when(cutoff.isNotNull(), fv.ACCEPTED_CUTOFF)
        .when(current, fv.CURRENT_EPISODE)
        .otherwise(fv.NO_RELIABLE_CUTOFF)
    )
    scoped = catalog_episodes.filter(F.col("scope_disposition").isin(fv.IN_SCOPE, fv.BENCHMARK_ONLY))
    return scoped.select(
        "symbol",
        "lifecycle_episode_id",
        F.col("delisting_article_id").alias("article_code"),
        cutoff.alias("official_publication_timestamp"),
        F.col("last_trading_at").alias("terminal_last_trading_at"),
        F.when(cutoff.isNotNull(), fv.TERMINATION_DISPOSITION).alias("product_event_disposition"),
        status.alias("review_status"),
    )


def exactly_one(evidence: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Values of keys that match exactly one row; keys with more are dropped, as if absent.

    The row count and the values come from one map-side combined aggregate.
    """
    single = evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__matches"), *[F.any_value(v).alias(v) for v in values]
    )
    return single.filter("__matches = 1").drop("__matches")


def accepted_events(evidence: DataFrame, event_type: str, values: list[str]) -> DataFrame:
    """The single accepted event of a symbol, where there is exactly one."""
    rows = evidence.filter((F.col("event_type") == event_type) & (F.col("match_status") == "accepted"))
    return exactly_one(rows, ["symbol"], values)


def cutoff_findings(cutoffs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Accepted cutoffs that do not bind exactly one evidence row with equal fields.

    ``cutoffs`` has (symbol, lifecycle_episode_id, article_code, official_article_url,
    raw_article_sha256, official_publication_timestamp, terminal_last_trading_at,
    product_event_disposition, review_status).
    """
    keys = ["symbol", "article_code"]
    rows = evidence.filter(F.col("event_type") == "delisting").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__matches"),
        *[
            F.any_value(c).alias(f"e_{c}")
            for c in (
                "raw_snapshot_sha256", "source_url", "article_published_at", "official_event_at",
                "match_status", "article_semantic_class", "event_time_evidence_status",
            )
        ],
    )
    accepted = cutoffs.filter(F.col("review_status") == fv.ACCEPTED_CUTOFF)
    joined = accepted.join(rows, keys, "left")
    anchored = F.col("e_event_time_evidence_status").eqNullSafe(F.lit("action_symbol_time_anchored"))
    terminal, event = F.col("terminal_last_trading_at"), F.col("e_official_event_at")
    bound = F.col("__matches").eqNullSafe(F.lit(1))

    def differs(mine: str, theirs: str) -> Column:
        return bound & ~F.col(mine).eqNullSafe(F.col(f"e_{theirs}"))

    findings = F.array_compact(
        F.array(
            F.when(
                ~F.coalesce(F.col("raw_article_sha256").rlike(r"^[0-9a-f]{64}\z"), F.lit(False))
                | F.col("article_code").isNull()
                | F.col("official_article_url").isNull(),
                F.lit("no_exact_evidence"),
            ),
            F.when(
                ~F.col("product_event_disposition").eqNullSafe(F.lit(fv.TERMINATION_DISPOSITION)),
                F.lit("wrong_disposition"),
            ),
            F.when(~bound, F.lit("not_exactly_one_row")),
            F.when(differs("raw_article_sha256", "raw_snapshot_sha256"), F.lit("hash_differs")),
            F.when(differs("official_article_url", "source_url"), F.lit("url_differs")),
            F.when(
                bound
                & ~(
                    F.col("e_match_status").eqNullSafe(F.lit("accepted"))
                    & F.col("e_article_semantic_class").eqNullSafe(F.lit(fv.DELISTING_CLASS))
                ),
                F.lit("evidence_not_accepted"),
            ),
            F.when(
                differs("official_publication_timestamp", "article_published_at"),
                F.lit("publication_differs"),
            ),
            F.when(bound & terminal.isNull() & (event.isNotNull() | anchored), F.lit("terminal_omitted")),
            F.when(bound & terminal.isNotNull() & ~anchored, F.lit("terminal_not_anchored")),
            F.when(
                bound & terminal.isNotNull() & anchored & ~terminal.eqNullSafe(event),
                F.lit("terminal_differs"),
            ),
        )
    )
    return joined.select("symbol", "lifecycle_episode_id", F.explode(findings).alias("finding"))


def cutoff_registry_findings(cutoffs: DataFrame) -> DataFrame:
    """Shape of the cutoff registry itself: identities, duplicates, dispositions."""
    repeated = cutoffs.groupBy("lifecycle_episode_id").agg(F.count(F.lit(1)).alias("__n"))
    owned = F.col("lifecycle_episode_id").startswith(F.concat(F.col("symbol"), F.lit(":")))
    others = [fv.NO_RELIABLE_CUTOFF, fv.CURRENT_EPISODE, fv.CONFLICTING_CUTOFF]
    published = F.col("official_publication_timestamp").isNotNull()
    accepted = F.col("review_status") == fv.ACCEPTED_CUTOFF
    findings = F.array_compact(
        F.array(
            F.when(~F.coalesce(owned, F.lit(False)), F.lit("wrong_episode_identity")),
            F.when(F.col("__n") > 1, F.lit("duplicate_episode")),
            F.when(accepted & ~published, F.lit("accepted_without_cutoff")),
            F.when(
                ~F.coalesce(accepted, F.lit(False))
                & (~F.coalesce(F.col("review_status").isin(others), F.lit(False)) | published),
                F.lit("invalid_disposition"),
            ),
        )
    )
    return cutoffs.join(repeated, "lifecycle_episode_id").select(
        "symbol", "lifecycle_episode_id", F.explode(findings).alias("finding")
    )
