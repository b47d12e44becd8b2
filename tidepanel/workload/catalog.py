"""The lifecycle catalog over derived evidence tables.

Inputs follow the user bucket of a symbol (0 to 9), so each bucket is one lifecycle situation; the
SQL counterparts state the outcome of every situation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.timefn import plus_seconds
from tidepanel.operators import catalog as cat
from tidepanel.operators import registry as rg
from tidepanel.workload.registry import query
from tidepanel.workload.views import BENCHMARK, SQL_VIEWS, Views, at

_B = "bucket"
_TEXT = "string"


def _none(kind: str):
    return F.lit(None).cast(kind)


def _inputs(v: Views) -> cat.CatalogInputs:
    s, b = v.spans, F.col(_B)
    day = F.date_trunc("day", "first_ts")
    listing_code, delisting_code = F.concat(F.lit("l"), "symbol"), F.concat(F.lit("x"), "symbol")
    published = plus_seconds(F.col("last_ts"), -5 * 86_400)
    terminal = plus_seconds(F.col("last_ts"), -4 * 86_400)
    archive = s.select(
        "symbol",
        F.when(b != 9, F.date_format(F.add_months("first_ts", -b), "yyyy-MM")).alias("first_archive_month"),
        F.when(b != 9, F.date_format("last_ts", "yyyy-MM")).alias("last_archive_month"),
        F.when(b == 9, fv.FRONTIER_ONLY).otherwise("observed").alias("archive_discovery_provenance"),
    )
    snapshot = s.filter(b <= 6).select(
        "symbol", F.concat("kind", b.cast(_TEXT)).alias("base_asset"),
        *[F.lit("USDT").alias(c) for c in ("quote_asset", "margin_asset")],
        F.lit("USDM").alias("market_family"), F.lit("FUTURES").alias("product_family"),
        F.lit("PERPETUAL").alias("contract_type"), F.lit("COIN").alias("underlying_type"),
        F.array(F.lit("Layer-1")).alias("underlying_subtype"), F.lit(True).alias("is_crypto_underlying"),
        (b == 6).alias("is_stablecoin_underlying"), F.when(b != 5, F.lit(False)).alias("is_leveraged_token"),
        F.lit("accepted").alias("stablecoin_evidence_status"), F.lit("none").alias("stablecoin_conflict_status"),
        F.lit("accepted").alias("leveraged_evidence_status"),
        F.when(b == 5, "conflict").otherwise("none").alias("leveraged_conflict_status"),
        F.when(b == 5, "unresolved").otherwise("resolved_reviewed_evidence").alias("scope_classification_status"),
        F.lit("p").alias("scope_classification_provenance"),
        F.timestamp_micros(F.unix_micros("first_ts") + b.cast("bigint") * F.lit(1_800_000_000)).alias("exchange_info_onboard_at"),
        _none("timestamp").alias("exchange_info_delivery_at"),
        F.when(b < 4, "TRADING").otherwise("SETTLING").alias("latest_known_status"),
        at("2024-02-01 00:00:00").alias("metadata_acquired_at"),
    )
    scope = s.filter(b <= 8).select(
        F.col("symbol").alias("contract_identity"), F.when(b != 1, F.concat("kind", b.cast(_TEXT))).alias("base_asset"),
        F.lit("USDT").alias("quote_asset"),
        F.when(F.col("symbol") == BENCHMARK, fv.BENCHMARK_ONLY).when(b == 8, "excluded_stablecoin").otherwise(fv.IN_SCOPE).alias("product_scope"),
        F.when(b == 7, "open").otherwise("complete").alias("scope_audit_status"),
        F.lit(True).alias("is_crypto_underlying"), (b == 8).alias("is_stablecoin_underlying"),
        F.lit(False).alias("is_leveraged_token"), F.lit("reviewed").alias("stablecoin_evidence_status"),
        F.lit("reviewed").alias("leveraged_evidence_status"),
    )
    event = F.when(b == 0, plus_seconds(F.col("first_ts"), 3600)).when(b == 2, plus_seconds(F.col("first_ts"), -3600))

    def row(kind, code, status, semantic, when, event_at):
        return F.struct(
            F.lit(kind).alias("event_type"), "symbol", F.lit(status).alias("match_status"), code.alias("article_code"),
            F.lit(semantic).alias("article_semantic_class"), when.alias("article_published_at"), event_at.alias("official_event_at"),
            F.when(event_at.isNotNull(), "action_symbol_time_anchored").otherwise("unresolved").alias("event_time_evidence_status"),
            F.sha2(code, 256).alias("raw_snapshot_sha256"), F.concat(F.lit("u/"), code).alias("source_url"),
        )

    listed = row("listing", listing_code, "accepted", fv.LAUNCH_CLASS, F.col("first_ts"), event)
    again = row("listing", F.concat(listing_code, F.lit("b")), "accepted", fv.LAUNCH_CLASS, F.col("first_ts"), _none("timestamp"))
    ended = row("delisting", delisting_code, "accepted", fv.DELISTING_CLASS, published, F.when(b == 3, terminal))
    unclear = row("delisting", delisting_code, "ambiguous_multiple_applicable_articles", fv.DELISTING_CLASS, published, _none("timestamp"))
    evidence = s.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(b <= 4, listed), F.when(b == 4, again), F.when(b.isin(3, 5), ended), F.when(b == 7, unclear)
                )
            )
        ).alias("e")
    ).select("e.*")
    trades = s.filter(b != 6).select(
        "symbol", F.col("first_ts").alias("earliest_trade_timestamp"), F.lit(fv.TRADE_EVIDENCE_STATUS).alias("evidence_status")
    )

    def trade(n, when, on):
        return F.struct(
            F.concat("symbol", F.lit(f":{n}")).alias("lifecycle_episode_id"), "symbol", when.alias("earliest_trade_timestamp"),
            on.alias("archive_date"), F.lit("h").alias("published_sha256"), F.lit("h").alias("computed_sha256"),
            F.lit(fv.TRADE_EVIDENCE_STATUS).alias("evidence_status"), F.lit(True).alias("is_primitive_verified"),
        )

    second = plus_seconds(day, 14 * 86_400)
    late = F.to_date(F.when(F.col("kind") == "VIEW", plus_seconds(second, 86_400)).otherwise(second))
    episode_trades = s.select(
        F.explode(
            F.array_compact(F.array(F.when(b != 6, trade(1, F.col("first_ts"), F.to_date("first_ts"))), F.when(b == 2, trade(2, second, late))))
        ).alias("t")
    ).select("t.*")

    def cutoff(n, status, when, code, ends):
        return F.struct(
            "symbol", F.concat("symbol", F.lit(f":{n}")).alias("lifecycle_episode_id"), status.alias("review_status"),
            when.alias("official_publication_timestamp"), code.alias("article_code"), ends.alias("terminal_last_trading_at"),
            F.when(code.isNotNull(), F.concat(F.lit("u/"), code)).alias("official_article_url"),
            F.when(code.isNotNull(), F.sha2(code, 256)).alias("raw_article_sha256"),
            F.when(when.isNotNull(), fv.TERMINATION_DISPOSITION).alias("product_event_disposition"),
        )

    status = (
        F.when(b == 3, fv.ACCEPTED_CUTOFF).when(b == 1, fv.CONFLICTING_CUTOFF).when(b == 0, fv.CURRENT_EPISODE)
        .otherwise(fv.NO_RELIABLE_CUTOFF)
    )
    ends = F.when(b == 3, terminal).when(b == 2, plus_seconds(day, 12 * 86_400))
    cutoffs = s.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~b.isin(4, 9), cutoff(1, status, F.when(b == 3, published), F.when(b == 3, delisting_code), ends)),
                    F.when(b == 2, cutoff(2, F.lit(fv.CURRENT_EPISODE), _none("timestamp"), _none(_TEXT), _none("timestamp"))),
                )
            )
        ).alias("c")
    ).select("c.*")
    reviewed = s.filter(b == 2)
    demoted = F.col("kind") == "ERROR"
    episodes = reviewed.select(
        "symbol", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"), "kind"
    ).select(
        "symbol", "position", F.concat_ws(":", "symbol", F.col("position").cast(_TEXT)).alias("lifecycle_episode_id"),
        F.when((F.col("position") == 1) & ~demoted, listing_code).alias("listing_article_id"),
        _none("timestamp").alias("terminated_at"), _none(_TEXT).alias("termination_basis"),
    )
    rejected = reviewed.filter(demoted).select(
        "symbol", F.lit(1).alias("position"), listing_code.alias("article_id"), F.lit("scheduled").alias("reason")
    )
    return cat.CatalogInputs(archive, snapshot, evidence, trades, episode_trades, cutoffs, episodes, rejected, scope)


SQL_VIEWS["cat"] = (
    "spans",
    f"""SELECT symbol, bucket AS b, kind, first_ts, last_ts, date_trunc('day', first_ts) AS d0,
        CASE WHEN bucket IN (7, 9) THEN 'unresolved' ELSE 'resolved_reviewed_finite_universe' END AS scope_classification_status,
        CASE WHEN symbol = '{BENCHMARK}' THEN 'benchmark_only' WHEN bucket = 8 THEN 'excluded_stablecoin' WHEN bucket = 9 THEN 'unresolved' ELSE 'in_scope_crypto_perpetual' END AS scope_disposition,
        bucket IN (0, 1, 2, 3, 4, 6, 8) AS scope_classification_complete, bucket <= 6 AS present_in_current_exchange_info,
        CASE WHEN bucket <> 6 THEN first_ts END AS eligibility_age_anchor_at,
        CASE WHEN bucket = 0 THEN first_ts + INTERVAL 1 HOUR WHEN bucket = 2 AND kind <> 'ERROR' THEN first_ts - INTERVAL 1 HOUR END AS exact_official_trading_start_at,
        CASE WHEN bucket <= 3 THEN 'l' || symbol END AS listing_article_id,
        CASE WHEN bucket = 0 THEN 'action_symbol_time_anchored' WHEN bucket = 2 AND kind = 'ERROR' THEN 'reviewed_scheduled_time_demoted'
            WHEN bucket = 2 THEN 'reviewed_exact_episode_launch' ELSE 'unresolved' END AS listing_evidence_status,
        CASE WHEN bucket = 0 THEN 'first_observed_trade_precedes_claimed_exact_launch' ELSE 'none' END AS age_anchor_conflict_status,
        CASE WHEN bucket = 0 THEN 'not_applicable_currently_trading' WHEN bucket IN (1, 4) THEN 'conflicting_evidence'
            WHEN bucket = 2 THEN 'resolved_multi_episode_currently_trading' WHEN bucket = 3 THEN 'exact_applicable_announcement_publication'
            ELSE 'official_search_completed_no_reliable_announcement_timestamp' END AS delisting_evidence_state,
        CASE WHEN bucket = 3 THEN last_ts - INTERVAL 5 DAY END AS delisting_announcement_published_at,
        CASE WHEN bucket = 3 THEN last_ts - INTERVAL 4 DAY END AS official_last_trading_at,
        CASE WHEN bucket = 2 THEN 2 WHEN bucket IN (0, 1, 3, 4, 5, 7) THEN 1 ELSE 0 END AS lifecycle_episode_count,
        CASE WHEN bucket IN (0, 2, 3) THEN 'ready' WHEN bucket = 8 THEN 'excluded' ELSE 'blocked' END AS historical_inclusion_readiness,
        CASE WHEN bucket = 0 THEN 'consistent_within_engineering_threshold' WHEN bucket = 2 THEN 'unresolved_material_discrepancy' ELSE 'not_comparable' END AS onboard_start_discrepancy_status,
        CASE WHEN bucket = 0 THEN 3600.0 WHEN bucket = 2 THEN (epoch_us(date_trunc('day', first_ts) + INTERVAL 14 DAY) - epoch_us(first_ts + INTERVAL 1 HOUR)) / 1000000.0 END AS onboard_start_discrepancy_seconds,
        CASE WHEN bucket = 9 THEN 'frontier_daily_only_no_monthly_archive' WHEN bucket IN (7, 8) THEN 'current_status_archive_only'
            WHEN bucket IN (4, 5, 6) THEN 'current_status_SETTLING' END AS current_status_warning
    FROM spans""",
)


def _catalog(v: Views):
    return cat.catalog_merge(_inputs(v))


@query(
    "catalog_merge",
    "symbol scope_classification_status scope_disposition scope_classification_complete present_in_current_exchange_info "
    "t:eligibility_age_anchor_at t:exact_official_trading_start_at listing_article_id listing_evidence_status "
    "age_anchor_conflict_status delisting_evidence_state t:delisting_announcement_published_at t:official_last_trading_at "
    "i:lifecycle_episode_count historical_inclusion_readiness current_status_warning",
    "SELECT * FROM cat", "cat",
)
def _(v: Views):
    return _catalog(v)


@query(
    "onboard_discrepancy", "symbol d:onboard_start_discrepancy_seconds onboard_start_discrepancy_status",
    "SELECT * FROM cat", "cat",
)
def _(v: Views):
    return _catalog(v)


@query(
    "catalog_intervals",
    "symbol lifecycle_episode_id t:age_live_anchor_at t:eligible_from t:last_trading_at t:eligibility_end_at delisting_article_id interval_evidence_status conflict_text",
    """SELECT symbol, symbol || ':1' AS lifecycle_episode_id, first_ts AS age_live_anchor_at, first_ts + INTERVAL 30 DAY AS eligible_from,
        CASE WHEN b = 2 THEN d0 + INTERVAL 12 DAY WHEN b = 3 THEN last_ts - INTERVAL 4 DAY END AS last_trading_at,
        CASE WHEN b = 2 THEN d0 + INTERVAL 12 DAY WHEN b = 3 THEN last_ts - INTERVAL 5 DAY END AS eligibility_end_at,
        CASE WHEN b = 3 THEN 'x' || symbol END AS delisting_article_id, CASE WHEN b IN (1, 4) THEN 'blocked' ELSE 'reviewed_resolved' END AS interval_evidence_status,
        CASE WHEN b = 2 AND kind = 'ERROR' THEN 'scheduled' ELSE '' END AS conflict_text
        FROM cat WHERE lifecycle_episode_count > 0
      UNION ALL SELECT symbol, symbol || ':2', d0 + INTERVAL 14 DAY, d0 + INTERVAL 44 DAY, NULL, NULL, NULL, 'reviewed_resolved', CASE WHEN kind = 'ERROR' THEN 'scheduled' ELSE '' END FROM cat WHERE b = 2""",
    "cat",
)
def _(v: Views):
    return cat.catalog_episodes(_catalog(v)).withColumn("conflict_text", F.concat_ws(",", "conflicts"))


@query(
    "catalog_violations", "symbol finding",
    "SELECT symbol, 'terminal_but_still_trading' AS finding FROM cat WHERE b = 3", "cat",
)
def _(v: Views):
    # Bucket 3 has a reviewed terminal although its snapshot still trades.
    return cat.merge_violations(_inputs(v))


_COVERAGE = {
    "total_archive_discovered_symbols": "true",
    "current_snapshot_symbols": "b <= 6",
    "archive_only_symbols": "b > 6",
    "exact_official_trading_start_coverage": "exact_official_trading_start_at IS NOT NULL",
    "first_observed_trade_anchor_coverage": "b <> 6",
    "unresolved_age_anchor_coverage": "b = 6",
    "exchange_info_onboard_coverage": "b <= 6",
    "exact_official_delisting_announcement_coverage": "b = 3",
    "resolved_scope_classification_coverage": "scope_classification_complete",
    "unresolved_classification_cases": "NOT scope_classification_complete",
    "unresolved_lifecycle_cases": "b IN (1, 4, 5, 6, 7, 9)",
    "historical_inclusion_ready": "b IN (0, 2, 3)",
    "age_anchor_conflicts": "b = 0",
    "matched_listing_article_but_event_time_unresolved": "listing_article_id IS NOT NULL AND exact_official_trading_start_at IS NULL",
    "no_accepted_listing_article": "listing_article_id IS NULL",
    "archive_only_without_exact_delisting_announcement": "b > 6",
    "current_non_trading_without_exact_delisting_announcement": "b IN (4, 5, 6)",
    "delisting_search_completed_no_reliable_timestamp": "b IN (5, 6, 7, 9)",
    "delisting_conflicts": "b IN (1, 4)",
    "stablecoin_classification_unresolved": "b = 9",
    "leveraged_classification_unresolved": "b = 9",
    "leveraged_classification_conflicts": "b = 5",
    "unresolved_onboard_start_discrepancies": "b = 2",
}


@query(
    "coverage_report", " ".join(f"i:{name}" for name in _COVERAGE) + " authorization_ready",
    "SELECT " + ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS {n}" for n, c in _COVERAGE.items())
    + ", false AS authorization_ready FROM cat", "cat",
)
def _(v: Views):
    return cat.catalog_coverage(_catalog(v))


@query(
    "coverage_segments",
    "segment i:symbols i:exact_official_trading_start i:first_observed_trade_anchor i:exact_delisting_announcement i:resolved_scope_classification i:quarantined",
    """SELECT s.segment, count(b) AS symbols, count(CASE WHEN exact_official_trading_start_at IS NOT NULL THEN 1 END) AS exact_official_trading_start,
        count(CASE WHEN b <> 6 THEN 1 END) AS first_observed_trade_anchor, count(CASE WHEN b = 3 THEN 1 END) AS exact_delisting_announcement,
        count(CASE WHEN scope_classification_complete THEN 1 END) AS resolved_scope_classification, count(CASE WHEN b IN (1, 4, 5, 6, 7, 9) THEN 1 END) AS quarantined
        FROM (VALUES ('btc', 99, 99), ('eth', 99, 99), ('active', 0, 3), ('current_retained_non_trading', 4, 6), ('delisted_or_archive_only', 7, 9)) s(segment, lo, hi)
        LEFT JOIN cat ON b BETWEEN lo AND hi GROUP BY 1""",
    "cat",
)
def _(v: Views):
    return cat.coverage_segments(_catalog(v))


@query(
    "readiness_report", "i:candidate_rows i:ready_rows i:catalog_blocker_count i:disagreeing_rows",
    "SELECT count(CASE WHEN b <= 7 THEN 1 END) AS candidate_rows, count(CASE WHEN b IN (0, 2, 3) THEN 1 END) AS ready_rows, "
    "count(CASE WHEN b IN (1, 4, 5, 6, 7) THEN 1 END) AS catalog_blocker_count, 0 AS disagreeing_rows FROM cat", "cat",
)
def _(v: Views):
    return cat.readiness_report(_catalog(v))


@query("readiness_blockers", "symbol", "SELECT symbol FROM cat WHERE b IN (1, 4, 5, 6, 7)", "cat")
def _(v: Views):
    return cat.readiness_blockers(_catalog(v))


@query(
    "unresolved_queue", "symbol historical_inclusion_readiness",
    "SELECT * FROM cat WHERE historical_inclusion_readiness <> 'ready'", "cat",
)
def _(v: Views):
    return cat.unresolved_queue(_catalog(v))


@query(
    "discrepancy_queue", "symbol d:onboard_start_discrepancy_seconds",
    "SELECT * FROM cat WHERE b = 2", "cat",
)
def _(v: Views):
    return cat.discrepancy_queue(_catalog(v))


@query(
    "registry_propose", "symbol lifecycle_episode_id article_code review_status product_event_disposition",
    f"""SELECT symbol, symbol || ':1' AS lifecycle_episode_id, CASE WHEN b = 3 THEN 'x' || symbol END AS article_code,
        CASE WHEN b = 3 THEN '{fv.ACCEPTED_CUTOFF}' WHEN b IN (0, 1) THEN '{fv.CURRENT_EPISODE}' ELSE '{fv.NO_RELIABLE_CUTOFF}' END AS review_status,
        CASE WHEN b = 3 THEN '{fv.TERMINATION_DISPOSITION}' END AS product_event_disposition FROM cat WHERE lifecycle_episode_count > 0
      UNION ALL SELECT symbol, symbol || ':2', NULL, '{fv.CURRENT_EPISODE}', NULL FROM cat WHERE b = 2""",
    "cat",
)
def _(v: Views):
    return rg.propose_cutoffs(cat.catalog_episodes(_catalog(v)))


@query(
    "cutoff_binding_check", "symbol lifecycle_episode_id finding",
    """SELECT symbol, symbol || ':1' AS lifecycle_episode_id, 'hash_differs' AS finding FROM cat WHERE b = 3 AND kind = 'CLICK'
        UNION ALL SELECT symbol, symbol || ':1', 'publication_differs' FROM cat WHERE b = 3 AND kind = 'VIEW'
        UNION ALL SELECT symbol, symbol || ':1', 'terminal_omitted' FROM cat WHERE b = 3 AND kind = 'ERROR'
        UNION ALL SELECT symbol, symbol || ':1', 'not_exactly_one_row' FROM cat WHERE b = 3 AND kind = 'SIGNUP'""",
    "cat",
)
def _(v: Views):
    # Accepted cutoffs with one field changed per event kind.
    inputs, kind = _inputs(v), lambda name: F.col("symbol").startswith(name)
    changed = inputs.cutoffs.withColumns(
        {
            "raw_article_sha256": F.when(kind("CLICK"), F.sha2("symbol", 256)).otherwise(F.col("raw_article_sha256")),
            "official_publication_timestamp": F.when(kind("VIEW"), at("2024-01-01 00:00:00")).otherwise(F.col("official_publication_timestamp")),
            "terminal_last_trading_at": F.when(~kind("ERROR"), F.col("terminal_last_trading_at")),
            "article_code": F.when(kind("SIGNUP"), "gone").otherwise(F.col("article_code")),
        }
    )
    return rg.cutoff_findings(changed, inputs.evidence)


@query(
    "cutoff_registry_check", "symbol lifecycle_episode_id finding",
    """SELECT symbol, symbol || ':1' AS lifecycle_episode_id, 'duplicate_episode' AS finding FROM cat WHERE b = 8
        UNION ALL SELECT symbol, symbol || ':1', 'duplicate_episode' FROM cat WHERE b = 8
        UNION ALL SELECT symbol, symbol || ':1', 'invalid_disposition' FROM cat WHERE b = 7
        UNION ALL SELECT symbol, symbol || ':1', 'accepted_without_cutoff' FROM cat WHERE b = 6""",
    "cat",
)
def _(v: Views):
    cutoffs, spans = _inputs(v).cutoffs, v.spans.select("symbol", "bucket")
    marked = cutoffs.join(spans, "symbol")
    status = F.when(F.col(_B) == 7, "maybe").when(F.col(_B) == 6, fv.ACCEPTED_CUTOFF).otherwise(F.col("review_status"))
    broken = marked.withColumn("review_status", status).unionByName(marked.filter("bucket = 8"))
    return rg.cutoff_registry_findings(broken)


@query(
    "evidence_consistency", "symbol rule",
    """SELECT symbol, 'scope_disagrees' AS rule FROM cat WHERE b = 9
        UNION ALL SELECT symbol, 'archive_bounds_disagree' FROM cat WHERE b IN (0, 3)
        UNION ALL SELECT symbol, 'first_trade_disagrees' FROM cat WHERE b = 5
        UNION ALL SELECT symbol, 'cutoff_without_evidence' FROM cat WHERE b = 3 AND kind = 'CLICK'""",
    "cat",
)
def _(v: Views):
    inputs = _inputs(v)
    bucket = v.spans.select("symbol", "bucket", "kind")
    bounds = inputs.archive.join(bucket, "symbol").withColumn(
        "first_archive_month", F.when(F.col(_B).isin(0, 3), "1999-01").otherwise(F.col("first_archive_month"))
    )
    trades = inputs.first_trades.join(bucket, "symbol").withColumn(
        "earliest_trade_timestamp",
        F.when(F.col(_B) == 5, plus_seconds(F.col("earliest_trade_timestamp"), 1)).otherwise(F.col("earliest_trade_timestamp")),
    )
    evidence = inputs.evidence.filter(~((F.col("event_type") == "delisting") & F.col("symbol").startswith("CLICK")))
    return cat.evidence_consistency(_catalog(v), bounds, inputs.scope, evidence, trades)


def _oracle(v: Views):
    inputs = _inputs(v)
    spans = v.spans.filter("bucket = 2")
    after = F.date_add(F.to_date("first_ts"), 14)
    gaps = spans.select("symbol", after.alias("first_after"))
    seen = spans.filter("kind <> 'ERROR'").select("symbol", after.alias("day"))
    keys = v.spans.filter("bucket <> 9").select("symbol", F.lit("k").alias("object_key"))
    return cat.episode_oracle(inputs.scope, inputs.episodes, inputs.episode_trades, inputs.cutoffs, keys, gaps, seen)


_ORACLE_CONFLICT = """CASE WHEN b = 6 THEN 'missing_or_invalid_verified_first_trade' WHEN b = 4 THEN 'missing_reviewed_delisting_disposition'
    WHEN b = 1 THEN 'unresolved_delisting_evidence' END"""


@query(
    "episode_oracle", "symbol lifecycle_episode_id t:age_live_anchor_at t:last_trading_at t:eligibility_end_at conflict",
    f"""SELECT symbol, symbol || ':1' AS lifecycle_episode_id, eligibility_age_anchor_at AS age_live_anchor_at,
        CASE WHEN b = 2 THEN d0 + INTERVAL 12 DAY WHEN b = 3 THEN last_ts - INTERVAL 4 DAY END AS last_trading_at,
        CASE WHEN b = 2 THEN d0 + INTERVAL 12 DAY WHEN b = 3 THEN last_ts - INTERVAL 5 DAY END AS eligibility_end_at, {_ORACLE_CONFLICT} AS conflict
        FROM cat WHERE b <= 7
      UNION ALL SELECT symbol, symbol || ':2', d0 + INTERVAL 14 DAY, NULL, NULL,
        CASE kind WHEN 'VIEW' THEN 'post_gap_trade_archive_mismatch' WHEN 'ERROR' THEN 'post_gap_boundary_not_observed' END FROM cat WHERE b = 2""",
    "cat",
)
def _(v: Views):
    return _oracle(v)


@query(
    "episode_oracle_diff", "symbol lifecycle_episode_id field expected actual",
    f"""SELECT symbol, symbol || ':1' AS lifecycle_episode_id, f AS field, CASE f WHEN 'anchor_basis' THEN '{fv.ANCHOR_BASIS}' WHEN 'scope_disposition' THEN scope_disposition ELSE 'blocked' END AS expected,
        CAST(NULL AS VARCHAR) AS actual FROM cat, (VALUES ('anchor_basis'), ('scope_disposition'), ('interval_evidence_status')) t(f) WHERE b = 6
      UNION ALL SELECT symbol, symbol || ':2', 'interval_evidence_status', 'blocked', 'reviewed_resolved' FROM cat WHERE b = 2 AND kind IN ('VIEW', 'ERROR')""",
    "cat",
)
def _(v: Views):
    status = F.when(F.col("conflict").isNull(), "reviewed_resolved").otherwise("blocked")
    expected = _oracle(v).withColumn("interval_evidence_status", status)
    return cat.catalog_diff(expected, cat.catalog_episodes(_catalog(v)))
