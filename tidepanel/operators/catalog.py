"""The lifecycle catalog: merge evidence tiers, report coverage, and re-derive it independently."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.timefn import MICROS, micros
from tidepanel.schemas import require_columns

_SNAPSHOT = [
    "base_asset", "quote_asset", "margin_asset", "market_family", "product_family",
    "contract_type", "underlying_type", "underlying_subtype", "is_crypto_underlying",
    "is_stablecoin_underlying", "is_leveraged_token", "stablecoin_evidence_status",
    "stablecoin_conflict_status", "leveraged_evidence_status", "leveraged_conflict_status",
    "scope_classification_status", "scope_classification_provenance", "exchange_info_onboard_at",
    "exchange_info_delivery_at", "latest_known_status", "metadata_acquired_at",
]
_FLAGS = ["is_crypto_underlying", "is_stablecoin_underlying", "is_leveraged_token"]
_STATUSES = ["stablecoin_evidence_status", "leveraged_evidence_status"]
_AGE = 30 * 86_400 * MICROS
_INTERVAL = [
    "symbol", "lifecycle_episode_id", "age_live_anchor_at", "anchor_basis", "eligible_from",
    "listing_article_id", "delisting_announcement_published_at", "delisting_article_id",
    "last_trading_at", "termination_basis", "eligibility_end_at", "interval_evidence_status",
    "conflicts",
]


@dataclass(frozen=True)
class CatalogInputs:
    """Evidence tables; see ``FIXTURES.md`` for their columns. Optional ones may be None.

    ``episodes`` are adjudicated episodes (symbol, position, lifecycle_episode_id,
    listing_article_id, terminated_at, termination_basis); ``rejected`` their rejected listing
    articles (symbol, position, article_id, reason).
    """

    archive: DataFrame
    snapshot: DataFrame
    evidence: DataFrame
    first_trades: DataFrame
    episode_trades: DataFrame
    cutoffs: DataFrame
    episodes: DataFrame
    rejected: DataFrame
    scope: DataFrame | None = None
    search_completed: bool = True


def gather(key: str, sides: Sequence[tuple[str, DataFrame, Sequence[str], bool]]) -> DataFrame:
    """Bring any number of narrow sides of one key together in one shuffle.

    Each side is (name, rows, columns, repeats). Rows become (key, one struct named after the side), all
    are united and grouped once: a side that does not repeat gives its struct or NULL, one that does
    an array of its structs. In place of a chain of joins, whose every side would be shuffled and sorted.
    """
    tagged = [rows.select(key, F.struct(*columns).alias(name)) for name, rows, columns, _ in sides]
    united = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    return united.groupBy(key).agg(
        *[(F.collect_list(name) if repeats else F.any_value(name, True)).alias(name) for name, _, _, repeats in sides]
    )


def _only(matches: Column) -> Column:
    """The single match, or NULL for none and for several."""
    return F.when(F.size(matches) == 1, F.get(matches, F.lit(0)))


def _sides(inputs: CatalogInputs) -> DataFrame:
    """Every side of every archived symbol, with its reviewed episodes folded into ``__adjudicated``.

    What repeats are an instrument's own articles, episodes and cutoffs: a handful each.
    """
    listings = inputs.evidence.filter(F.col("event_type") == "listing").withColumn("accepted", F.col("match_status") == "accepted")
    unclear = inputs.evidence.filter((F.col("event_type") == "delisting") & F.col("match_status").contains("ambiguous"))
    trades = inputs.episode_trades.withColumn("symbol", F.substring_index("lifecycle_episode_id", ":", 1))
    sides = [
        ("arch", inputs.archive, ["first_archive_month", "last_archive_month", "archive_discovery_provenance"], False),
        ("s", inputs.snapshot, _SNAPSHOT, False),
        (
            "listed", listings,
            ["article_code", "article_published_at", "official_event_at", "event_time_evidence_status", "accepted"], True,
        ),
        ("unclear", unclear, ["match_status"], False),
        ("trade", inputs.first_trades, ["earliest_trade_timestamp", "evidence_status"], False),
        (
            "cut", inputs.cutoffs,
            ["lifecycle_episode_id", "review_status", "official_publication_timestamp", "article_code", "terminal_last_trading_at"], True,
        ),
        ("opened", trades, ["lifecycle_episode_id", "earliest_trade_timestamp"], True),
        (
            "episode", inputs.episodes,
            ["position", "lifecycle_episode_id", "listing_article_id", "terminated_at", "termination_basis"], True,
        ),
        ("refused", inputs.rejected, ["position", "article_id", "reason"], True),
    ]
    if inputs.scope is not None:
        columns = ["base_asset", "quote_asset", "product_scope", "scope_audit_status", *_FLAGS, *_STATUSES]
        sides.append(("r", inputs.scope.withColumnRenamed("contract_identity", "symbol"), columns, False))
    sided = gather("symbol", sides).filter("arch IS NOT NULL")
    reasons = F.transform(F.sort_array(F.transform("refused", lambda r: F.struct(r["position"], r["reason"]))), lambda r: r["reason"])
    known = sided.select("*", reasons.alias("reasons"), F.array_sort("episode").alias("episodes"))

    def interval(e: Column) -> Column:
        same = lambda x: x["lifecycle_episode_id"] == e["lifecycle_episode_id"]
        anchor = F.get(F.filter("opened", same), F.lit(0))["earliest_trade_timestamp"]
        cut = F.get(F.filter("cut", same), F.lit(0))
        published, last = cut["official_publication_timestamp"], F.coalesce(e["terminated_at"], cut["terminal_last_trading_at"])
        fields = [
            F.col("symbol"), e["lifecycle_episode_id"], anchor, F.lit(fv.ANCHOR_BASIS), F.timestamp_micros(micros(anchor) + F.lit(_AGE)),
            e["listing_article_id"], published, cut["article_code"], last, e["termination_basis"], F.coalesce(published, last),
            F.lit("reviewed_resolved"), F.col("reasons"),
        ]
        return F.struct(*[f.alias(n) for f, n in zip(fields, _INTERVAL, strict=True)])

    first = F.concat("symbol", F.lit(":1"))
    position = lambda of: lambda e: (e["position"] == 1) & e[of].isNotNull()
    cited = F.get(F.filter("episodes", position("listing_article_id")), F.lit(0))["listing_article_id"]
    demoted = F.get(F.filter("refused", position("article_id")), F.lit(0))["article_id"]
    return known.select(
        "*", F.when(F.size("episodes") > 0, F.transform("episodes", interval)).alias("__adjudicated"),
        _only(F.filter("listed", lambda x: x["accepted"])).alias("l"),
        _only(F.filter("listed", lambda x: x["article_code"] == cited)).alias("a"),
        _only(F.filter("listed", lambda x: x["article_code"] == demoted)).alias("d"),
        F.get(F.filter("cut", lambda x: x["lifecycle_episode_id"] == first), F.lit(0)).alias("c"),
    )


def _scoped_base(inputs: CatalogInputs) -> DataFrame:
    """Archive rows with snapshot, registry (which overrides) and single accepted listing."""
    base = _sides(inputs)
    flags, statuses = _FLAGS, _STATUSES
    reviewed = F.col("r").isNotNull() if inputs.scope is not None else F.lit(False)
    now = F.col("s").isNotNull()

    def override(name: str) -> Column:
        if inputs.scope is None:
            return F.col(f"s.{name}")
        return F.when(reviewed, F.col(f"r.{name}")).otherwise(F.col(f"s.{name}"))

    chosen = {name: override(name) for name in flags}
    for name in statuses:
        chosen[name] = F.when(now | reviewed, override(name)).otherwise(F.lit(fv.UNRESOLVED))
    for name in ("base_asset", "quote_asset"):
        chosen[name] = (
            F.coalesce(F.col(f"r.{name}"), F.col(f"s.{name}")) if inputs.scope is not None
            else F.col(f"s.{name}")
        )
    chosen["quote_asset"] = F.when(
        ~now & chosen["quote_asset"].isNull() & F.col("symbol").endswith(fv.QUOTE_ASSET),
        F.lit(fv.QUOTE_ASSET),
    ).otherwise(chosen["quote_asset"])
    status = F.when(now, F.col("s.scope_classification_status")).otherwise(fv.UNRESOLVED)
    if inputs.scope is not None:
        status = F.when(
            reviewed,
            F.when(F.col("r.scope_audit_status") == "complete", "resolved_reviewed_finite_universe")
            .otherwise(fv.UNRESOLVED),
        ).otherwise(status)
        disposition = F.when(reviewed, F.col("r.product_scope")).otherwise(fv.UNRESOLVED)
        provenance = F.when(reviewed, "candidate_set_bound_historical_scope_registry").otherwise(
            F.col("s.scope_classification_provenance")
        )
    else:
        crypto = F.coalesce("s.is_crypto_underlying", F.lit(False))
        excluded = F.coalesce("s.is_stablecoin_underlying", F.lit(False)) | F.coalesce(
            "s.is_leveraged_token", F.lit(False)
        )
        disposition = F.when(
            now & (F.col("s.scope_classification_status") != fv.UNRESOLVED),
            F.when(F.col("symbol") == fv.BENCHMARK_SYMBOL, fv.BENCHMARK_ONLY)
            .when(crypto & ~excluded, fv.IN_SCOPE)
            .otherwise("excluded"),
        ).otherwise(fv.UNRESOLVED)
        provenance = F.col("s.scope_classification_provenance")
    conflict = {
        name: F.coalesce(F.col(f"s.{name}"), F.lit("none"))
        for name in ("stablecoin_conflict_status", "leveraged_conflict_status")
    }
    plain = [
        "margin_asset", "contract_type", "underlying_type", "underlying_subtype",
        "exchange_info_onboard_at", "exchange_info_delivery_at", "latest_known_status",
        "metadata_acquired_at",
    ]
    c = F.col("c")
    return base.select(
        "symbol", "arch.*",
        now.alias("present_in_current_exchange_info"),
        F.coalesce("s.market_family", F.lit(fv.MARKET_FAMILY)).alias("market_family"),
        F.coalesce("s.product_family", F.lit(fv.PRODUCT_FAMILY)).alias("product_family"),
        *[F.col(f"s.{p}").alias(p) for p in plain],
        *[expr.alias(name) for name, expr in chosen.items()],
        *[expr.alias(name) for name, expr in conflict.items()],
        status.alias("scope_classification_status"),
        provenance.alias("scope_classification_provenance"),
        disposition.alias("scope_disposition"),
        *[
            F.col(side)[field].alias(f"{side}_{name}")
            for side in ("l", "a", "d")
            for field, name in (("article_code", "code"), ("article_published_at", "published"), ("official_event_at", "event"))
        ],
        F.col("l.event_time_evidence_status").alias("l_status"),
        F.col("trade.earliest_trade_timestamp").alias("first_observed_trade_at"),
        F.col("trade.evidence_status").alias("first_observed_trade_evidence_status"),
        F.when(F.col("unclear").isNotNull(), True).alias("__ambiguous"),
        F.when(c.isNotNull(), True).alias("__cutoff"),
        c["review_status"].alias("c_status"), c["official_publication_timestamp"].alias("c_published"),
        c["terminal_last_trading_at"].alias("c_terminal"), c["article_code"].alias("c_code"),
        "__adjudicated",
    )


def _episode_id(col: str = "lifecycle_episode_id") -> Column:
    return F.element_at(F.split(col, ":"), -1).try_cast("bigint")


def adjudicated_intervals(inputs: CatalogInputs) -> DataFrame:
    """Reviewed episodes with their verified anchors and reviewed cutoffs, one row each."""
    trades = inputs.episode_trades.select(
        "lifecycle_episode_id", F.col("earliest_trade_timestamp").alias("age_live_anchor_at")
    )
    cutoffs = inputs.cutoffs.select(
        "lifecycle_episode_id",
        F.lit(True).alias("__reviewed"),
        F.col("official_publication_timestamp").alias("delisting_announcement_published_at"),
        F.col("article_code").alias("delisting_article_id"),
        F.col("terminal_last_trading_at").alias("__terminal"),
    )
    reasons = inputs.rejected.groupBy("symbol").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "reason"))), lambda r: r["reason"]
        ).alias("conflicts")
    )
    joined = (
        inputs.episodes.join(trades, "lifecycle_episode_id", "left")
        .join(cutoffs, "lifecycle_episode_id", "left")
        .join(reasons, "symbol", "left")
    )
    last = F.coalesce("terminated_at", "__terminal")
    return joined.select(
        "symbol",
        "position",
        "lifecycle_episode_id",
        "age_live_anchor_at",
        F.lit(fv.ANCHOR_BASIS).alias("anchor_basis"),
        F.timestamp_micros(micros(F.col("age_live_anchor_at")) + F.lit(_AGE)).alias("eligible_from"),
        "listing_article_id",
        "delisting_announcement_published_at",
        "delisting_article_id",
        last.alias("last_trading_at"),
        "termination_basis",
        F.coalesce("delisting_announcement_published_at", last).alias("eligibility_end_at"),
        F.lit("reviewed_resolved").alias("interval_evidence_status"),
        F.coalesce("conflicts", F.array().cast("array<string>")).alias("conflicts"),
        F.col("__reviewed").isNotNull().alias("has_cutoff"),
    )


def catalog_merge(inputs: CatalogInputs) -> DataFrame:
    """One row per archived instrument with scope, anchors, states, readiness and intervals.

    Precedence: registry over snapshot, adjudicated episodes over single events. All sides are keyed
    by symbol and meet in one shuffle.
    """
    require_columns(
        inputs.archive,
        ["symbol", "first_archive_month", "last_archive_month", "archive_discovery_provenance"],
        "archive observations",
    )
    row = _scoped_base(inputs)
    adjudicated = F.col("__adjudicated").isNotNull()
    first = F.get("__adjudicated", F.lit(0))
    final = F.element_at("__adjudicated", -1)
    episodes = F.size("__adjudicated")
    in_research = F.col("scope_disposition").isin(fv.IN_SCOPE, fv.BENCHMARK_ONLY)
    trading = F.coalesce(
        F.col("present_in_current_exchange_info") & (F.col("latest_known_status") == "TRADING"),
        F.lit(False),
    )
    observed = F.col("first_observed_trade_at")
    has_cutoff = F.col("__cutoff").isNotNull()
    conflicting = F.when(
        has_cutoff, F.col("c_status").eqNullSafe(F.lit(fv.CONFLICTING_CUTOFF))
    ).otherwise(in_research | F.col("__ambiguous").isNotNull())
    excluded = F.col("scope_disposition").startswith("excluded")
    complete = (F.col("scope_classification_status") != fv.UNRESOLVED) & (
        F.coalesce(excluded, F.lit(False))
        | (
            F.col("is_stablecoin_underlying").isNotNull()
            & F.col("is_leveraged_token").isNotNull()
            & (F.col("stablecoin_conflict_status") != "conflict")
            & (F.col("leveraged_conflict_status") != "conflict")
        )
    )
    exact = F.col("c_published").isNotNull()
    searched = F.lit(inputs.search_completed)
    single_state = (
        F.when(conflicting, "conflicting_evidence")
        .when(exact, "exact_applicable_announcement_publication")
        .when(trading, "not_applicable_currently_trading")
        .when(searched, "official_search_completed_no_reliable_announcement_timestamp")
        .otherwise("not_investigated")
    )
    open_end = final["last_trading_at"].isNull()
    many_state = (
        F.when((episodes > 1) & open_end, "resolved_multi_episode_currently_trading")
        .when(episodes > 1, "resolved_multi_episode_terminated")
        .when(~open_end, "reviewed_terminal_episode")
        .otherwise("not_applicable_currently_trading")
    )
    anchor = F.when(adjudicated, first["age_live_anchor_at"]).otherwise(observed)
    claimed_late = ~adjudicated & (observed < F.col("l_event"))
    shaped = row.withColumns(
        {
            "scope_classification_complete": complete,
            "exact_official_trading_start_at": F.when(
                adjudicated & F.col("a_code").isNotNull(), F.col("a_event")
            ).when(adjudicated & F.col("d_code").isNotNull(), F.lit(None)).otherwise(F.col("l_event")),
            "listing_announcement_published_at": F.when(adjudicated, F.coalesce("a_published", "d_published", "l_published"))
            .otherwise(F.col("l_published")),
            "listing_article_id": F.when(adjudicated, F.coalesce("a_code", "d_code", "l_code"))
            .otherwise(F.col("l_code")),
            "listing_evidence_status": F.when(
                adjudicated & F.col("a_code").isNotNull(), "reviewed_exact_episode_launch"
            )
            .when(adjudicated & F.col("d_code").isNotNull(), "reviewed_scheduled_time_demoted")
            .otherwise(F.coalesce("l_status", F.lit(fv.UNRESOLVED))),
            "eligibility_age_anchor_at": anchor,
            "eligibility_age_anchor_basis": F.when(anchor.isNotNull(), fv.ANCHOR_BASIS).otherwise(
                fv.UNRESOLVED
            ),
            "age_anchor_conflict_status": F.when(
                claimed_late, "first_observed_trade_precedes_claimed_exact_launch"
            ).otherwise("none"),
            "delisting_announcement_published_at": F.when(
                adjudicated,
                F.when(
                    final["delisting_article_id"].isNotNull(),
                    final["delisting_announcement_published_at"],
                ),
            ).otherwise(F.col("c_published")),
            "official_last_trading_at": F.when(adjudicated, final["last_trading_at"]).otherwise(
                F.col("c_terminal")
            ),
            "delisting_article_id": F.when(adjudicated, final["delisting_article_id"]).otherwise(
                F.col("c_code")
            ),
            "delisting_evidence_state": F.when(adjudicated, many_state).otherwise(single_state),
            "listing_start_complete": F.when(adjudicated, F.lit(True)).otherwise(anchor.isNotNull()),
            "__delisting_ready": F.when(adjudicated, F.lit(True)).otherwise(
                ~conflicting & (trading | exact | searched)
            ),
            "__trading": trading,
            "__in_research": F.coalesce(in_research, F.lit(False)),
        }
    )
    settled = F.col("listing_start_complete") & F.col("__delisting_ready")
    single = F.struct(
        F.col("symbol"),
        F.concat("symbol", F.lit(":1")).alias("lifecycle_episode_id"),
        F.col("eligibility_age_anchor_at").alias("age_live_anchor_at"),
        F.col("eligibility_age_anchor_basis").alias("anchor_basis"),
        F.timestamp_micros(micros(F.col("eligibility_age_anchor_at")) + F.lit(_AGE)).alias("eligible_from"),
        F.col("listing_article_id"),
        F.col("delisting_announcement_published_at"),
        F.col("delisting_article_id"),
        F.col("official_last_trading_at").alias("last_trading_at"),
        F.when(F.col("official_last_trading_at").isNotNull(), "official_delisting_event").alias("termination_basis"),
        F.coalesce("delisting_announcement_published_at", "official_last_trading_at").alias("eligibility_end_at"),
        F.when(settled, "reviewed_resolved").otherwise("blocked").alias("interval_evidence_status"),
        F.array().cast("array<string>").alias("conflicts"),
    )
    has_single = F.col("__in_research") & F.col("eligibility_age_anchor_at").isNotNull()
    with_intervals = shaped.withColumn(
        "lifecycle_intervals",
        F.when(F.col("__adjudicated").isNotNull(), F.col("__adjudicated"))
        .when(has_single, F.array(single))
        .otherwise(F.filter(F.array(single), lambda i: F.lit(False))),
    )
    count = F.size("lifecycle_intervals")
    official = F.when(
        F.col("present_in_current_exchange_info") & (count > 1),
        F.element_at("lifecycle_intervals", -1)["age_live_anchor_at"],
    ).otherwise(F.col("exact_official_trading_start_at"))
    monthly = ~F.col("archive_discovery_provenance").eqNullSafe(F.lit(fv.FRONTIER_ONLY))
    resolved = F.forall(
        "lifecycle_intervals",
        lambda i: i["interval_evidence_status"].isin("resolved", "reviewed_resolved"),
    )
    ready = (
        F.col("scope_classification_complete") & F.col("__in_research") & monthly & settled
        & (count > 0) & resolved
    )
    seconds, status = onboard_discrepancy(official, F.col("exchange_info_onboard_at"), count)
    return with_intervals.withColumns(
        {
            "onboard_start_discrepancy_seconds": seconds,
            "onboard_start_discrepancy_status": status,
            "current_status_warning": F.when(~monthly, "frontier_daily_only_no_monthly_archive")
            .when(~F.col("__trading"), F.concat(
                F.lit("current_status_"), F.coalesce("latest_known_status", F.lit("archive_only"))
            )),
            "historical_inclusion_readiness": F.when(ready, "ready")
            .when(F.col("scope_classification_complete") & ~F.col("__in_research"), "excluded")
            .otherwise("blocked"),
            "lifecycle_episode_count": count,
            "is_benchmark_btc": F.col("symbol") == fv.BENCHMARK_SYMBOL,
            "is_eth": F.col("symbol") == fv.TAGGED_SYMBOL,
        }
    ).drop(
        "__adjudicated", "__delisting_ready", "__trading", "__in_research", "__cutoff", "__ambiguous",
        "l_code", "l_published", "l_event", "l_status", "c_status", "c_published", "c_terminal",
        "c_code", "a_code", "a_published", "a_event", "d_code", "d_published", "d_event",
    )


def onboard_discrepancy(official: Column, onboard: Column, episodes: Column) -> tuple[Column, Column]:
    """Absolute seconds between official start and snapshot onboarding, and how to read them."""
    seconds = F.abs(micros(official) - micros(onboard)) / F.lit(MICROS)
    status = (
        F.when(seconds.isNull(), "not_comparable")
        .when((episodes > 1) & (seconds <= 3600), "explained_by_reviewed_relisting")
        .when(seconds <= 3600, "consistent_within_engineering_threshold")
        .otherwise("unresolved_material_discrepancy")
    )
    return seconds, status


def merge_violations(inputs: CatalogInputs) -> DataFrame:
    """Evidence that contradicts an adjudication; must be empty before the catalog is used."""
    reviewed = adjudicated_intervals(inputs)
    cited = reviewed.filter("listing_article_id IS NOT NULL").select(
        "symbol", F.col("listing_article_id").alias("article_code")
    ).unionByName(inputs.rejected.select("symbol", F.col("article_id").alias("article_code")))
    listings = inputs.evidence.filter(F.col("event_type") == "listing").groupBy(
        "symbol", "article_code"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("article_semantic_class") == fv.LAUNCH_CLASS).alias("launches"),
    )
    article = cited.distinct().join(listings, ["symbol", "article_code"], "left").select(
        "symbol",
        F.when(~F.col("n").eqNullSafe(F.lit(1)), "article_not_unique")
        .when(F.col("launches") != 1, "article_wrong_semantics")
        .alias("finding"),
    )
    order = Window.partitionBy("symbol").orderBy("position")
    following = F.lead("age_live_anchor_at", 1).over(order)
    per_episode = reviewed.withColumn("__next", following).select(
        "symbol",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("age_live_anchor_at").isNull(), F.lit("no_live_anchor")),
                    F.when(~F.col("has_cutoff"), F.lit("no_reviewed_cutoff")),
                    F.when(
                        F.col("__next").isNotNull() & F.col("last_trading_at").isNull(),
                        F.lit("not_terminated"),
                    ),
                    F.when(F.col("last_trading_at") >= F.col("__next"), F.lit("overlaps_next")),
                )
            )
        ).alias("finding"),
    )
    newest = inputs.episodes.groupBy("symbol").agg(F.max("position").alias("__newest"))
    terminal = (
        inputs.cutoffs.filter(
            (F.col("review_status") == fv.ACCEPTED_CUTOFF) & F.col("terminal_last_trading_at").isNotNull()
        )
        .join(
            inputs.snapshot.filter(F.col("latest_known_status") == "TRADING").select(
                "symbol", "metadata_acquired_at"
            ),
            "symbol",
        )
        .join(newest, "symbol", "left")
        .filter(
            (F.col("metadata_acquired_at") > F.col("terminal_last_trading_at"))
            & (F.coalesce("__newest", F.lit(0)) <= _episode_id())
        )
        .select("symbol", F.lit("terminal_but_still_trading").alias("finding"))
    )
    return article.filter("finding IS NOT NULL").unionByName(per_episode).unionByName(terminal)


# --- reports -----------------------------------------------------------------------------------


def _coverage_terms() -> dict[str, Column]:
    def is_(name: str, value: str) -> Column:
        return F.coalesce(F.col(name) == value, F.lit(False))

    quote = is_("quote_asset", fv.QUOTE_ASSET) | F.col("symbol").endswith(fv.QUOTE_ASSET)
    current = F.coalesce("present_in_current_exchange_info", F.lit(False))
    potential = quote & F.coalesce(
        F.col("scope_disposition").isin(fv.IN_SCOPE, fv.BENCHMARK_ONLY, fv.UNRESOLVED), F.lit(False)
    )
    trading = is_("latest_known_status", "TRADING")
    return {
        "quote": quote,
        "current": current,
        "resolved": F.coalesce("scope_classification_complete", F.lit(False)),
        "listed": F.col("exact_official_trading_start_at").isNotNull(),
        "observed": is_("eligibility_age_anchor_basis", fv.ANCHOR_BASIS),
        "legacy": is_("eligibility_age_anchor_basis", fv.LEGACY_ANCHOR_BASIS),
        "unanchored": is_("eligibility_age_anchor_basis", fv.UNRESOLVED),
        "published": F.col("delisting_announcement_published_at").isNotNull(),
        "ended": F.col("official_last_trading_at").isNotNull(),
        "potential": potential,
        "blocked": potential & is_("historical_inclusion_readiness", "blocked"),
        "ready": potential & is_("historical_inclusion_readiness", "ready"),
        "active": quote & current & trading,
        "retained": quote & current & ~trading,
        "archived": quote & ~current,
    }


def catalog_coverage(catalog: DataFrame) -> DataFrame:
    """Infrastructure coverage counts in one row; one pass over the catalog."""
    t = _coverage_terms()

    def state(value: str) -> Column:
        return F.coalesce(F.col("delisting_evidence_state") == value, F.lit(False))

    def conflict(name: str) -> Column:
        return F.coalesce(F.col(name) == "conflict", F.lit(False))

    counts = {
        "total_archive_discovered_symbols": F.lit(True),
        "total_usdt_candidate_symbols": t["quote"],
        "current_snapshot_symbols": t["quote"] & t["current"],
        "archive_only_symbols": t["archived"],
        "exact_official_trading_start_coverage": t["quote"] & t["listed"],
        "first_observed_trade_anchor_coverage": t["quote"] & t["observed"],
        "legacy_pre_research_start_adjudicated_coverage": t["quote"] & t["legacy"],
        "unresolved_age_anchor_coverage": t["potential"] & t["unanchored"],
        "exchange_info_onboard_coverage": t["quote"] & F.col("exchange_info_onboard_at").isNotNull(),
        "exact_official_delisting_announcement_coverage": t["quote"] & t["published"],
        "exact_official_last_trading_coverage": t["quote"] & t["ended"],
        "resolved_scope_classification_coverage": t["quote"] & t["resolved"],
        "unresolved_classification_cases": t["quote"] & ~t["resolved"],
        "unresolved_lifecycle_cases": t["blocked"],
        "historical_inclusion_ready": t["ready"],
        "usdt_missing_exact_official_trading_start": t["quote"] & ~t["listed"],
        "age_anchor_conflicts": t["potential"] & ~F.col("age_anchor_conflict_status").eqNullSafe(F.lit("none")),
        "matched_listing_article_but_event_time_unresolved": F.col("listing_article_id").isNotNull() & ~t["listed"],
        "no_accepted_listing_article": F.col("listing_article_id").isNull(),
        "archive_only_without_exact_delisting_announcement": t["archived"] & ~t["published"],
        "current_non_trading_without_exact_delisting_announcement": t["retained"] & ~t["published"],
        "delisting_search_completed_no_reliable_timestamp": t["potential"]
        & state("official_search_completed_no_reliable_announcement_timestamp"),
        "delisting_search_incomplete": t["potential"] & state("not_investigated"),
        "delisting_conflicts": t["potential"] & state("conflicting_evidence"),
        "stablecoin_classification_unresolved": t["quote"] & F.col("is_stablecoin_underlying").isNull(),
        "leveraged_classification_unresolved": t["quote"] & F.col("is_leveraged_token").isNull(),
        "stablecoin_classification_conflicts": t["quote"] & conflict("stablecoin_conflict_status"),
        "leveraged_classification_conflicts": t["quote"] & conflict("leveraged_conflict_status"),
        "unresolved_onboard_start_discrepancies": t["quote"]
        & (F.col("onboard_start_discrepancy_status") == "unresolved_material_discrepancy"),
    }
    return catalog.agg(*[F.count_if(flag).alias(name) for name, flag in counts.items()]).withColumn(
        "authorization_ready", F.col("unresolved_lifecycle_cases") == 0
    )


def coverage_segments(catalog: DataFrame) -> DataFrame:
    """Seven counts for each of five overlapping segments; empty segments are reported as zeros.

    Rows are tagged with all their segments and aggregated once. The fixed list of segment names is
    joined in so that a segment without rows still appears.
    """
    t = _coverage_terms()
    segments = {
        "btc": F.col("is_benchmark_btc"),
        "eth": F.col("is_eth"),
        "active": t["active"],
        "current_retained_non_trading": t["retained"],
        "delisted_or_archive_only": t["archived"],
    }
    tags = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in segments.items()]))
    names = F.explode(F.array(*[F.lit(name) for name in segments]))
    counted = (
        catalog.select(
            F.explode(tags).alias("segment"),
            *[t[k].alias(f"__{k}") for k in ("listed", "observed", "legacy", "published", "resolved", "blocked")],
        )
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("symbols"),
            F.count_if("__listed").alias("exact_official_trading_start"),
            F.count_if("__observed").alias("first_observed_trade_anchor"),
            F.count_if("__legacy").alias("legacy_adjudicated_anchor"),
            F.count_if("__published").alias("exact_delisting_announcement"),
            F.count_if("__resolved").alias("resolved_scope_classification"),
            F.count_if("__blocked").alias("quarantined"),
        )
    )
    listed = catalog.sparkSession.range(1).select(names.alias("segment"))
    joined = listed.join(counted, "segment", "left")
    return joined.na.fill(0, [c for c in counted.columns if c != "segment"])


def derived_ready() -> Column:
    """Row readiness re-derived from primitive lifecycle fields."""
    rule = (
        F.col("scope_disposition").isin(fv.IN_SCOPE, fv.BENCHMARK_ONLY)
        & F.col("scope_classification_complete")
        & F.col("eligibility_age_anchor_at").isNotNull()
        & (F.col("eligibility_age_anchor_basis") != fv.UNRESOLVED)
        & F.col("delisting_evidence_state").isin(fv.READY_DELISTING_STATES)
    )
    return F.coalesce(rule, F.lit(False))


def readiness_report(catalog: DataFrame) -> DataFrame:
    """Candidate, ready and blocked counts, and rows whose stored flag disagrees."""
    scoped = F.coalesce(F.col("scope_disposition").isin(fv.IN_SCOPE, fv.BENCHMARK_ONLY), F.lit(False))
    stored = F.coalesce(F.col("historical_inclusion_readiness") == "ready", F.lit(False))
    ready = derived_ready()
    return catalog.agg(
        F.count_if(scoped).alias("candidate_rows"),
        F.count_if(ready).alias("ready_rows"),
        F.count_if(scoped & ~ready).alias("catalog_blocker_count"),
        F.count_if(stored != ready).alias("disagreeing_rows"),
    )


def readiness_blockers(catalog: DataFrame) -> DataFrame:
    """Blocked in-scope symbols, as rows (never as one list)."""
    scoped = F.col("scope_disposition").isin(fv.IN_SCOPE, fv.BENCHMARK_ONLY)
    return catalog.filter(scoped & ~derived_ready()).select("symbol")


def unresolved_queue(catalog: DataFrame) -> DataFrame:
    return catalog.filter(~F.col("historical_inclusion_readiness").eqNullSafe(F.lit("ready")))


def discrepancy_queue(catalog: DataFrame) -> DataFrame:
    return catalog.filter(
        F.col("onboard_start_discrepancy_status") == "unresolved_material_discrepancy"
    ).select(
        "symbol", "exact_official_trading_start_at", "exchange_info_onboard_at",
        "listing_article_id", "onboard_start_discrepancy_seconds",
    )


# --- independent derivation and comparison -------------------------------------------------------


def episode_oracle(
    scope: DataFrame, episodes: DataFrame, episode_trades: DataFrame, cutoffs: DataFrame,
    archive_keys: DataFrame, gap_evidence: DataFrame, presence: DataFrame,
) -> DataFrame:
    """Expected episodes from primitives only; shares no plan with ``catalog_merge``.

    archive_keys  (symbol, object_key) observed monthly keys
    gap_evidence  (symbol, first_after) reviewed first day after a gap
    presence      (symbol, day) observed trading days
    episode_trades additionally has (symbol, archive_date, published_sha256, computed_sha256,
    evidence_status, is_primitive_verified)
    """
    wanted = scope.filter(F.col("product_scope").isin(fv.IN_SCOPE, fv.BENCHMARK_ONLY)).select(
        F.col("contract_identity").alias("symbol"), F.col("product_scope").alias("scope_disposition")
    )
    specs = wanted.join(
        episodes.select("symbol", "position", "lifecycle_episode_id", "terminated_at"), "symbol", "left"
    ).withColumns(
        {
            "position": F.coalesce("position", F.lit(1)),
            "lifecycle_episode_id": F.coalesce("lifecycle_episode_id", F.concat("symbol", F.lit(":1"))),
        }
    )
    trades = episode_trades.select(
        "lifecycle_episode_id",
        F.lit(True).alias("__trade"),
        F.col("symbol").alias("t_symbol"),
        F.col("earliest_trade_timestamp").alias("t_at"),
        F.col("archive_date").alias("t_date"),
        (F.col("published_sha256") == F.col("computed_sha256")).alias("t_same_hash"),
        F.col("evidence_status").alias("t_status"),
        F.col("is_primitive_verified").alias("t_primitive"),
    )
    reviews = cutoffs.select(
        "lifecycle_episode_id",
        F.lit(True).alias("__cutoff"),
        F.col("review_status").alias("c_status"),
        F.col("official_publication_timestamp").alias("c_published"),
        F.col("article_code").alias("c_code"),
        F.col("terminal_last_trading_at").alias("c_terminal"),
    )
    archived = archive_keys.select("symbol").distinct().withColumn("__archived", F.lit(True))
    seen = gap_evidence.join(
        presence.select("symbol", F.col("day").alias("first_after")), ["symbol", "first_after"], "left_semi"
    ).select("symbol", F.lit(True).alias("__boundary_seen"))
    joined = (
        specs.join(trades, "lifecycle_episode_id", "left")
        .join(reviews, "lifecycle_episode_id", "left")
        .join(archived, "symbol", "left")
        .join(gap_evidence.select("symbol", "first_after"), "symbol", "left")
        .join(seen.distinct(), "symbol", "left")
    )
    verified = (
        (F.col("t_symbol") == F.col("symbol"))
        & F.col("t_same_hash")
        & (F.col("t_status") == fv.TRADE_EVIDENCE_STATUS)
    )
    later = F.col("position") > 1
    conflict = F.coalesce(
        F.when(~F.coalesce(verified, F.lit(False)), F.lit("missing_or_invalid_verified_first_trade")),
        F.when(
            ~F.coalesce(F.col("t_primitive"), F.lit(False)),
            F.lit("episode_trade_primitive_verification_failed"),
        ),
        F.when(F.col("__archived").isNull(), F.lit("missing_monthly_archive_observation")),
        F.when(F.col("__cutoff").isNull(), F.lit("missing_reviewed_delisting_disposition")),
        F.when(F.col("c_status") == fv.CONFLICTING_CUTOFF, F.lit("unresolved_delisting_evidence")),
        F.when(
            later & ~F.coalesce(F.col("t_date") == F.col("first_after"), F.lit(False)),
            F.lit("post_gap_trade_archive_mismatch"),
        ),
        F.when(later & F.col("__boundary_seen").isNull(), F.lit("post_gap_boundary_not_observed")),
    )
    terminal = F.coalesce("terminated_at", "c_terminal")
    return joined.select(
        "symbol",
        "scope_disposition",
        "lifecycle_episode_id",
        F.col("t_at").alias("age_live_anchor_at"),
        F.lit(fv.ANCHOR_BASIS).alias("anchor_basis"),
        F.timestamp_micros(micros(F.col("t_at")) + F.lit(_AGE)).alias("eligible_from"),
        F.col("c_published").alias("delisting_announcement_published_at"),
        F.col("c_code").alias("delisting_article_id"),
        terminal.alias("last_trading_at"),
        F.coalesce("c_published", terminal).alias("eligibility_end_at"),
        conflict.alias("conflict"),
    )


EPISODE_FIELDS = [
    "age_live_anchor_at", "anchor_basis", "eligible_from", "delisting_announcement_published_at",
    "delisting_article_id", "last_trading_at", "eligibility_end_at", "interval_evidence_status",
    "scope_disposition",
]


def catalog_episodes(catalog: DataFrame) -> DataFrame:
    """Catalog intervals as rows with the catalog fields an episode is compared on."""
    return catalog.select(
        "scope_disposition",
        "historical_inclusion_readiness",
        "present_in_current_exchange_info",
        "latest_known_status",
        F.col("lifecycle_episode_count").alias("episode_count"),
        F.posexplode("lifecycle_intervals").alias("position", "i"),
    ).select(
        "scope_disposition", "historical_inclusion_readiness", "present_in_current_exchange_info",
        "latest_known_status", "episode_count", (F.col("position") + 1).alias("position"), "i.*",
    )


def catalog_diff(expected: DataFrame, actual: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Field-by-field differences of episodes as (symbol, episode, field, expected, actual).

    Episodes present on one side only appear with every field that is not NULL on the other.
    """
    fields = fields or EPISODE_FIELDS
    keys = ["symbol", "lifecycle_episode_id"]

    def as_text(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}").cast("string")

    left = expected.select(*keys, F.struct(*fields).alias("e"))
    right = actual.select(*keys, F.struct(*fields).alias("a"))
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("field"),
                    as_text("e", name).alias("expected"),
                    as_text("a", name).alias("actual"),
                )
                for name in fields
            ]
        )
    )
    both = left.join(right, keys, "full_outer").select(*keys, pairs.alias("d")).select(*keys, "d.*")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def evidence_consistency(
    catalog: DataFrame, bounds: DataFrame, scope: DataFrame, evidence: DataFrame, trades: DataFrame
) -> DataFrame:
    """Catalog fields that disagree with the evidence they were derived from: (symbol, rule)."""
    accepted = evidence.filter(
        F.col("match_status").isin("accepted", "ambiguous_multiple_applicable_articles")
    )
    listing = accepted.filter(F.col("event_type") == "listing").groupBy(
        "symbol",
        F.col("article_code").alias("listing_article_id"),
        F.col("official_event_at").alias("exact_official_trading_start_at"),
    ).agg(F.count(F.lit(1)).alias("__listings"))
    delisting = accepted.filter(F.col("event_type") == "delisting").groupBy(
        "symbol",
        F.col("article_code").alias("delisting_article_id"),
        F.col("article_published_at").alias("delisting_announcement_published_at"),
    ).agg(F.count(F.lit(1)).alias("__delistings"))
    joined = (
        catalog.join(
            bounds.select(
                "symbol", F.col("first_archive_month").alias("__first"), F.col("last_archive_month").alias("__last")
            ),
            "symbol", "left",
        )
        .join(
            scope.select(
                F.col("contract_identity").alias("symbol"),
                F.col("product_scope").alias("__scope"),
                *[
                    F.col(c).alias(f"__{c}")
                    for c in ("is_crypto_underlying", "is_stablecoin_underlying", "is_leveraged_token")
                ],
                F.lit(True).alias("__registered"),
            ),
            "symbol", "left",
        )
        .join(
            trades.select("symbol", F.col("earliest_trade_timestamp").alias("__traded")), "symbol", "left"
        )
        .join(listing, ["symbol", "listing_article_id", "exact_official_trading_start_at"], "left")
        .join(delisting, ["symbol", "delisting_article_id", "delisting_announcement_published_at"], "left")
    )
    frontier = F.col("archive_discovery_provenance").eqNullSafe(F.lit(fv.FRONTIER_ONLY))
    same_scope = F.col("scope_disposition").eqNullSafe(F.col("__scope"))
    for name in ("is_crypto_underlying", "is_stablecoin_underlying", "is_leveraged_token"):
        same_scope = same_scope & F.col(name).eqNullSafe(F.col(f"__{name}"))
    anchor_ok = F.col("eligibility_age_anchor_at").eqNullSafe(F.col("first_observed_trade_at"))
    rules = F.array_compact(
        F.array(
            F.when(F.col("__registered").isNull() | ~same_scope, F.lit("scope_disagrees")),
            F.when(
                frontier & (F.col("historical_inclusion_readiness") != "blocked"),
                F.lit("frontier_not_blocked"),
            ),
            F.when(
                ~frontier
                & ~(
                    F.col("first_archive_month").eqNullSafe(F.col("__first"))
                    & F.col("last_archive_month").eqNullSafe(F.col("__last"))
                ),
                F.lit("archive_bounds_disagree"),
            ),
            F.when(
                F.col("first_observed_trade_at").isNotNull()
                & ~F.col("first_observed_trade_at").eqNullSafe(F.col("__traded")),
                F.lit("first_trade_disagrees"),
            ),
            F.when(
                (F.col("eligibility_age_anchor_basis") == fv.ANCHOR_BASIS) & ~anchor_ok,
                F.lit("anchor_not_primitive"),
            ),
            F.when(
                F.col("exact_official_trading_start_at").isNotNull()
                & ~F.col("__listings").eqNullSafe(F.lit(1)),
                F.lit("listing_without_evidence"),
            ),
            F.when(
                F.col("delisting_announcement_published_at").isNotNull()
                & ~F.col("__delistings").eqNullSafe(F.lit(1)),
                F.lit("cutoff_without_evidence"),
            ),
        )
    )
    return joined.select("symbol", F.explode(rules).alias("rule"))
