"""Scope, eligibility, gaps, presence, planning and registries over derived instrument tables."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.identity import (
    identity_path,
    is_canonical_text,
    is_distinct_token_list,
    is_semantic_identity,
    is_symbol_identity,
    is_tag_list,
    is_token,
)
from tidepanel.functions.keys import daily_bar_key, monthly_bar_key, parse_object_key
from tidepanel.functions.text import char_class
from tidepanel.functions.timefn import (
    age_days,
    floor_to,
    is_utc_day_text,
    is_utc_instant_text,
    last_completed_month,
    period_bounds,
    plus_seconds,
)
from tidepanel.operators import gaps as gp
from tidepanel.operators import pages as pg
from tidepanel.operators import planning as pl
from tidepanel.operators import registry as rg
from tidepanel.operators import scope as sc
from tidepanel.operators.eligibility import apply_eligibility
from tidepanel.operators.numbering import with_row_number
from tidepanel.operators.presence import presence_findings
from tidepanel.workload.registry import query
from tidepanel.workload.views import BENCHMARK, SQL_VIEWS, TAGGED, Views, at, order_symbol

# --- scope -------------------------------------------------------------------------------------------

SQL_VIEWS["scope_votes"] = (
    "instruments",
    """SELECT *, base || suffix AS symbol,
        CASE WHEN ok AND stable_tag AND stable_review = false THEN true ELSE false END AS stable_conflict,
        CASE WHEN ok AND lever_tag AND lever_review = false THEN true ELSE false END AS lever_conflict,
        CASE WHEN ok AND stable_tag THEN CASE WHEN stable_review = false THEN NULL ELSE true END ELSE stable_review END AS stable,
        CASE WHEN ok AND lever_tag THEN CASE WHEN lever_review = false THEN NULL ELSE true END ELSE lever_review END AS lever
    FROM instruments""",
)


def _classified(v: Views):
    return sc.classify_scope(v.instruments, v.scope_reviews)


@query(
    "scope_classify",
    "symbol is_crypto_underlying is_stablecoin_underlying is_leveraged_token stablecoin_evidence_status "
    "stablecoin_conflict_status leveraged_evidence_status leveraged_conflict_status scope_classification_status",
    """SELECT symbol, CASE WHEN ok THEN true END AS is_crypto_underlying,
        CASE WHEN ok THEN stable END AS is_stablecoin_underlying, CASE WHEN ok THEN lever END AS is_leveraged_token,
        CASE WHEN NOT ok THEN 'unresolved_invalid_identity' WHEN stable_conflict THEN 'conflicting_affirmative_evidence'
            WHEN stable_review IS NOT NULL THEN 'accepted_reviewed_evidence'
            WHEN stable_tag THEN 'affirmative_exchange_info_subtype'
            ELSE 'unresolved_no_affirmative_negative_evidence' END AS stablecoin_evidence_status,
        CASE WHEN stable_conflict THEN 'conflict' ELSE 'none' END AS stablecoin_conflict_status,
        CASE WHEN NOT ok THEN 'unresolved_invalid_identity' WHEN lever_conflict THEN 'conflicting_affirmative_evidence'
            WHEN lever_review IS NOT NULL THEN 'accepted_reviewed_evidence'
            WHEN lever_tag THEN 'affirmative_exchange_info_subtype'
            ELSE 'unresolved_no_affirmative_negative_evidence' END AS leveraged_evidence_status,
        CASE WHEN lever_conflict THEN 'conflict' ELSE 'none' END AS leveraged_conflict_status,
        CASE WHEN ok AND stable IS NOT NULL AND lever IS NOT NULL THEN 'resolved_reviewed_evidence' ELSE 'unresolved' END AS scope_classification_status
        FROM scope_votes""",
    "scope_votes",
)
def _(v: Views):
    return _classified(v)


@query(
    "scope_filter", "symbol base_asset",
    "SELECT symbol, base AS base_asset FROM scope_votes WHERE ok AND stable = false AND lever = false",
    "scope_votes",
)
def _(v: Views):
    return sc.filter_scope(_classified(v))


@query(
    "semi_scope", "symbol t:open_time d:close",
    "SELECT symbol, open_time, close FROM bars_4h_wide SEMI JOIN (SELECT * FROM contracts WHERE scoped) USING (symbol)",
    "bars_4h_wide contracts",
)
def _(v: Views):
    return sc.semi_scope(v.bars_4h_wide, sc.filter_scope(v.contracts))


@query(
    "ready_universe", "symbol",
    "SELECT symbol FROM contracts JOIN spans USING (symbol) WHERE scoped AND n >= 150 * (SELECT count(*) FROM events) / 10000",
    "contracts spans",
)
def _(v: Views):
    total = v.table("events").count()
    busy = v.spans.select("symbol", F.when(F.col("n") >= 150 * total / 10000, "ready").otherwise("blocked").alias("historical_inclusion_readiness"))
    return sc.ready_universe(v.contracts.join(busy, "symbol"))


@query(
    "unknown_identities", "symbol",
    "SELECT DISTINCT symbol FROM bars_4h_wide WHERE symbol NOT IN (SELECT symbol FROM contracts WHERE status <> 'unresolved')",
    "bars_4h_wide contracts",
)
def _(v: Views):
    known = v.contracts.filter(F.col("scope_classification_status") != "unresolved")
    return sc.unknown_identities(v.bars_4h_wide, known)


# Every piece of a page is an identity to judge: its URL, what stands between tags or quotes, and each word.
_PIECES, _WORDS = r'[<>"]+', r'[<>"\s]+'
_LOWER = "abcdefghijklmnopqrstuvwxyz"


@query(
    "identity_rules", "i:page_id t token semantic symbolic canonical path",
    f"""SELECT page_id, t, regexp_full_match(t, '[A-Z0-9]{{1,64}}') AS token,
        regexp_full_match(t, '[^/\\\\:\\p{{C}}]{{1,128}}') AND trim(t) = t AND t <> '' AS semantic,
        CASE WHEN regexp_full_match(t, '[\\x00-\\x7F]*') THEN regexp_full_match(t, '[A-Z0-9]{{1,64}}')
            ELSE regexp_full_match(t, '[\\p{{L}}\\p{{N}}]{{1,128}}') END AS symbolic,
        regexp_full_match(t, '[\\x21-\\x7E]([\\x20-\\x7E]*[\\x21-\\x7E])?') AS canonical,
        CASE WHEN regexp_full_match(t, '[^/\\\\:\\p{{C}}]{{1,128}}') AND trim(t) = t AND t <> '' THEN 'identity_' || sha256(t) END AS path
        FROM (SELECT DISTINCT page_id, CASE WHEN page_id % 4 = 0 THEN translate(x, '{_LOWER}', '{_LOWER.upper()}') ELSE x END AS t FROM (
            SELECT page_id, unnest(list_concat([url], string_split_regex(html, '{_PIECES}'), string_split_regex(html, '{_WORDS}'))) AS x FROM pages))""",
)
def _(v: Views):
    pieces = F.concat(F.array("url"), F.split("html", _PIECES), F.split("html", _WORDS))
    text = F.explode(F.array_distinct(pieces)).alias("x")
    c = F.col("t")
    listed = v.table("pages").select("page_id", text).select(
        "page_id", F.when(F.col("page_id") % 4 == 0, F.translate("x", _LOWER, _LOWER.upper())).otherwise(F.col("x")).alias("t")
    ).distinct()
    return listed.withColumns(
        {
            "token": is_token(c), "semantic": is_semantic_identity(c), "symbolic": is_symbol_identity(c),
            "canonical": is_canonical_text(c), "path": identity_path(c),
        }
    )


@query(
    "identity_tag_list", "i:doc_id i:words tags_ok tokens_ok distinct_ok",
    """SELECT doc_id, len(l) AS words, len(l) > 0 AND coalesce(list_bool_and(list_transform(l, lambda x: regexp_full_match(x, '[\\x21-\\x7E]([\\x20-\\x7E]*[\\x21-\\x7E])?'))), true) AS tags_ok,
        len(l) > 0 AND len(list_distinct(u)) = len(u) AND coalesce(list_bool_and(list_transform(u, lambda x: regexp_full_match(x, '[A-Z0-9]{1,64}'))), true) AS tokens_ok,
        len(l) > 0 AND coalesce(list_bool_and(list_transform(u, lambda x: regexp_full_match(x, '[A-Z0-9]{1,64}'))), true) AS distinct_ok
        FROM (SELECT doc_id, l, list_transform(l, lambda x: upper(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))) AS u
            FROM (SELECT doc_id, string_split_regex(text, '[ \\n]') AS l FROM documents))""",
)
def _(v: Views):
    # The words of the whole text as a list; repeats make it no list of distinct tokens.
    # Both lists are columns of their own, so that each is made once and not for every rule.
    bare = F.upper(F.regexp_replace("text", char_class(f"{string.ascii_letters}{string.digits} \n", other=True) + "+", ""))
    lists = v.table("documents").select("doc_id", F.split("text", r"[ \n]").alias("l"), F.split(bare, r"[ \n]").alias("u"))
    return lists.withColumn("d", F.array_distinct("u")).select(
        "doc_id", F.size("l").alias("words"), is_tag_list(F.col("l")).alias("tags_ok"),
        is_distinct_token_list(F.col("u")).alias("tokens_ok"), is_distinct_token_list(F.col("d")).alias("distinct_ok"),
    )


# --- eligibility -------------------------------------------------------------------------------------

_ELIGIBLE = """
    SELECT b.symbol, b.open_time, i.episode AS selected_lifecycle_episode_id,
        (epoch_us(close_time) - epoch_us(i.start_at)) / 86400000000.0 AS contract_age_days,
        coalesce(c.status <> 'unresolved' AND b.symbol <> '{bench}' AND close_time - i.start_at >= INTERVAL 5 DAY
            AND (c.announced IS NULL OR close_time < c.announced)
            AND (i.end_at IS NULL OR close_time < i.end_at), false) AS is_eligible,
        b.symbol = '{tag}' AS is_eth, b.symbol = '{bench}' AS is_benchmark
    FROM bars_4h_wide b LEFT JOIN contracts c USING (symbol)
    LEFT JOIN intervals i ON i.symbol = b.symbol AND close_time >= i.start_at
        AND (i.last_at IS NULL OR close_time <= i.last_at) AND (i.end_at IS NULL OR close_time < i.end_at)
""".format(bench=BENCHMARK, tag=TAGGED)


@query(
    "eligibility_pit",
    "symbol t:open_time selected_lifecycle_episode_id d:contract_age_days is_eligible is_eth is_benchmark",
    _ELIGIBLE, "bars_4h_wide contracts intervals",
)
def _(v: Views):
    contracts = v.contracts.join(v.intervals, "symbol")
    return apply_eligibility(v.bars_4h_wide, contracts, 5, benchmark=BENCHMARK, tagged=TAGGED)


@query(
    "lookup_asof_cutoff", "symbol t:open_time before_cutoff",
    "SELECT symbol, open_time, coalesce(close_time < announced, true) AS before_cutoff FROM bars_4h_wide LEFT JOIN contracts USING (symbol)",
    "bars_4h_wide contracts",
)
def _(v: Views):
    # Contracts without intervals, no age limit: eligibility reduces to the publication cutoff.
    contracts = v.contracts.withColumn("scope_classification_status", F.lit("resolved"))
    done = apply_eligibility(v.bars_4h_wide, contracts, 0, benchmark="NONE", tagged=TAGGED)
    return done.withColumn("before_cutoff", F.col("is_eligible") | (F.col("contract_age_days") < 0))


@query(
    "age_days", "symbol t:open_time d:age",
    "SELECT symbol, open_time, (epoch_us(close_time) - epoch_us(anchor)) / 86400000000.0 AS age FROM bars_4h_wide JOIN contracts USING (symbol)",
    "bars_4h_wide contracts",
)
def _(v: Views):
    joined = v.bars_4h_wide.join(v.contracts.select("symbol", "eligibility_age_anchor_at"), "symbol")
    return joined.withColumn("age", age_days(F.col("close_time"), F.col("eligibility_age_anchor_at")))


# --- gaps --------------------------------------------------------------------------------------------

_LO, _HI = "TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-01-31'"


@query(
    "gap_classify", "symbol kind t:gap_start t:gap_end",
    f"""WITH e AS (SELECT DISTINCT symbol FROM user_hours UNION ALL SELECT n_name FROM nation),
        b AS (SELECT symbol, min(open_time) AS lo, max(open_time) AS hi FROM user_hours GROUP BY 1)
      SELECT symbol, 'unexplained_missing_planned_archive' AS kind, {_LO} AS gap_start, {_HI} AS gap_end FROM e WHERE symbol NOT IN (SELECT symbol FROM b)
      UNION ALL SELECT symbol, 'leading_source_gap', {_LO}, lo FROM b WHERE lo > {_LO}
      UNION ALL SELECT symbol, 'trailing_source_gap', hi + INTERVAL 1 HOUR, {_HI} FROM b WHERE hi + INTERVAL 1 HOUR < {_HI}
      UNION ALL SELECT symbol, 'interior_source_gap', p + INTERVAL 1 HOUR, open_time FROM (
        SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS p FROM user_hours)
        WHERE open_time - p > INTERVAL 1 HOUR""",
    "user_hours",
)
def _(v: Views):
    names = v.user_hours.select("symbol").distinct().unionByName(
        v.table("nation").select(F.col("n_name").alias("symbol"))
    )
    expected = names.withColumns({"range_start": at("2024-01-01 00:00:00"), "range_end": at("2024-01-31 00:00:00")})
    return gp.classify_gaps(v.user_hours, expected)


# Active ranges of users: two stretches, the second open, clipped to the window.
SQL_VIEWS["user_ranges"] = (
    "user_hours",
    f"""SELECT * FROM (
        SELECT symbol, symbol || ':1' AS episode, {_LO} + INTERVAL 2 DAY AS range_start, {_LO} + INTERVAL 10 DAY + INTERVAL 5 HOUR AS range_end FROM (SELECT DISTINCT symbol FROM user_hours)
        UNION ALL SELECT symbol, symbol || ':2', {_LO} + INTERVAL 12 DAY + INTERVAL 6 HOUR, {_HI} - INTERVAL 1 DAY FROM (SELECT DISTINCT symbol FROM user_hours))""",
)


def _user_catalog(v: Views):
    first = at("2023-12-20 00:30:00")
    item = lambda n, start, last: F.struct(
        F.col("symbol"), F.concat("symbol", F.lit(f":{n}")).alias("lifecycle_episode_id"),
        start.alias("age_live_anchor_at"), last.alias("last_trading_at"),
    )
    one = item(1, first, at("2024-01-11 04:59:00"))
    two = item(2, at("2024-01-13 06:45:00"), F.lit(None).cast("timestamp"))
    return v.user_hours.select("symbol").distinct().withColumn("lifecycle_intervals", F.array(one, two))


def _user_ranges(v: Views):
    return gp.active_ranges(_user_catalog(v), at("2024-01-03 00:00:00"), at("2024-01-30 00:00:00"))


@query("active_ranges", "symbol episode t:range_start t:range_end", "SELECT * FROM user_ranges", "user_ranges")
def _(v: Views):
    return _user_ranges(v)


@query(
    "gap_active", "symbol episode kind t:gap_start t:gap_end",
    """WITH h AS (SELECT r.symbol, r.episode, range_start, range_end, open_time FROM user_ranges r JOIN user_hours u
            ON r.symbol = u.symbol AND open_time >= range_start AND open_time < range_end),
        b AS (SELECT r.symbol, r.episode, r.range_start, r.range_end, min(open_time) AS lo, max(open_time) AS hi
            FROM user_ranges r LEFT JOIN h USING (symbol, episode) GROUP BY 1, 2, 3, 4)
      SELECT symbol, episode, 'active_interval_empty' AS kind, range_start AS gap_start, range_end AS gap_end FROM b WHERE lo IS NULL
      UNION ALL SELECT symbol, episode, 'leading_active_gap', range_start, lo FROM b WHERE lo > range_start
      UNION ALL SELECT symbol, episode, 'trailing_active_gap', hi + INTERVAL 1 HOUR, range_end FROM b WHERE hi < range_end - INTERVAL 1 HOUR
      UNION ALL SELECT symbol, episode, 'interior_active_gap', p + INTERVAL 1 HOUR, open_time FROM (
        SELECT *, lag(open_time) OVER (PARTITION BY symbol, episode ORDER BY open_time) AS p FROM h) WHERE open_time - p > INTERVAL 1 HOUR""",
    "user_ranges",
)
def _(v: Views):
    return gp.active_gaps(v.user_hours, _user_ranges(v))


@query(
    "interval_overlap_active", "symbol period",
    """SELECT DISTINCT r.symbol, strftime(d, '%Y-%m-%d') AS period FROM user_ranges r
        JOIN (SELECT DISTINCT 'U' || CAST(user_id AS VARCHAR) || 'USDT' AS symbol, CAST(ts AS DATE) AS d FROM events) p
        ON r.symbol = p.symbol AND range_start < d + INTERVAL 1 DAY AND range_end > d""",
    "user_ranges",
)
def _(v: Views):
    periods = v.presence.select(
        "symbol", F.col("day").cast("string").alias("period"), F.col("day").cast("timestamp").alias("period_start"),
        F.date_add("day", 1).cast("timestamp").alias("period_end"),
    )
    return gp.active_between(_user_ranges(v), periods)


SQL_VIEWS["order_ranges"] = (
    "",
    """SELECT 'C' || CAST(o_custkey AS VARCHAR) || 'USDT' AS symbol, min(o_orderdate) AS lo, max(o_orderdate) AS hi
        FROM orders GROUP BY 1""",
)


def _customer_symbol():
    return F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("USDT"))


def _order_ranges(v: Views):
    return v.table("orders").groupBy(_customer_symbol().alias("symbol")).agg(
        F.min("o_orderdate").cast("timestamp").alias("range_start"),
        F.date_add(F.max("o_orderdate").cast("date"), 1).cast("timestamp").alias("range_end"),
    )


@query(
    "missing_periods_anti", "symbol period",
    """SELECT symbol, strftime(m, '%Y-%m') AS period FROM (SELECT symbol, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM order_ranges)
        WHERE m BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '2001-06-01' AND (symbol, strftime(m, '%Y-%m')) NOT IN (
        SELECT 'C' || CAST(o_custkey AS VARCHAR) || 'USDT', strftime(o_orderdate, '%Y-%m') FROM orders)""",
    "order_ranges",
)
def _(v: Views):
    # Months between the first and the last order of a customer; those with any order count as observed.
    observed = v.table("orders").select(
        _customer_symbol().alias("symbol"), F.date_format("o_orderdate", "yyyy-MM").alias("period")
    ).distinct()
    return gp.missing_months(_order_ranges(v), observed, F.lit("1995-03-10").cast("date"), F.lit("2001-06-20").cast("date"))


@query(
    "interval_order_check", "symbol lifecycle_episode_id finding",
    """SELECT symbol, episode AS lifecycle_episode_id, CASE WHEN last_at IS NULL THEN 'not_terminated' ELSE 'overlaps_next' END AS finding FROM (
        SELECT *, lead(start_at) OVER (PARTITION BY symbol ORDER BY n) AS nx FROM (
            SELECT symbol, symbol || ':' || CAST(n AS VARCHAR) AS episode, n, start_at, last_at FROM (
                SELECT CAST(user_id AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n, CAST(day AS TIMESTAMP) AS start_at,
                    CASE WHEN dayofmonth(day) % 7 <> 0 THEN CAST(day AS TIMESTAMP) + INTERVAL 36 HOUR END AS last_at FROM presence)))
        WHERE nx IS NOT NULL AND (last_at IS NULL OR last_at >= nx)""",
    "presence",
)
def _(v: Views):
    from pyspark.sql import Window

    day = F.col("day").cast("timestamp")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    episodes = v.presence.select(
        F.col("user_id").cast("string").alias("symbol"),
        F.concat_ws(":", F.col("user_id").cast("string"), n.cast("string")).alias("lifecycle_episode_id"),
        day.alias("age_live_anchor_at"),
        F.when(F.dayofmonth("day") % 7 != 0, plus_seconds(day, 36 * 3600)).alias("last_trading_at"),
    )
    return gp.unordered_intervals(episodes)


# --- presence ----------------------------------------------------------------------------------------

_JUMPS = """(SELECT symbol, user_id, p AS last_before, day AS first_after FROM (
    SELECT *, lag(day) OVER (PARTITION BY symbol ORDER BY day) AS p FROM presence WHERE day < DATE '2024-01-30') WHERE day - p > 1)"""


@query(
    "presence_discontinuity", "symbol finding day:detected_from day:detected_to",
    f"""WITH jumps AS {_JUMPS},
        gapsx AS (SELECT symbol, min((last_before, first_after)) AS g FROM jumps WHERE user_id % 3 <> 0 GROUP BY 1),
        un AS (SELECT j.* FROM jumps j LEFT JOIN gapsx g ON g.symbol = j.symbol AND (j.last_before, j.first_after) = g.g WHERE g.symbol IS NULL),
        f1 AS (SELECT symbol, 0 AS pr, 'interior_discontinuity' AS finding, min((last_before, first_after)) AS g FROM un GROUP BY 1),
        last AS (SELECT symbol, any_value(user_id) AS user_id, max(CASE WHEN day < DATE '2024-01-30' THEN day END) AS d FROM presence GROUP BY 1),
        f3 AS (SELECT symbol, 2 AS pr, 'activity_after_terminal' AS finding, DATE '2024-01-20' AS a, d AS b FROM last WHERE user_id % 5 = 0 AND d > DATE '2024-01-20'),
        f4 AS (SELECT symbol, 3 AS pr, 'activity_after_registry_terminal' AS finding, DATE '2024-01-25' AS a, d AS b FROM last WHERE user_id % 7 = 0 AND d > DATE '2024-01-25'),
        f5 AS (SELECT symbol, 4 AS pr, 'frontier_missing' AS finding, d AS a, DATE '2024-01-29' AS b FROM last WHERE user_id % 5 <> 0 AND user_id % 7 <> 0 AND (d IS NULL OR d < DATE '2024-01-29')),
        alls AS (SELECT symbol, pr, finding, g[1] AS a, g[2] AS b FROM f1 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4 UNION ALL SELECT * FROM f5)
      SELECT symbol, finding, a AS detected_from, b AS detected_to FROM (SELECT *, min(pr) OVER (PARTITION BY symbol) AS lead_pr FROM alls)
      WHERE pr = lead_pr OR (lead_pr = 3 AND pr = 4)""",
    "presence",
)
def _(v: Views):
    from tidepanel.operators.series import series_steps

    horizon = F.lit("2024-01-30").cast("date")
    users = v.presence.select("symbol", "user_id").distinct()
    seen = v.presence.filter(F.col("day") < horizon).withColumn("at", F.col("day").cast("timestamp"))
    steps = series_steps(seen, ["symbol"], "at", 4096 * 86_400)
    jumps = steps.filter(F.datediff("current", "previous") > 1)
    first_jump = jumps.groupBy("symbol").agg(F.min(F.struct("previous", "current")).alias("j"))
    # Two thirds of the users have their first jump reviewed.
    reviewed = users.filter(F.col("user_id") % 3 != 0).join(first_jump, "symbol").select(
        "symbol", F.to_date("j.previous").alias("last_before"), F.to_date("j.current").alias("first_after"),
        F.lit(None).cast("date").alias("terminal_day"),
    )
    episodes = users.filter(F.col("user_id") % 5 == 0).select(
        "symbol", F.lit(1).alias("position"), F.lit("2024-01-20").cast("date").alias("terminated_day")
    )
    cutoffs = users.filter(F.col("user_id") % 7 == 0).select(
        "symbol", F.lit(1).alias("position"), F.lit(fv.ACCEPTED_CUTOFF).alias("review_status"),
        F.lit("2024-01-25").cast("date").alias("terminal_day"),
    )
    return presence_findings(v.presence.select("symbol", "day"), reviewed, episodes, cutoffs, horizon)


# --- time functions ----------------------------------------------------------------------------------


@query(
    "floors", "i:event_id t:hour_floor t:four_hour_floor last_month",
    """SELECT event_id, date_trunc('hour', ts) AS hour_floor, make_timestamp((epoch_us(ts) // 14400000000) * 14400000000) AS four_hour_floor,
        strftime(date_trunc('month', ts) - INTERVAL 1 MONTH, '%Y-%m') AS last_month FROM events""",
)
def _(v: Views):
    return v.table("events").withColumns(
        {
            "hour_floor": floor_to(F.col("ts"), 3600), "four_hour_floor": floor_to(F.col("ts"), 14_400),
            "last_month": last_completed_month(F.col("ts")),
        }
    )


@query(
    "period_bounds", "i:o_orderkey t:lo t:hi",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN date_trunc('month', o_orderdate) WHEN o_orderstatus = 'F' THEN o_orderdate END AS lo,
        CASE WHEN o_orderstatus = 'O' THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS hi FROM orders""",
)
def _(v: Views):
    kind = F.when(F.col("o_orderstatus") == "O", "monthly").when(F.col("o_orderstatus") == "F", "daily").otherwise("hourly")
    period = F.when(kind == "monthly", F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    lo, hi = period_bounds(kind, period)
    return v.table("orders").withColumns({"lo": lo, "hi": hi})


@query(
    "utc_day_boundary", "i:event_id is_day is_instant",
    """SELECT event_id, event_id % 5 = 0 AS is_day, event_id % 5 IN (0, 1) AS is_instant FROM events""",
)
def _(v: Views):
    k, day = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd")
    text = (
        F.when(k == 0, F.concat(day, F.lit("T00:00:00Z")))
        .when(k == 1, F.concat(day, F.lit("T12:30:05.000120Z")))
        .when(k == 2, F.concat(day, F.lit(" 00:00:00")))
        .when(k == 3, F.concat(day, F.lit("T00:00:00+00:00")))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM"), F.lit("-32T00:00:00Z")))
    )
    return v.table("events").withColumn("x", text).withColumns(
        {"is_day": is_utc_day_text(F.col("x")), "is_instant": is_utc_instant_text(F.col("x"))}
    )


@query(
    "paged_ranges", "symbol t:page_start t:page_end",
    """SELECT symbol, p AS page_start, least(p + INTERVAL 100 HOUR, TIMESTAMP '2024-01-30 07:00:00') AS page_end FROM (
        SELECT symbol, unnest(generate_series(date_trunc('hour', first_ts), TIMESTAMP '2024-01-30 06:00:00', INTERVAL 100 HOUR)) AS p FROM spans)""",
    "spans",
)
def _(v: Views):
    tails = v.spans.select("symbol", F.col("first_ts").alias("tail_start"))
    return pl.paged_ranges(tails, at("2024-01-30 07:20:00"), page_hours=100)


# --- keys and planning -------------------------------------------------------------------------------

# The key grammar knows years from 2000 on, so older orders give no valid key.
_KEY_SQL = """
    SELECT o_orderkey, 'P' || substr(o_orderpriority, 1, 1) || 'USDT' AS symbol,
        CASE WHEN year(o_orderdate) >= 2000 THEN CASE o_orderstatus WHEN 'O' THEN 'monthly' WHEN 'F' THEN 'daily' END END AS source_kind,
        CASE WHEN year(o_orderdate) >= 2000 THEN CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m') WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END END AS period
    FROM orders"""
SQL_VIEWS["order_keys"] = ("", _KEY_SQL)


@query(
    "object_key_parse", "i:o_orderkey source_kind symbol period filename",
    """SELECT o_orderkey, source_kind, CASE WHEN source_kind IS NOT NULL THEN symbol END AS symbol, period,
        CASE WHEN source_kind IS NOT NULL THEN symbol || '-1h-' || period || '.zip' END AS filename FROM order_keys""",
    "order_keys",
)
def _(v: Views):
    return v.order_keys.withColumn("k", parse_object_key(F.col("object_key"))).select("o_orderkey", "k.*")


def _monthly(v: Views):
    return pl.parsed_keys(v.order_keys.select("object_key").distinct()).filter("source_kind = 'monthly'")


@query(
    "archive_bounds", "symbol first_archive_month last_archive_month i:unique_archive_count",
    "SELECT symbol, min(period) AS first_archive_month, max(period) AS last_archive_month, count(DISTINCT period) AS unique_archive_count FROM order_keys WHERE source_kind = 'monthly' GROUP BY 1",
    "order_keys",
)
def _(v: Views):
    return pl.archive_bounds(pl.parsed_keys(v.order_keys))


_MONTH_KEY = "'data/futures/um/monthly/klines/' || symbol || '/1h/' || symbol || '-1h-' || period || '.zip'"


@query(
    "monthly_key_list", "symbol object_key",
    f"SELECT DISTINCT symbol, {_MONTH_KEY} AS object_key FROM order_keys WHERE source_kind = 'monthly' AND symbol <> 'P5USDT'",
    "order_keys",
)
def _(v: Views):
    lists = pl.observed_key_lists(pl.parsed_keys(v.order_keys))
    approved = lists.select("symbol").filter(F.col("symbol") != "P5USDT")
    return pl.monthly_keys(lists, approved)


_READY = """SELECT symbol FROM (SELECT 'P' || substr(o_orderpriority, 1, 1) || 'USDT' AS symbol, count(*) AS n FROM orders GROUP BY 1)
    WHERE n * (SELECT count(DISTINCT substr(o_orderpriority, 1, 1)) FROM orders) > (SELECT count(*) FROM orders)"""


@query(
    "planned_period_keys", "symbol object_key",
    f"SELECT DISTINCT symbol, {_MONTH_KEY} AS object_key FROM order_keys WHERE source_kind = 'monthly' AND period BETWEEN '2000-02' AND '2000-11' AND symbol IN ({_READY})",
    "order_keys",
)
def _(v: Views):
    # Ready are the symbols with more orders than the mean of all symbols.
    counts = v.table("orders").groupBy(order_symbol().alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    all_ = counts.agg(F.sum("n").alias("orders"), F.count(F.lit(1)).alias("symbols"))  # one row
    ready = counts.join(F.broadcast(all_)).filter(F.col("n") * F.col("symbols") > F.col("orders")).select("symbol")
    return pl.planned_period_keys(pl.parsed_keys(v.order_keys), ready, F.lit("2000-02"), F.lit("2000-11"))


@query(
    "earliest_file", "symbol source_period object_key",
    f"SELECT symbol, min(period) AS source_period, {_MONTH_KEY.replace('period', 'min(period)')} AS object_key FROM order_keys WHERE source_kind = 'monthly' GROUP BY symbol",
    "order_keys",
)
def _(v: Views):
    return pl.earliest_file(_monthly(v))


@query(
    "limit_sources", "source_key",
    f"SELECT DISTINCT {_MONTH_KEY} AS source_key FROM order_keys WHERE source_kind = 'monthly' ORDER BY 1 LIMIT 25",
    "order_keys",
)
def _(v: Views):
    return pl.limit_sources(_monthly(v).withColumnRenamed("object_key", "source_key").select("source_key"), 25)


@query(
    "first_trade_per_key", "symbol t:earliest_trade_timestamp",
    "SELECT symbol, first_ts AS earliest_trade_timestamp FROM spans", "spans",
)
def _(v: Views):
    from tidepanel.workload.views import event_symbol

    trades = v.table("events").select(event_symbol(10).alias("symbol"), F.col("ts").alias("traded_at"))
    return pl.first_trades(trades, ["symbol"])


@query(
    "daily_pair_check", "symbol object_key",
    """SELECT symbol, 'data/futures/um/daily/klines/' || symbol || '/1h/' || symbol || '-1h-' || strftime(day, '%Y-%m-%d') || '.zip' AS object_key
        FROM presence WHERE (user_id + dayofmonth(day)) % 13 = 0""",
    "presence",
)
def _(v: Views):
    key = daily_bar_key(F.col("symbol"), F.col("day").cast("string"))
    data = v.presence.select("symbol", "user_id", "day", key.alias("object_key"))
    sums = data.filter((F.col("user_id") + F.dayofmonth("day")) % 13 != 0).select(
        "symbol", F.concat("object_key", F.lit(fv.CHECKSUM_SUFFIX)).alias("object_key")
    )
    return pl.unpaired_files(data.select("symbol", "object_key").unionByName(sums))


# Planning runs at cutoff 2024-01-20 09:30 over daily presence; all history is in the cutoff month.
_OURS = "(SELECT DISTINCT symbol FROM presence WHERE user_id % 4 <> 1)"
_RUNS = f"""(SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM presence
    WHERE day < DATE '2024-01-20' AND symbol IN (SELECT * FROM {_OURS}))"""


def _listing(v: Views):
    """Object keys of the presence: a file per day, and for every other user one of the month before."""
    days = v.presence.select(daily_bar_key(F.col("symbol"), F.col("day").cast("string")).alias("object_key"))
    users = v.presence.select("symbol", "user_id").distinct().filter(F.col("user_id") % 2 == 0)
    return days.unionByName(users.select(monthly_bar_key(F.col("symbol"), F.lit("2023-12")).alias("object_key")))


def _plan(v: Views, listing=None):
    users = v.presence.select("symbol", "user_id").distinct()
    approved = users.filter(F.col("user_id") % 4 != 1).select("symbol")
    candidates = users.filter(F.col("user_id") != 3).select("symbol")
    keys = pl.parsed_keys(_listing(v) if listing is None else listing)
    start = F.when(F.col("user_id") % 2 == 0, at("2023-12-05 00:00:00")).otherwise(at("2024-01-01 00:00:00"))
    end = F.when(F.col("user_id") % 9 == 0, at("2024-01-04 00:00:00")).otherwise(at("2024-01-20 09:00:00"))
    ranges = users.select("symbol", start.alias("range_start"), end.alias("range_end"))
    return pl.plan_from_keys(
        keys, approved, candidates, ranges, F.lit("2023-12-01").cast("timestamp"),
        at("2024-01-20 09:30:00"), page_hours=100,
    )


SQL_VIEWS["planned"] = (
    "presence",
    f"""SELECT 'monthly' AS source_kind, symbol, '2023-12' AS source_period, TIMESTAMP '2023-12-01' AS range_start, TIMESTAMP '2024-01-01' AS range_end
          FROM (SELECT DISTINCT symbol, user_id FROM presence) WHERE user_id % 2 = 0 AND symbol IN (SELECT * FROM {_OURS})
        UNION ALL SELECT 'daily', symbol, strftime(day, '%Y-%m-%d'), CAST(day AS TIMESTAMP), day + INTERVAL 1 DAY FROM {_RUNS} WHERE dayofmonth(day) = n
        UNION ALL SELECT 'api', symbol, CAST(epoch_ms(p) AS VARCHAR) || '-' || CAST(epoch_ms(e) - 1 AS VARCHAR), p, e FROM (
          SELECT symbol, p, least(p + INTERVAL 100 HOUR, TIMESTAMP '2024-01-20 09:00:00') AS e FROM (
            SELECT symbol, unnest(generate_series(s, TIMESTAMP '2024-01-20 08:00:00', INTERVAL 100 HOUR)) AS p FROM (
              SELECT o.symbol, coalesce(max(CAST(r.day AS TIMESTAMP)) + INTERVAL 1 DAY, TIMESTAMP '2024-01-01') AS s
              FROM {_OURS} o LEFT JOIN (SELECT * FROM {_RUNS} WHERE dayofmonth(day) = n) r ON r.symbol = o.symbol GROUP BY 1)
            JOIN (SELECT DISTINCT symbol, CASE WHEN user_id % 9 = 0 THEN TIMESTAMP '2024-01-04' ELSE TIMESTAMP '2024-01-20 09:00:00' END AS live FROM presence) USING (symbol)
            WHERE live > s))""",
)


@query(
    "plan_source_tiers", "source_kind symbol source_period t:range_start t:range_end",
    "SELECT * FROM planned", "planned",
)
def _(v: Views):
    return _plan(v).sources


@query(
    "plan_interior_gaps", "symbol t:missing_day t:latest_observed_day",
    f"""SELECT symbol, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * min(n - 1) AS missing_day, CAST(max(day) AS TIMESTAMP) AS latest_observed_day
        FROM {_RUNS} WHERE dayofmonth(day) > n GROUP BY 1""",
    "presence",
)
def _(v: Views):
    return _plan(v).interior_day_gaps


@query(
    "plan_unknown_identities", "symbol",
    "SELECT DISTINCT symbol FROM presence WHERE user_id = 3 AND day < DATE '2024-01-20'", "presence",
)
def _(v: Views):
    return _plan(v).unknown_identities


@query(
    "plan_replay", "i:stored_rows is_equal",
    "SELECT count(*) AS stored_rows, true AS is_equal FROM planned", "planned",
)
def _(v: Views):
    from tidepanel.operators.quality import replay_equal
    from tidepanel.session import scratch_path
    from tidepanel.sources.sinks import read_stage, write_stage

    # The stored plan against one made anew from the listing as it was stored.
    plan, listing = (scratch_path(v.spark, name) for name in ("plan", "listing"))
    write_stage(_plan(v).sources, plan)
    write_stage(_listing(v), listing)
    return replay_equal(read_stage(v.spark, plan), _plan(v, read_stage(v.spark, listing)).sources)


@query(
    "source_entry_rows", "source_kind symbol t:range_start",
    "SELECT source_kind, symbol, range_start FROM planned ORDER BY symbol, range_start", "planned",
)
def _(v: Views):
    return pl.source_inventory(_plan(v).sources)


@query(
    "source_overlap_check", "symbol source_kind source_key finding",
    """WITH s AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, CASE WHEN value > 100 THEN 'api' WHEN value < 0.5 THEN 'ftp' ELSE 'daily' END AS source_kind,
            CAST(event_id AS VARCHAR) AS source_key, date_trunc('hour', ts) AS a, date_trunc('hour', ts) + INTERVAL 30 HOUR AS b FROM events),
        w AS (SELECT *, lag(b) OVER o AS pb, coalesce(max(CASE WHEN source_kind = 'api' THEN 1 ELSE 0 END) OVER p, 0) AS seen,
            last_value(CASE WHEN source_kind = 'api' THEN b END IGNORE NULLS) OVER p AS papi,
            max(CASE WHEN source_kind = 'api' THEN b END) OVER (PARTITION BY symbol) AS lapi FROM s
            WINDOW o AS (PARTITION BY symbol ORDER BY a, b, source_key), p AS (PARTITION BY symbol ORDER BY a, b, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT symbol, source_kind, source_key, 'unsupported_kind' AS finding FROM w WHERE source_kind = 'ftp'
      UNION ALL SELECT symbol, source_kind, source_key, 'bad_range' FROM w WHERE b > TIMESTAMP '2024-01-30 12:00:00'
      UNION ALL SELECT symbol, source_kind, source_key, 'overlap' FROM w WHERE a < pb
      UNION ALL SELECT symbol, source_kind, source_key, 'archive_after_tail' FROM w WHERE seen = 1 AND source_kind <> 'api'
      UNION ALL SELECT symbol, source_kind, source_key, 'tail_not_contiguous' FROM w WHERE source_kind = 'api' AND papi <> a
      UNION ALL SELECT symbol, source_kind, source_key, 'tail_does_not_reach_cutoff' FROM w WHERE source_kind = 'api' AND b = lapi AND b <> TIMESTAMP '2024-01-30 12:00:00'""",
)
def _(v: Views):
    value, hour = F.col("value"), F.date_trunc("hour", "ts")
    sources = v.table("events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.when(value > 100, "api").when(value < 0.5, "ftp").otherwise("daily").alias("source_kind"),
        F.col("event_id").cast("string").alias("source_key"),
        hour.alias("range_start"), plus_seconds(hour, 30 * 3600).alias("range_end"),
    )
    return pl.source_overlaps(sources, at("2024-01-30 12:40:00"))


@query(
    "attempt_plan_check", "source_key finding",
    """WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS source_key, count(*) AS n, sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS bad FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
        p AS (SELECT CAST(o_orderkey AS VARCHAR) AS source_key FROM orders WHERE o_orderstatus <> 'P')
      SELECT source_key, 'missing' AS finding FROM p WHERE source_key NOT IN (SELECT source_key FROM a)
      UNION ALL SELECT source_key, 'unplanned' FROM a WHERE source_key NOT IN (SELECT source_key FROM p)
      UNION ALL SELECT source_key, 'duplicated' FROM a WHERE n > 1
      UNION ALL SELECT source_key, 'unverified' FROM a WHERE bad > 0""",
)
def _(v: Views):
    attempts = v.table("lineitem").filter(F.col("l_linenumber") <= 2).select(
        F.col("l_orderkey").cast("string").alias("source_key"),
        F.when(F.col("l_returnflag") == "N", "verified").otherwise("failed").alias("status"),
    )
    planned = v.table("orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").cast("string").alias("source_key")
    )
    return pl.attempt_findings(attempts, planned)


# --- pages -------------------------------------------------------------------------------------------


@query(
    "page_chain_check", "grp i:page finding",
    """WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS grp, turn + 1 AS page, role <> 'assistant' AS truncated,
            CASE WHEN length(text) % 3 <> 0 THEN 't' || CAST(turn + 1 AS VARCHAR) WHEN length(text) % 2 = 0 THEN 'same' END AS next_token,
            CASE WHEN turn > 0 THEN 't' || CAST(turn AS VARCHAR) END AS request_token,
            length(text) % 4 AS d, length(text) % 4 + CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END AS e FROM conversations),
        w AS (SELECT p.*, row_number() OVER o AS rn, lag(CASE WHEN truncated THEN next_token END) OVER o AS want,
            lag(truncated) OVER o AS pt, max(page) OVER (PARTITION BY grp) AS lastp,
            CASE WHEN next_token IS NOT NULL THEN (SELECT count(*) FROM p q WHERE q.grp = p.grp AND q.truncated AND q.next_token = p.next_token) ELSE 0 END AS uses
            FROM p WINDOW o AS (PARTITION BY grp ORDER BY page))
      SELECT grp, page, 'page_missing' AS finding FROM w WHERE page <> rn
      UNION ALL SELECT grp, page, 'chain_broken' FROM w WHERE request_token IS DISTINCT FROM want
      UNION ALL SELECT grp, page, 'truncated_without_token' FROM w WHERE truncated AND next_token IS NULL
      UNION ALL SELECT grp, page, 'terminal_with_token' FROM w WHERE NOT truncated AND next_token IS NOT NULL
      UNION ALL SELECT grp, page, 'page_after_terminal' FROM w WHERE pt = false
      UNION ALL SELECT grp, page, 'no_terminal_page' FROM w WHERE page = lastp AND truncated
      UNION ALL SELECT grp, page, 'token_repeated' FROM w WHERE uses > 1
      UNION ALL SELECT grp, page, 'count_disagrees' FROM w WHERE d <> e""",
)
def _(v: Views):
    # Conversations as listings: a turn is a page, the role and text length decide its tokens.
    n = F.length("text")
    pages = v.table("conversations").select(
        F.col("conv_id").cast("string").alias("grp"),
        (F.col("turn") + 1).alias("page"),
        (F.col("role") != "assistant").alias("truncated"),
        F.when(n % 3 != 0, F.concat(F.lit("t"), (F.col("turn") + 1).cast("string"))).when(n % 2 == 0, "same").alias("next_token"),
        F.concat(
            F.lit("https://host.example/?list-type=2&prefix=p/"),
            F.when(F.col("turn") > 0, F.concat(F.lit("&continuation-token=t"), F.col("turn").cast("string"))).otherwise(""),
        ).alias("url"),
        (n % 4).alias("declared_count"),
        (n % 4 + F.when(n % 5 == 0, 1).otherwise(0)).alias("entry_count"),
    )
    return pg.page_chain_findings(pg.request_fields(pages), ["grp"])


@query(
    "page_suffix_check", "page_key i:missing i:outside i:repeated",
    """WITH pg AS (SELECT DISTINCT symbol || '/' || strftime(open_time, '%Y-%m-%d') AS page_key, date_trunc('day', open_time) AS s FROM bars_1h),
        rw AS (SELECT symbol || '/' || strftime(open_time - INTERVAL 30 MINUTE, '%Y-%m-%d') AS page_key, open_time FROM bars_1h)
      SELECT * FROM (SELECT p.page_key, 24 - count(CASE WHEN r.open_time >= s AND r.open_time < s + INTERVAL 1 DAY THEN 1 END) AS missing,
          count(CASE WHEN r.open_time >= s + INTERVAL 1 DAY THEN 1 END) AS outside, 0 AS repeated
        FROM pg p LEFT JOIN rw r ON p.page_key = r.page_key GROUP BY 1) WHERE missing > 0 OR outside > 0""",
    "bars_1h",
)
def _(v: Views):
    key = lambda t: F.concat_ws("/", "symbol", F.to_date(t).cast("string"))
    day = F.date_trunc("day", "open_time")
    pages = v.bars_1h.select(
        key("open_time").alias("page_key"), day.alias("page_start"), plus_seconds(day, 86_400).alias("page_end")
    ).distinct()
    shifted = F.col("open_time") - F.expr("INTERVAL 30 MINUTES")
    return pg.page_suffix_findings(v.bars_1h.select(key(shifted).alias("page_key"), "open_time"), pages)


@query(
    "listing_group_check", "prefix finding",
    """SELECT 'data/futures/um/daily/klines/' || symbol || '/1h/' AS prefix, 'listing_omitted' AS finding FROM spans WHERE bucket = 4
        UNION ALL SELECT 'data/futures/um/daily/klines/' || symbol || '/1h/', 'orphan_listing' FROM spans WHERE bucket = 6
        UNION ALL SELECT 'data/futures/um/daily/klines/' || symbol || '/1h/', 'unexpected_prefixes' FROM spans WHERE bucket = 2
        UNION ALL SELECT 'data/futures/um/daily/klines/', 'sequence_incomplete'""",
    "spans",
)
def _(v: Views):
    root = fv.DAILY_BAR_ROOT
    none = F.array().cast("array<string>")
    path = F.concat(F.lit(root), "symbol", F.lit("/"))
    # One root page per kind lists the symbols of that kind (a few dozen at most).
    roots = v.spans.filter("bucket <> 6").groupBy("kind").agg(F.collect_set(path).alias("prefixes")).select(
        F.col("kind").alias("id"), F.lit(root).alias("prefix"), F.lit("/").alias("delimiter"), "prefixes", none.alias("keys")
    )
    groups = v.spans.filter("bucket <> 4").select(
        F.col("symbol").alias("id"), F.concat(path, F.lit("1h/")).alias("prefix"), F.lit(None).cast("string").alias("delimiter"),
        F.when(F.col("bucket") == 2, F.array(path)).otherwise(none).alias("prefixes"),
        F.array(F.concat(path, F.lit("x.zip"))).alias("keys"),
    )
    numbered = with_row_number(roots.unionByName(groups), ["id"], "place").withColumn(
        "sequence", (F.col("place") + F.when(F.col("id") >= "VIEW", 1).otherwise(0)).cast("int")
    )
    return pg.listing_group_findings(numbered.drop("place"), root)


# --- registries --------------------------------------------------------------------------------------


@query(
    "union_candidates", "identity i:layer_count is_canonical",
    """SELECT identity, count(DISTINCT layer) AS layer_count, regexp_full_match(identity, '[A-Z0-9]{1,64}') AS is_canonical FROM (
        SELECT 'a' AS layer, upper(replace(p_name, ' ', '')) AS identity FROM part UNION ALL SELECT 'b', p_type FROM part UNION ALL SELECT 'c', p_brand FROM part) GROUP BY 1""",
)
def _(v: Views):
    part = v.table("part")
    layers = part.select(F.lit("a").alias("layer"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("identity"))
    for name, column in (("b", "p_type"), ("c", "p_brand")):
        layers = layers.unionByName(part.select(F.lit(name).alias("layer"), F.col(column).alias("identity")))
    return rg.union_candidates(layers)


@query(
    "daily_only_candidates", "symbol archive_discovery_provenance i:unique_archive_count",
    f"""SELECT symbol, '{fv.FRONTIER_ONLY}' AS archive_discovery_provenance, 0 AS unique_archive_count FROM (
        SELECT DISTINCT symbol FROM presence EXCEPT SELECT symbol FROM presence WHERE day <= DATE '2024-01-01')""",
    "presence",
)
def _(v: Views):
    early = v.presence.filter(F.col("day") <= F.lit("2024-01-01").cast("date")).select("symbol").distinct()
    return rg.daily_only_candidates(early, v.presence)


@query(
    "candidate_diff", "identity change",
    """SELECT CAST(p_partkey AS VARCHAR) AS identity, 'added' AS change FROM part WHERE p_partkey NOT IN (SELECT l_suppkey FROM lineitem)
        UNION ALL SELECT DISTINCT CAST(l_suppkey AS VARCHAR), 'removed' FROM lineitem WHERE l_suppkey NOT IN (SELECT p_partkey FROM part)""",
)
def _(v: Views):
    parts = v.table("part").select(F.col("p_partkey").cast("string").alias("identity"))
    used = v.table("lineitem").select(F.col("l_suppkey").cast("string").alias("identity"))
    return rg.candidate_diff(parts, used)


@query(
    "registry_validate", "contract_identity finding",
    """WITH r AS (SELECT 'C' || CAST(c_custkey % 1000000 AS VARCHAR) AS id, c_custkey AS k FROM customer)
      SELECT id AS contract_identity, 'not_a_candidate' AS finding FROM r WHERE k % 10 = 0
      UNION ALL SELECT 'X' || CAST(s_suppkey AS VARCHAR), 'missing_record' FROM supplier
      UNION ALL SELECT id, 'incomplete_disposition' FROM r WHERE k % 9 = 0
      UNION ALL SELECT id, 'stablecoin_positive_wrong_status' FROM r WHERE k % 7 = 0 AND k % 3 = 1
      UNION ALL SELECT id, 'stablecoin_positive_without_evidence' FROM r WHERE k % 7 = 0 AND k % 2 = 1
      UNION ALL SELECT id, 'leveraged_token_negative_wrong_status' FROM r WHERE k % 11 = 0""",
)
def _(v: Views):
    k = F.col("c_custkey")
    identity = F.concat(F.lit("C"), (k % 1_000_000).cast("string"))
    stable = k % 7 == 0
    names = ["source_name", "source_type", "source_identifier", "source_url", "reviewed_at", "review_version"]
    proof = F.struct(
        F.lit("direct_positive_exclusion").alias("evidence_class"), F.lit("stablecoin").alias("exclusion_class"),
        *[F.lit("x").alias(n) for n in names],
        F.when(k % 2 == 1, " ").otherwise("seen").alias("evidence_summary"),
    )
    registry = v.table("customer").select(
        identity.alias("contract_identity"),
        F.when(k % 9 == 0, "open").otherwise("complete").alias("scope_audit_status"),
        stable.alias("is_stablecoin_underlying"), F.lit(False).alias("is_leveraged_token"),
        F.when(stable & (k % 3 != 1), "positive_exclusion_evidence").when(~stable, "reviewed_finite_universe_negative").alias("stablecoin_evidence_status"),
        F.when(k % 11 != 0, "reviewed_finite_universe_negative").alias("leveraged_evidence_status"),
        F.array(proof).alias("evidence"),
    )
    candidates = v.table("customer").filter(k % 10 != 0).select(identity.alias("identity")).unionByName(
        v.table("supplier").select(F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("identity"))
    )
    return rg.registry_findings(registry, candidates)


@query(
    "exactly_one_match", "symbol d:total",
    "SELECT CAST(o_custkey AS VARCHAR) AS symbol, any_value(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000 GROUP BY 1 HAVING count(*) = 1",
)
def _(v: Views):
    events = v.table("orders").filter(F.col("o_totalprice") > 300_000).select(
        F.col("o_custkey").cast("string").alias("symbol"), F.lit("listing").alias("event_type"),
        F.when(F.col("o_orderstatus") == "O", "accepted").otherwise("rejected").alias("match_status"),
        F.col("o_totalprice").alias("total"),
    )
    return rg.accepted_events(events, "listing", ["total"])


@query(
    "catalog_diff", "symbol lifecycle_episode_id field expected actual",
    """WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderkey AS VARCHAR) AS lifecycle_episode_id, o_orderpriority AS f, o_orderstatus AS s FROM orders WHERE o_totalprice < 400000),
        a AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderkey AS VARCHAR) AS lifecycle_episode_id, CASE WHEN o_totalprice > 300000 THEN 'Q' ELSE o_orderpriority END AS f, o_orderstatus AS s FROM orders WHERE o_totalprice > 100000),
        j AS (SELECT coalesce(e.symbol, a.symbol) AS symbol, coalesce(e.lifecycle_episode_id, a.lifecycle_episode_id) AS lifecycle_episode_id, e.f AS ef, a.f AS af, e.s AS es, a.s AS sa
            FROM e FULL JOIN a ON e.symbol = a.symbol AND e.lifecycle_episode_id = a.lifecycle_episode_id)
      SELECT symbol, lifecycle_episode_id, 'anchor_basis' AS field, ef AS expected, af AS actual FROM j WHERE ef IS DISTINCT FROM af
      UNION ALL SELECT symbol, lifecycle_episode_id, 'interval_evidence_status', es, sa FROM j WHERE es IS DISTINCT FROM sa""",
)
def _(v: Views):
    from tidepanel.operators.catalog import catalog_diff

    rows = v.table("orders").select(
        F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderkey").cast("string").alias("lifecycle_episode_id"),
        F.col("o_orderpriority").alias("anchor_basis"), F.col("o_orderstatus").alias("interval_evidence_status"),
        "o_totalprice",
    )
    changed = rows.withColumn("anchor_basis", F.when(F.col("o_totalprice") > 300_000, "Q").otherwise(F.col("anchor_basis")))
    return catalog_diff(
        rows.filter("o_totalprice < 400000"), changed.filter("o_totalprice > 100000"), ["anchor_basis", "interval_evidence_status"]
    )
