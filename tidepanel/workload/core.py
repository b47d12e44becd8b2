"""Rollups, contracts, features, ranks, episodes, splits and labels over event bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import fixed_values as fv
from tidepanel.operators import contracts as ct
from tidepanel.operators import quality as ql
from tidepanel.operators.episodes import add_episodes
from tidepanel.operators.features import (
    FeatureSpec,
    add_continuity_segment,
    add_time_series_features,
    add_window_features,
)
from tidepanel.operators.labels import (
    add_benchmark_relative,
    add_median_excess,
    add_symbol_labels,
)
from tidepanel.operators.rank import (
    RANK_SOURCES,
    add_cross_sectional_ranks,
    add_percentiles,
    top_decile,
)
from tidepanel.operators.rollup import rollup_groups, rollup_rejected, rollup_strict, unexplained_rejects
from tidepanel.operators.series import Grid
from tidepanel.operators.splits import SplitAccessError, guard_splits, split_counts, with_split
from tidepanel.functions.timefn import floor_to, horizon_in_split
from tidepanel.plans.slice import analysis_window
from tidepanel.workload.registry import query
from tidepanel.workload.views import BENCHMARK, SPLIT_SQL, SPLITS, Views, at

SPEC = FeatureSpec(liquidity=60)
GRID = Grid()

_GROUPS = """
    SELECT symbol, make_timestamp((epoch_us(open_time) // 14400000000) * 14400000000) AS group_open,
        count(*) AS n, count(DISTINCT open_time) AS u,
        first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low,
        last(close ORDER BY open_time) AS close, sum(quote_volume) AS quote_volume,
        sum(base_volume) AS base_volume, sum(trade_count) AS trade_count, max(close_time) AS close_time,
        string_agg(CAST(hour(open_time) % 4 AS VARCHAR), ',' ORDER BY open_time) AS slots
    FROM bars_1h GROUP BY 1, 2"""


@query(
    "rollup_strict",
    "symbol t:open_time d:open d:high d:low d:close d:base_volume d:quote_volume i:trade_count "
    "t:close_time i:source_hour_count",
    f"SELECT symbol, group_open AS open_time, open, high, low, close, base_volume, quote_volume, "
    f"trade_count, close_time, n AS source_hour_count FROM ({_GROUPS}) WHERE slots = '0,1,2,3'",
    "bars_1h",
)
def _(v: Views):
    return rollup_strict(v.bars_1h)


@query(
    "rollup_rejected",
    "symbol t:open_time i:source_hour_count i:unique_hour_count offset_text",
    f"SELECT symbol, group_open AS open_time, n AS source_hour_count, u AS unique_hour_count, "
    f"slots AS offset_text FROM ({_GROUPS}) WHERE slots <> '0,1,2,3'",
    "bars_1h",
)
def _(v: Views):
    return rollup_rejected(v.bars_1h).withColumn(
        "offset_text", F.concat_ws(",", F.transform("offsets", lambda o: o.cast("string")))
    )


@query(
    "semi_valid_groups",
    "symbol t:open_time d:close",
    "SELECT symbol, open_time, close FROM (SELECT *, count(*) OVER (PARTITION BY symbol, "
    "epoch_us(open_time) // 14400000000) AS n FROM bars_1h) WHERE n = 4",
    "bars_1h",
)
def _(v: Views):
    # Hours of complete groups; the group test is the aggregate itself, joined on the group key.
    keyed = v.bars_1h.withColumn("group_open", floor_to(F.col("open_time"), 14_400))
    complete = rollup_groups(v.bars_1h).filter("is_accepted").select(
        "symbol", F.col("open_time").alias("group_open")
    )
    return keyed.join(complete, ["symbol", "group_open"], "left_semi")


@query(
    "rejected_reconcile",
    "symbol t:open_time i:source_hour_count",
    f"""SELECT r.symbol, r.group_open AS open_time, r.n AS source_hour_count FROM ({_GROUPS}) r
        WHERE slots <> '0,1,2,3'
        AND NOT (r.group_open < TIMESTAMP '2024-01-30 22:00:00'
            AND TIMESTAMP '2024-01-30 22:00:00' < r.group_open + INTERVAL 4 HOUR)
        AND NOT EXISTS (SELECT 1 FROM (
                SELECT symbol, date_trunc('hour', min(ts)) AS p FROM (SELECT upper(event_type) || '0USDT' AS symbol, ts FROM events) GROUP BY 1
                UNION ALL SELECT symbol, date_trunc('hour', max(ts)) + INTERVAL 1 HOUR FROM (SELECT upper(event_type) || '0USDT' AS symbol, ts FROM events) GROUP BY 1) b
            WHERE b.symbol = r.symbol AND r.group_open < b.p AND b.p < r.group_open + INTERVAL 4 HOUR)""",
    "bars_1h",
)
def _(v: Views):
    hour = F.expr("INTERVAL 1 HOUR")
    bounds = v.table("events").groupBy(F.concat(F.upper("event_type"), F.lit("0USDT")).alias("symbol")).agg(
        F.date_trunc("hour", F.min("ts")).alias("lo"), (F.date_trunc("hour", F.max("ts")) + hour).alias("hi")
    )
    points = bounds.select("symbol", F.explode(F.array("lo", "hi")).alias("point"))
    return unexplained_rejects(rollup_rejected(v.bars_1h), points, at("2024-01-30 22:00:00"))


# --- contracts -------------------------------------------------------------------------------------

@query(
    "validate_bars",
    "i:row_count i:duplicate_key i:bad_symbol i:unaligned_open i:wrong_close_time i:not_finite "
    "i:price_not_positive i:bad_price_order i:negative_volume",
    """SELECT count(*) AS row_count, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS duplicate_key,
        sum(CASE WHEN regexp_full_match(symbol, '[A-Z0-9]{1,64}') THEN 0 ELSE 1 END) AS bad_symbol,
        sum(CASE WHEN epoch_us(open_time) % 3600000000 = 0 THEN 0 ELSE 1 END) AS unaligned_open,
        sum(CASE WHEN close_time = open_time + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND THEN 0 ELSE 1 END) AS wrong_close_time,
        0 AS not_finite,
        sum(CASE WHEN o > 0 AND h > 0 AND l > 0 AND c > 0 THEN 0 ELSE 1 END) AS price_not_positive,
        sum(CASE WHEN h >= o AND h >= c AND h >= l AND l <= o AND l <= c THEN 0 ELSE 1 END) AS bad_price_order,
        0 AS negative_volume
      FROM (SELECT *, count(*) OVER (PARTITION BY symbol, open_time) AS n FROM (
        SELECT event_type || CAST(user_id % 3 AS VARCHAR) AS symbol,
            CASE WHEN value > 300 THEN ts ELSE date_trunc('hour', ts) END AS open_time,
            date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS close_time,
            value AS o, value - 1 AS l, value * 1.5 - 5 AS h, value AS c FROM events))""",
)
def _(v: Views):
    # Every event as a bar: lower-case symbols, off-grid opens, repeated keys, broken prices.
    value = F.col("value")
    rows = v.table("events").select(
        F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("symbol"),
        F.when(value > 300, F.col("ts")).otherwise(F.date_trunc("hour", "ts")).alias("open_time"),
        value.alias("open"), (value * 1.5 - 5).alias("high"), (value - 1).alias("low"), value.alias("close"),
        F.lit(1.0).alias("base_volume"),
        F.timestamp_micros(F.unix_micros(F.date_trunc("hour", "ts")) + 3_599_999_000).alias("close_time"),
        value.alias("quote_volume"), F.lit(1).cast("bigint").alias("trade_count"),
        F.lit(0.5).alias("taker_buy_base_volume"), (value / 2).alias("taker_buy_quote_volume"),
    )
    return ct.validate_bars(rows).metrics


@query(
    "validate_bars_canonical",
    "i:row_count i:duplicate_key i:rows_after_cutoff i:rows_from_unplanned_source passed",
    """SELECT count(*) AS row_count, 0 AS duplicate_key,
        sum(CASE WHEN open_time >= TIMESTAMP '2024-01-30' OR close_time >= TIMESTAMP '2024-01-30' THEN 1 ELSE 0 END) AS rows_after_cutoff,
        sum(CASE WHEN CAST(open_time AS DATE) IN (SELECT CAST(min(ts) AS DATE) FROM events) THEN 1 ELSE 0 END) AS rows_from_unplanned_source,
        false AS passed FROM bars_1h""",
    "bars_1h",
)
def _(v: Views):
    key = F.concat_ws("/", "symbol", F.to_date("open_time").cast("string"))
    bars = v.bars_1h.withColumns({"source_key": key, "source_sha256": F.sha2(key, 256)})
    first_day = v.table("events").agg(F.to_date(F.min("ts")).alias("first_day"))
    planned = (
        bars.select("source_key", F.to_date("open_time").alias("day")).distinct()
        .join(F.broadcast(first_day))  # one aggregate row
        .filter(F.col("day") > F.col("first_day"))
    )
    return ct.validate_canonical(bars, at("2024-01-30 00:30:00"), planned)


@query(
    "source_containment",
    "symbol t:open_time source_key",
    """SELECT symbol, open_time, symbol || '/' || strftime(open_time - INTERVAL 90 MINUTE, '%Y-%m-%d') AS source_key
        FROM bars_1h WHERE CAST(open_time - INTERVAL 90 MINUTE AS DATE) <> CAST(open_time AS DATE)""",
    "bars_1h",
)
def _(v: Views):
    # Lineage shifted by 90 minutes: the first two hours of each day cite the day before.
    shifted = F.to_date(F.col("open_time") - F.expr("INTERVAL 90 MINUTES"))
    key = F.concat_ws("/", "symbol", shifted.cast("string"))
    bars = v.bars_1h.withColumns({"source_key": key, "__day": shifted})
    sources = bars.select(
        "source_key", F.col("__day").cast("timestamp").alias("range_start"),
        F.date_add("__day", 1).cast("timestamp").alias("range_end"),
    ).distinct()
    return ct.source_containment(bars.drop("__day"), sources)


@query(
    "quality_manifest",
    "source_key i:row_count t:first_open_time t:last_close_time i:duplicate_key_count",
    """SELECT source_key, count(*) AS row_count, min(open_time) AS first_open_time,
        max(open_time) + INTERVAL 1 HOUR AS last_close_time,
        count(*) - count(DISTINCT (symbol, open_time)) AS duplicate_key_count
        FROM (SELECT upper(event_type) AS symbol, date_trunc('hour', ts) AS open_time,
            upper(event_type) || '/' || strftime(ts, '%Y-%m-%d') AS source_key FROM events) GROUP BY 1""",
)
def _(v: Views):
    rows = v.table("events").select(
        F.upper("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").alias("open_time"),
        (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).alias("close_time"),
        F.concat_ws("/", F.upper("event_type"), F.to_date("ts").cast("string")).alias("source_key"),
    )
    return ct.quality_manifest(rows)


@query(
    "lookup_m2o",
    "i:o_orderkey c_mktsegment n_name",
    "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def _(v: Views):
    customers = v.table("customer").withColumnRenamed("c_custkey", "o_custkey")
    nations = v.table("nation").withColumnRenamed("n_nationkey", "c_nationkey")
    placed = ct.lookup_many_to_one(v.table("orders"), customers, ["o_custkey"])
    return ct.lookup_many_to_one(placed, nations, ["c_nationkey"])


# --- features ----------------------------------------------------------------------------------------


@query(
    "continuity_segment",
    "symbol t:open_time i:continuity_segment",
    "SELECT symbol, open_time, seg AS continuity_segment FROM seg",
    "seg",
)
def _(v: Views):
    return add_continuity_segment(v.bars_4h, GRID)


def _window(v: Views):
    return add_window_features(v.bars_4h, SPEC, GRID)


def _w(k: int, ahead: bool = False) -> str:
    return f"PARTITION BY symbol, seg ORDER BY open_time ROWS BETWEEN {k} PRECEDING AND " + (
        "CURRENT ROW" if ahead else "1 PRECEDING"
    )


_LAGS = ", ".join(
    f"close / lag(close, {k}) OVER (PARTITION BY symbol, seg ORDER BY open_time) - 1 AS return_{n}"
    for n, k in (("1d", 6), ("3d", 18), ("7d", 42))
)
_SUMS = f"(SELECT *, CASE WHEN rn >= 6 THEN sum(quote_volume) OVER ({_w(5, True)}) END AS s24 FROM seg)"
_V4 = (
    f"(SELECT *, CASE WHEN rn > 30 THEN quantile_cont(quote_volume, 0.5) OVER ({_w(30)}) END AS b4 FROM seg)"
)
_V24 = f"(SELECT *, CASE WHEN rn >= 26 THEN quantile_cont(s24, 0.5) OVER ({_w(20)}) END AS b24 FROM {_SUMS})"
_HIGH = f"(SELECT *, CASE WHEN rn > 120 THEN max(high) OVER ({_w(120)}) END AS ph FROM seg)"
_TR = """(SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
    FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, seg ORDER BY open_time) AS pc FROM seg))"""


@query(
    "returns_lag", "symbol t:open_time d:return_1d d:return_3d d:return_7d",
    f"SELECT symbol, open_time, {_LAGS} FROM seg", "seg",
)
def _(v: Views):
    return _window(v)


@query(
    "vol_exp_4h", "symbol t:open_time d:vol_exp_4h_baseline d:vol_exp_4h_raw",
    f"SELECT symbol, open_time, b4 AS vol_exp_4h_baseline, CASE WHEN b4 > 0 THEN quote_volume / b4 END "
    f"AS vol_exp_4h_raw FROM {_V4}", "seg",
)
def _(v: Views):
    return _window(v)


@query(
    "rolling_sum_24h", "symbol t:open_time d:current_24h_quote_volume",
    f"SELECT symbol, open_time, s24 AS current_24h_quote_volume FROM {_SUMS}", "seg",
)
def _(v: Views):
    return _window(v)


@query(
    "vol_exp_24h", "symbol t:open_time d:vol_exp_24h_baseline d:vol_exp_24h_raw",
    f"SELECT symbol, open_time, b24 AS vol_exp_24h_baseline, CASE WHEN b24 > 0 THEN s24 / b24 END "
    f"AS vol_exp_24h_raw FROM {_V24}", "seg",
)
def _(v: Views):
    return _window(v)


@query(
    "liquidity_median", "symbol t:open_time d:median_30d_daily_quote_volume",
    f"SELECT symbol, open_time, CASE WHEN rn >= 65 THEN quantile_cont(s24, 0.5) OVER ({_w(59, True)}) END "
    f"AS median_30d_daily_quote_volume FROM {_SUMS}", "seg",
)
def _(v: Views):
    return _window(v)


@query(
    "prev_high", "symbol t:open_time d:prev_20d_high",
    f"SELECT symbol, open_time, ph AS prev_20d_high FROM {_HIGH}", "seg",
)
def _(v: Views):
    return _window(v)


@query(
    "true_range", "symbol t:open_time d:true_range",
    f"SELECT symbol, open_time, tr AS true_range FROM {_TR}", "seg",
)
def _(v: Views):
    return _window(v)


def _tagged(v: Views):
    return add_time_series_features(v.bars_4h, SPEC, GRID)


def _atr_sql(period: int) -> str:
    return f"""(
    WITH RECURSIVE base AS (SELECT * FROM {_TR}), walk AS (
        SELECT symbol, seg, CAST({period} AS BIGINT) AS rn, avg(tr) AS atr FROM base WHERE rn <= {period}
            GROUP BY symbol, seg HAVING count(*) = {period}
        UNION ALL
        SELECT b.symbol, b.seg, b.rn, ({period - 1} * walk.atr + b.tr) / {period} FROM walk JOIN base b
            ON b.symbol = walk.symbol AND b.seg = walk.seg AND b.rn = walk.rn + 1)
    SELECT base.*, walk.atr FROM base LEFT JOIN walk USING (symbol, seg, rn))"""


_ATR = _atr_sql(14)
_BRK = f"""(SELECT *, coalesce(close > ph AND lag(close) OVER s <= lag(ph) OVER s, false) AS fresh
    FROM (SELECT *, CASE WHEN rn > 120 THEN max(high) OVER ({_w(120)}) END AS ph FROM {_ATR})
    WINDOW s AS (PARTITION BY symbol, seg ORDER BY open_time))"""
_STATE = f"""(SELECT *, last_value(CASE WHEN fresh THEN ph END IGNORE NULLS) OVER r AS lvl,
        rn - last_value(CASE WHEN fresh THEN rn END IGNORE NULLS) OVER r AS since
    FROM {_BRK} WINDOW r AS (PARTITION BY symbol, seg ORDER BY open_time
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "wilder_atr", "symbol t:open_time d:atr_14",
    f"SELECT symbol, open_time, atr AS atr_14 FROM {_ATR}", "seg",
)
def _(v: Views):
    return _tagged(v)


# An average that forgets within a few bars beside a look-back of hundreds. With a period of 2, exact values would
# lie on ties of the rounding to 8 decimals.
_FAST = FeatureSpec(atr_period=3, liquidity=600)


@query(
    "wilder_atr_fast", "symbol t:open_time d:atr_14",
    f"SELECT symbol, open_time, atr AS atr_14 FROM {_atr_sql(3)}", "seg",
)
def _(v: Views):
    return add_time_series_features(v.bars_4h, _FAST, GRID)


@query(
    "distance_atr", "symbol t:open_time d:distance_to_20d_high_atr",
    f"SELECT symbol, open_time, CASE WHEN atr > 0 THEN (ph - close) / atr END AS distance_to_20d_high_atr FROM {_BRK}",
    "seg",
)
def _(v: Views):
    return _tagged(v)


@query(
    "fresh_breakout", "symbol t:open_time is_fresh_breakout",
    f"SELECT symbol, open_time, fresh AS is_fresh_breakout FROM {_BRK}", "seg",
)
def _(v: Views):
    return _window(v)


@query(
    "breakout_level_ffill", "symbol t:open_time d:breakout_level",
    f"SELECT symbol, open_time, lvl AS breakout_level FROM {_STATE}", "seg",
)
def _(v: Views):
    return _tagged(v)


@query(
    "bars_since_event", "symbol t:open_time d:bars_since_breakout",
    f"SELECT symbol, open_time, since AS bars_since_breakout FROM {_STATE}", "seg",
)
def _(v: Views):
    return _tagged(v)


@query(
    "stage_tag", "symbol t:open_time stage",
    f"""SELECT symbol, open_time, CASE WHEN fresh THEN 'TRIGGERED'
        WHEN since BETWEEN 1 AND 3 AND (close - lvl) / nullif(atr, 0) <= 2 THEN 'EARLY_TREND'
        WHEN lvl IS NOT NULL AND (close - lvl) / nullif(atr, 0) > 2 THEN 'EXTENDED'
        WHEN (ph - close) / nullif(atr, 0) BETWEEN 0 AND 0.75 THEN 'APPROACHING' ELSE 'OTHER' END AS stage
        FROM {_STATE}""", "seg",
)
def _(v: Views):
    return _tagged(v)


# --- ranks -------------------------------------------------------------------------------------------

# Component sources that every bar of the wide panel has: prices and volumes of the bar itself.
_SOURCES = {
    "return_1d": ("close", "close"), "return_3d": ("open", "open"), "return_7d": ("high", "high"),
    "vol_exp_4h_raw": ("quote_volume", "quote_volume"), "vol_exp_24h_raw": ("trade_count", "trade_count"),
    "median_30d_daily_quote_volume": ("low", "low"),
}


def _rank_input(v: Views):
    return v.panel.withColumns({name: F.col(src[0]).cast("double") for name, src in _SOURCES.items()})


def _pct_sql(col: str) -> str:
    part = f"PARTITION BY open_time, is_eligible AND NOT is_benchmark, {col} IS NULL"
    return (
        f"CASE WHEN is_eligible AND NOT is_benchmark AND {col} IS NOT NULL THEN "
        f"(rank() OVER ({part} ORDER BY {col}) + (count(*) OVER ({part}, {col}) - 1) / 2.0) "
        f"/ count(*) OVER ({part}) END"
    )


_RANKED = (
    "(SELECT *, "
    + ", ".join(
        f"{_pct_sql(src[1])} AS {target}"
        for (name, src), target in zip(
            _SOURCES.items(),
            ["rs_1d_pct", "rs_3d_pct", "rs_7d_pct", "vol_exp_4h_pct", "vol_exp_24h_pct", "liquidity_pct"],
        )
    )
    + " FROM panel)"
)
_SCORED = (
    f"(SELECT *, (rs_1d_pct + rs_3d_pct + rs_7d_pct + vol_exp_4h_pct + vol_exp_24h_pct) / 5 AS hot_score FROM {_RANKED})"
)
_DECILED = f"""(SELECT *, CASE WHEN hot_score_pct IS NOT NULL
        THEN greatest(1, least(10, CAST(ceil(hot_score_pct * 10) AS INTEGER))) END AS hot_decile
    FROM (SELECT *, {_pct_sql('hot_score')} AS hot_score_pct FROM {_SCORED}))"""
_HOT = f"(SELECT *, coalesce(hot_decile = 10, false) AS is_hot FROM {_DECILED})"


@query(
    "pct_rank_avg",
    "symbol t:open_time d:rs_1d_pct d:rs_3d_pct d:rs_7d_pct d:vol_exp_4h_pct d:vol_exp_24h_pct d:liquidity_pct",
    f"SELECT * FROM {_RANKED}", "panel",
)
def _(v: Views):
    return add_percentiles(_rank_input(v), RANK_SOURCES)


@query(
    "pct_rank_avg_split", "symbol t:open_time d:vol_exp_4h_pct d:vol_exp_24h_pct",
    f"SELECT symbol, open_time, vol_exp_4h_pct, vol_exp_24h_pct FROM {_RANKED}", "panel",
)
def _(v: Views):
    # The form used for cross-sections too large for one window task.
    sources = {"vol_exp_4h_raw": "vol_exp_4h_pct", "vol_exp_24h_raw": "vol_exp_24h_pct"}
    return add_percentiles(_rank_input(v), sources)


def _ranks(v: Views):
    return add_cross_sectional_ranks(_rank_input(v))


@query("hot_score", "symbol t:open_time d:hot_score", f"SELECT * FROM {_SCORED}", "panel")
def _(v: Views):
    return _ranks(v)


@query(
    "decile", "symbol t:open_time d:hot_score_pct d:hot_decile", f"SELECT * FROM {_DECILED}", "panel"
)
def _(v: Views):
    return _ranks(v)


@query("top_bucket_flag", "symbol t:open_time is_hot", f"SELECT * FROM {_HOT}", "panel")
def _(v: Views):
    return _ranks(v)


@query(
    "top_decile", "symbol t:open_time d:hot_score", f"SELECT * FROM {_HOT} WHERE is_hot", "panel"
)
def _(v: Views):
    return top_decile(_ranks(v))


@query(
    "order_panel", "t:open_time symbol d:close",
    "SELECT open_time, symbol, close FROM bars_4h ORDER BY open_time, symbol", "bars_4h",
)
def _(v: Views):
    return v.bars_4h.orderBy("open_time", "symbol")


_FLAGGED = "(SELECT *, coalesce(quote_volume > 60, false) AS is_hot FROM bars_4h_wide)"
_EPISODES = f"""(SELECT *, CASE WHEN is_hot THEN symbol || '-HOT-' ||
        lpad(CAST(sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY open_time) AS VARCHAR), 6, '0')
        END AS episode_id
    FROM (SELECT *, is_hot AND NOT coalesce(lag(is_hot) OVER s AND open_time - lag(open_time) OVER s = INTERVAL 4 HOUR, false) AS start
        FROM {_FLAGGED} WINDOW s AS (PARTITION BY symbol ORDER BY open_time)))"""


@query(
    "episodes", "symbol t:open_time is_hot is_episode_start episode_id",
    f"SELECT symbol, open_time, is_hot, start AS is_episode_start, episode_id FROM {_EPISODES}",
    "bars_4h_wide",
)
def _(v: Views):
    flagged = v.bars_4h_wide.select(
        "symbol", "open_time", (F.col("quote_volume") > 60).alias("is_hot")
    )
    return add_episodes(flagged, GRID)


# --- splits and labels -----------------------------------------------------------------------------


@query(
    "split_classify", "i:event_id split",
    f"SELECT event_id, {SPLIT_SQL.format(t='ts - INTERVAL 1 DAY')} AS split FROM events",
)
def _(v: Views):
    shifted = v.table("events").withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    return with_split(shifted, SPLITS, "ts")


@query(
    "split_counts", "split i:row_count",
    f"SELECT {SPLIT_SQL.format(t='ts - INTERVAL 1 DAY')} AS split, count(*) AS row_count FROM events GROUP BY 1",
)
def _(v: Views):
    shifted = v.table("events").withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    return split_counts(shifted, SPLITS, "ts")


@query(
    "split_guard", "split allowed",
    f"SELECT DISTINCT split, split = 'development' AS allowed FROM (SELECT {SPLIT_SQL.format(t='ts')} AS split FROM events)",
)
def _(v: Views):
    # The rows of each split are put before the guard on their own.
    placed = with_split(v.table("events"), SPLITS, "ts")
    allowed = F.lit(None).cast("boolean")
    for name, _start, _end in SPLITS:
        try:
            guard_splits(placed.filter(F.col("split") == name), SPLITS, time="ts")
            passed = True
        except SplitAccessError:
            passed = False
        allowed = F.when(F.col("split") == name, passed).otherwise(allowed)
    return placed.select("split").distinct().withColumn("allowed", allowed)


@query(
    "horizon_in_split", "i:event_id fits",
    f"SELECT event_id, coalesce({SPLIT_SQL.format(t='ts')} = {SPLIT_SQL.format(t='(ts + INTERVAL 3 DAY)')}, false) AS fits FROM events",
)
def _(v: Views):
    later = F.col("ts") + F.expr("INTERVAL 3 DAYS")
    return v.table("events").withColumn("fits", horizon_in_split(F.col("ts"), later, SPLITS))


@query(
    "window_filter", "i:event_id t:ts",
    "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
)
def _(v: Views):
    renamed = v.table("events").withColumnRenamed("ts", "open_time")
    window = analysis_window(renamed, "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return window.withColumnRenamed("open_time", "ts")


def _labels_sql(extra: str = "") -> str:
    parts = []
    for n, k in (("1d", 6), ("3d", 18), ("7d", 42)):
        end = f"lead(open_time, {k}) OVER s"
        fits = (
            f"coalesce({end} - open_time = INTERVAL {4 * k} HOUR AND "
            f"{SPLIT_SQL.format(t='open_time')} = {SPLIT_SQL.format(t='(' + end + ')')}, false)"
        )
        parts.append(f"{fits} AS ok_{n}, lead(close, {k}) OVER s AS close_{n}")
        if n != "1d":
            f = f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
            parts.append(f"max(high) OVER {f} AS top_{n}, min(low) OVER {f} AS low_{n}")
    return (
        f"(SELECT *, {', '.join(parts)} FROM {extra or 'panel'} "
        "WINDOW s AS (PARTITION BY symbol ORDER BY open_time))"
    )


_FWD = (
    "(SELECT *, "
    + ", ".join(
        f"CASE WHEN ok_{n} THEN close_{n} / close - 1 END AS fwd_return_{n}, "
        f"CASE WHEN ok_{n} THEN {k} ELSE 0 END AS future_bar_count_{n}"
        for n, k in (("1d", 6), ("3d", 18), ("7d", 42))
    )
    + f" FROM {_labels_sql()})"
)


def _labelled(v: Views):
    # A flat average range stands in where a query is about labels only.
    return add_symbol_labels(v.panel.withColumn("atr_14", F.col("high") - F.col("low")), SPLITS, GRID)


@query(
    "fwd_return", "symbol t:open_time d:fwd_return_1d d:fwd_return_3d d:fwd_return_7d",
    f"SELECT * FROM {_FWD}", "panel",
)
def _(v: Views):
    return _labelled(v)


@query(
    "complete_window", "symbol t:open_time complete_1d complete_3d complete_7d",
    f"SELECT symbol, open_time, ok_1d AS complete_1d, ok_3d AS complete_3d, ok_7d AS complete_7d FROM {_labels_sql()}",
    "panel",
)
def _(v: Views):
    done = _labelled(v)
    return done.withColumns({f"complete_{h}": F.col(f"future_bar_count_{h}") > 0 for h in ("1d", "3d", "7d")})


@query(
    "future_bar_count", "symbol t:open_time i:future_bar_count_1d i:future_bar_count_3d i:future_bar_count_7d",
    f"SELECT * FROM {_FWD}", "panel",
)
def _(v: Views):
    return _labelled(v)


@query(
    "mfe_mae", "symbol t:open_time d:mfe_3d d:mae_3d d:mfe_7d d:mae_7d",
    "SELECT symbol, open_time, "
    + ", ".join(
        f"CASE WHEN ok_{n} THEN top_{n} / close - 1 END AS mfe_{n}, CASE WHEN ok_{n} THEN low_{n} / close - 1 END AS mae_{n}"
        for n in ("3d", "7d")
    )
    + f" FROM {_labels_sql()}",
    "panel",
)
def _(v: Views):
    return _labelled(v)


def _barrier_sql(n: str, k: int) -> str:
    return f"""SELECT p.symbol, p.open_time, CASE
            WHEN NOT p.ok_{n} OR NOT (p.high - p.low > 0) THEN NULL
            WHEN h.up IS NULL AND h.down IS NULL THEN 'censored'
            WHEN h.up = h.down THEN 'ambiguous'
            WHEN h.down IS NULL OR h.up < h.down THEN 'success' ELSE 'failure' END AS barrier_{n}
        FROM {_labels_sql()} p LEFT JOIN (
            SELECT a.symbol, a.open_time,
                min(CASE WHEN b.high >= a.close + 2.0 * (a.high - a.low) THEN b.open_time END) AS up,
                min(CASE WHEN b.low <= a.close - 1.0 * (a.high - a.low) THEN b.open_time END) AS down
            FROM panel a JOIN panel b ON a.symbol = b.symbol AND b.open_time > a.open_time
                AND b.open_time <= a.open_time + INTERVAL {4 * k} HOUR
            GROUP BY 1, 2) h USING (symbol, open_time)"""


@query(
    "barrier_label", "symbol t:open_time barrier_3d barrier_7d",
    f"SELECT symbol, open_time, barrier_3d, barrier_7d FROM ({_barrier_sql('3d', 18)}) "
    f"JOIN ({_barrier_sql('7d', 42)}) USING (symbol, open_time)",
    "panel",
)
def _(v: Views):
    return _labelled(v)


@query(
    "benchmark_relative", "symbol t:open_time d:btc_fwd_return_1d d:btc_relative_return_1d d:btc_relative_return_3d d:btc_relative_return_7d",
    "SELECT a.symbol, a.open_time, b.fwd_return_1d AS btc_fwd_return_1d, "
    + ", ".join(f"a.fwd_return_{n} - b.fwd_return_{n} AS btc_relative_return_{n}" for n in ("1d", "3d", "7d"))
    + f" FROM {_FWD} a LEFT JOIN (SELECT * FROM {_FWD} WHERE symbol = '{BENCHMARK}') b ON a.open_time = b.open_time",
    "panel",
)
def _(v: Views):
    return add_benchmark_relative(_labelled(v), BENCHMARK)


_EXCESS = (
    "SELECT a.symbol, a.open_time, "
    + ", ".join(
        f"a.fwd_return_{n} - m.m_{n} AS cross_sectional_excess_return_{n}" for n in ("1d", "3d", "7d")
    )
    + f" FROM {_FWD} a LEFT JOIN (SELECT open_time, "
    + ", ".join(f"median(fwd_return_{n}) AS m_{n}" for n in ("1d", "3d", "7d"))
    + f" FROM {_FWD} WHERE is_eligible AND NOT is_benchmark GROUP BY 1) m ON a.open_time = m.open_time"
)
_EXCESS_COLS = " ".join(f"d:cross_sectional_excess_return_{n}" for n in ("1d", "3d", "7d"))


@query("xs_median_excess", f"symbol t:open_time {_EXCESS_COLS}", _EXCESS, "panel")
def _(v: Views):
    return add_median_excess(_labelled(v))


@query("xs_median_excess_split", f"symbol t:open_time {_EXCESS_COLS}", _EXCESS, "panel")
def _(v: Views):
    return add_median_excess(_labelled(v))


# --- quality -----------------------------------------------------------------------------------------


@query(
    "gate_metrics", "gate passed i:detail_row_count i:detail_rejected_group_count",
    f"""WITH g AS ({_GROUPS}) SELECT 'completed_bars' AS gate, count(*) > 0 AS passed,
        sum(CASE WHEN slots = '0,1,2,3' THEN 1 ELSE 0 END) AS detail_row_count,
        sum(CASE WHEN slots <> '0,1,2,3' THEN 1 ELSE 0 END) AS detail_rejected_group_count FROM g
        UNION ALL SELECT 'all_accepted', count(*) > 0 AND bool_and(n = 4), count(*), 0 FROM g""",
    "bars_1h",
)
def _(v: Views):
    # The same groups once as judged and once with every group waved through.
    groups = rollup_groups(v.bars_1h)
    forced = ql.rollup_gate(groups.withColumn("is_accepted", F.lit(True))).withColumn("gate", F.lit("all_accepted"))
    return ql.rollup_gate(groups).unionByName(forced)


@query(
    "frame_fingerprint", "i:row_count hash_sum i:hash_xor",
    """SELECT count(*) AS row_count, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM (
        SELECT CAST('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
            CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority)), 1, 15) AS BIGINT) AS h
        FROM orders)""",
)
def _(v: Views):
    # The row hash is one that SQL has too: the leading 60 bits of an MD5 over the row as text.
    row = F.concat_ws(
        "|", "o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"),
        F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority",
    )
    hashed = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("bigint")
    done = ql.frame_fingerprint(v.table("orders"), hashed=hashed)
    return done.withColumn("hash_sum", F.col("hash_sum").cast("string"))


@query(
    "frame_fingerprint_rows", "i:row_count order_invariant",
    "SELECT count(*) AS row_count, true AS order_invariant FROM orders",
)
def _(v: Views):
    # The built-in row hash has no SQL counterpart; its invariance under reshuffling has.
    orders = v.table("orders")
    one = ql.frame_fingerprint(orders).select("row_count", F.struct("*").alias("a"))
    other = ql.frame_fingerprint(orders.repartition("o_custkey").sortWithinPartitions("o_totalprice"))
    both = one.join(F.broadcast(other.select(F.struct("*").alias("b"))))  # one row each
    return both.withColumn("order_invariant", F.col("a") == F.col("b"))


@query(
    "set_fingerprint", "i:identity_count i:repeated_identities",
    "SELECT count(*) AS identity_count, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS repeated_identities "
    "FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)",
)
def _(v: Views):
    return ql.set_fingerprint(v.table("orders"), "o_custkey")


@query(
    "replay_equal", "pair i:stored_rows i:replayed_rows is_equal",
    "SELECT 'same' AS pair, count(*) AS stored_rows, count(*) AS replayed_rows, true AS is_equal FROM lineitem "
    "UNION ALL SELECT 'changed', count(*), count(*), false FROM lineitem",
)
def _(v: Views):
    items = v.table("lineitem")
    cheaper = items.withColumn(
        "l_discount", F.when(F.col("l_returnflag") == "R", F.col("l_discount") + 0.01).otherwise(F.col("l_discount"))
    )
    same = ql.replay_equal(items, items.repartition("l_suppkey")).withColumn("pair", F.lit("same"))
    changed = ql.replay_equal(items, cheaper).withColumn("pair", F.lit("changed"))
    return same.unionByName(changed)


@query(
    "row_difference", "i:l_orderkey i:l_linenumber d:l_tax side",
    "SELECT l_orderkey, l_linenumber, l_tax, 'stored' AS side FROM lineitem WHERE l_returnflag = 'R' "
    "UNION ALL SELECT l_orderkey, l_linenumber, l_tax + 1, 'replayed' FROM lineitem WHERE l_returnflag = 'R'",
)
def _(v: Views):
    stored = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag")
    taxed = F.when(F.col("l_returnflag") == "R", F.col("l_tax") + 1).otherwise(F.col("l_tax"))
    return ql.row_difference(stored, stored.withColumn("l_tax", taxed))


@query(
    "set_equal", "i:p_partkey side",
    """SELECT p_partkey, 'planned_only' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey + 5 FROM lineitem)
        UNION ALL SELECT DISTINCT l_partkey + 5, 'actual_only' FROM lineitem
        WHERE l_partkey + 5 NOT IN (SELECT p_partkey FROM part)""",
)
def _(v: Views):
    # Order lines shifted by five part keys: some parts are never hit, some keys are no parts.
    return ql.set_difference(
        v.table("part"), v.table("lineitem").select((F.col("l_partkey") + 5).alias("p_partkey")), ["p_partkey"]
    )


@query(
    "freshness_horizon", "dataset t:common_valid_through i:beyond_corpus is_fresh",
    """SELECT dataset, min(t) AS common_valid_through,
        sum(CASE WHEN component = 'purchase' AND t > TIMESTAMP '2024-01-30 12:00:00' THEN 1 ELSE 0 END) AS beyond_corpus,
        min(t) >= TIMESTAMP '2024-01-28' AND sum(CASE WHEN component = 'purchase' AND t > TIMESTAMP '2024-01-30 12:00:00' THEN 1 ELSE 0 END) = 0 AS is_fresh
        FROM (SELECT CAST(user_id AS VARCHAR) AS dataset, event_type AS component, max(ts) AS t FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def _(v: Views):
    marks = v.table("events").groupBy(
        F.col("user_id").cast("string").alias("dataset"), F.col("event_type").alias("component")
    ).agg(F.max("ts").alias("valid_through"))
    return ql.freshness_horizon(marks, at("2024-01-28 00:00:00"), at("2024-01-30 12:00:00"), "purchase")
