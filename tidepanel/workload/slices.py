"""The flagship plan on daily and 4-hour event bars, and its stage-chain pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators.features import FeatureSpec
from tidepanel.operators.inference import baseline_strata, block_bootstrap, plateau, poisson_thresholds
from tidepanel.operators.quality import observation_gate, slice_audit
from tidepanel.operators.series import Grid
from tidepanel.plans.slice import SliceSpec, build_slice
from tidepanel.plans.stages import StagePaths, replay_gate, stage_observations
from tidepanel.operators.eligibility import apply_eligibility, eligibility_projection
from tidepanel.operators.rollup import rollup_strict
from tidepanel.sources.sinks import (
    read_splits,
    read_stage,
    write_by_split,
    write_per_symbol,
    write_stage,
)
from tidepanel.session import materialize, scratch_path
from tidepanel.workload.registry import query
from tidepanel.workload.views import BENCHMARK, SPLIT_SQL, SPLITS, SQL_VIEWS, Views

DAILY = SliceSpec(
    grid=Grid(interval_seconds=86_400),
    features=FeatureSpec(
        returns={"1d": 1, "3d": 3, "7d": 7}, volume_base=5, sum_bars=2, sum_base=4, liquidity=5,
        high_bars=10, atr_period=5,
    ),
    horizons={"1d": 1, "3d": 3, "7d": 7},
    splits=tuple(SPLITS),
    minimum_age_days=5,
    benchmark=BENCHMARK,
)
FOUR_HOURS = SliceSpec(
    features=FeatureSpec(liquidity=60), splits=tuple(SPLITS), minimum_age_days=5, benchmark=BENCHMARK
)
ALL_SPLITS = [name for name, _, _ in SPLITS]

COLUMNS = (
    "symbol t:open_time d:close d:contract_age_days is_eligible is_benchmark i:continuity_segment "
    "d:return_1d d:return_7d d:vol_exp_4h_raw d:vol_exp_24h_raw d:median_30d_daily_quote_volume "
    "d:prev_20d_high d:atr_14 d:distance_to_20d_high_atr stage d:rs_1d_pct d:rs_7d_pct "
    "d:vol_exp_4h_pct d:vol_exp_24h_pct d:liquidity_pct d:hot_score d:hot_score_pct d:hot_decile "
    "is_hot is_episode_start episode_id d:fwd_return_1d d:fwd_return_7d i:future_bar_count_3d "
    "d:mfe_3d d:mae_7d barrier_3d barrier_7d d:btc_relative_return_3d "
    "d:cross_sectional_excess_return_1d d:cross_sectional_excess_return_7d"
)


def _slice_views(tag: str, bars: str, contracts: str, spec: SliceSpec) -> str:
    """Register the SQL form of the slice as a chain of views; returns the last one's name."""
    f, hours = spec.features, spec.grid.interval_seconds // 3600
    step = f"INTERVAL {hours} HOUR"
    p = f.atr_period

    def add(name: str, needs: str, sql: str) -> str:
        SQL_VIEWS[f"{tag}_{name}"] = (needs, sql)
        return f"{tag}_{name}"

    elig = add(
        "elig", f"{bars} {contracts}",
        f"""SELECT b.*, epoch_us(close_time) / 86400000000.0 - epoch_us(anchor) / 86400000000.0 AS contract_age_days,
            b.symbol <> '{BENCHMARK}' AND c.status <> 'unresolved' AND close_time - anchor >= INTERVAL {spec.minimum_age_days} DAY
                AND (announced IS NULL OR close_time < announced) AS is_eligible,
            b.symbol = '{BENCHMARK}' AS is_benchmark
        FROM {bars} b JOIN {contracts} c USING (symbol) WHERE c.scoped""",
    )
    seg = add(
        "seg", elig,
        f"""SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY open_time) AS rn,
            lag(close) OVER (PARTITION BY symbol, seg ORDER BY open_time) AS pc
        FROM (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY open_time) AS seg
            FROM (SELECT *, CASE WHEN open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) = {step} THEN 0 ELSE 1 END AS brk FROM {elig}))""",
    )

    def frame(n: int, through: int) -> str:
        end = "CURRENT ROW" if through == 0 else "1 PRECEDING"
        return f"OVER (PARTITION BY symbol, seg ORDER BY open_time ROWS BETWEEN {n} PRECEDING AND {end})"

    lags = ", ".join(
        f"close / lag(close, {k}) OVER (PARTITION BY symbol, seg ORDER BY open_time) - 1 AS return_{n}"
        for n, k in f.returns.items()
    )
    one = add(
        "one", seg,
        f"""SELECT *, {lags}, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
            CASE WHEN rn > {f.volume_base} THEN quantile_cont(quote_volume, 0.5) {frame(f.volume_base, -1)} END AS b4,
            CASE WHEN rn >= {f.sum_bars} THEN sum(quote_volume) {frame(f.sum_bars - 1, 0)} END AS s24,
            CASE WHEN rn > {f.high_bars} THEN max(high) {frame(f.high_bars, -1)} END AS prev_20d_high
        FROM {seg}""",
    )
    walk = add(
        "walk", one,
        f"""SELECT symbol, seg, CAST({p} AS BIGINT) AS rn, avg(tr) AS atr FROM {one} WHERE rn <= {p}
            GROUP BY symbol, seg HAVING count(*) = {p}
        UNION ALL SELECT b.symbol, b.seg, b.rn, ({p - 1} * w.atr + b.tr) / {p} FROM {tag}_walk w JOIN {one} b
            ON b.symbol = w.symbol AND b.seg = w.seg AND b.rn = w.rn + 1""",
    )
    two = add(
        "two", f"{one} {walk}",
        f"""SELECT *, CASE WHEN b4 > 0 THEN quote_volume / b4 END AS vol_exp_4h_raw,
            CASE WHEN b24 > 0 THEN s24 / b24 END AS vol_exp_24h_raw,
            coalesce(close > prev_20d_high AND pc <= pph, false) AS fresh
        FROM (SELECT o.*, w.atr AS atr_14,
                lag(prev_20d_high) OVER (PARTITION BY o.symbol, o.seg ORDER BY open_time) AS pph,
                CASE WHEN o.rn >= {f.sum_bars + f.sum_base} THEN quantile_cont(s24, 0.5) OVER (PARTITION BY o.symbol, o.seg ORDER BY open_time ROWS BETWEEN {f.sum_base} PRECEDING AND 1 PRECEDING) END AS b24,
                CASE WHEN o.rn >= {f.sum_bars + f.liquidity - 1} THEN quantile_cont(s24, 0.5) OVER (PARTITION BY o.symbol, o.seg ORDER BY open_time ROWS BETWEEN {f.liquidity - 1} PRECEDING AND CURRENT ROW) END AS median_30d_daily_quote_volume
            FROM {one} o LEFT JOIN {walk} w ON o.symbol = w.symbol AND o.seg = w.seg AND o.rn = w.rn)""",
    )
    three = add(
        "three", two,
        f"""SELECT *, CASE WHEN fresh THEN 'TRIGGERED'
            WHEN since BETWEEN 1 AND {f.early_bars} AND (close - lvl) / nullif(atr_14, 0) <= {f.extended_atr} THEN 'EARLY_TREND'
            WHEN lvl IS NOT NULL AND (close - lvl) / nullif(atr_14, 0) > {f.extended_atr} THEN 'EXTENDED'
            WHEN distance_to_20d_high_atr BETWEEN 0 AND 0.75 THEN 'APPROACHING' ELSE 'OTHER' END AS stage
        FROM (SELECT *, (prev_20d_high - close) / nullif(atr_14, 0) AS distance_to_20d_high_atr,
                last_value(CASE WHEN fresh THEN prev_20d_high END IGNORE NULLS) OVER r AS lvl,
                rn - last_value(CASE WHEN fresh THEN rn END IGNORE NULLS) OVER r AS since
            FROM {two} WINDOW r AS (PARTITION BY symbol, seg ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    )

    def pct(col: str) -> str:
        part = f"PARTITION BY open_time, is_eligible AND NOT is_benchmark, {col} IS NULL"
        return (
            f"CASE WHEN is_eligible AND NOT is_benchmark AND {col} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {col}) "
            f"+ (count(*) OVER ({part}, {col}) - 1) / 2.0) / count(*) OVER ({part}) END"
        )

    targets = {
        "return_1d": "rs_1d_pct", "return_3d": "rs_3d_pct", "return_7d": "rs_7d_pct",
        "vol_exp_4h_raw": "vol_exp_4h_pct", "vol_exp_24h_raw": "vol_exp_24h_pct",
        "median_30d_daily_quote_volume": "liquidity_pct",
    }
    ranks = ", ".join(f"{pct(s)} AS {t}" for s, t in targets.items())
    scored = add(
        "scored", three,
        f"""SELECT *, CASE WHEN hot_score_pct IS NOT NULL THEN greatest(1, least(10, CAST(ceil(hot_score_pct * 10) AS INTEGER))) END AS hot_decile
        FROM (SELECT *, {pct('hot_score')} AS hot_score_pct FROM (SELECT *,
            (rs_1d_pct + rs_3d_pct + rs_7d_pct + vol_exp_4h_pct + vol_exp_24h_pct) / 5 AS hot_score
            FROM (SELECT *, {ranks} FROM {three})))""",
    )
    marks = []
    for n, k in spec.horizons.items():
        end = f"lead(open_time, {k}) OVER s"
        marks.append(
            f"coalesce({end} - open_time = INTERVAL {hours * k} HOUR AND {SPLIT_SQL.format(t='open_time')} = "
            f"{SPLIT_SQL.format(t='(' + end + ')')}, false) AS ok_{n}, lead(close, {k}) OVER s AS close_{n}"
        )
        if n in spec.path_horizons:
            g = f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
            marks.append(f"max(high) OVER {g} AS top_{n}, min(low) OVER {g} AS low_{n}")
    hot = add(
        "hot", scored,
        f"""SELECT *, is_hot AND NOT coalesce(lag(is_hot) OVER s AND open_time - lag(open_time) OVER s = {step}, false) AS is_episode_start,
            {', '.join(marks)}
        FROM (SELECT *, coalesce(hot_decile = 10, false) AS is_hot FROM {scored})
        WINDOW s AS (PARTITION BY symbol ORDER BY open_time)""",
    )
    outs = []
    for n, k in spec.horizons.items():
        outs.append(
            f"CASE WHEN ok_{n} THEN close_{n} / close - 1 END AS fwd_return_{n}, CASE WHEN ok_{n} THEN {k} ELSE 0 END AS future_bar_count_{n}"
        )
        if n in spec.path_horizons:
            outs.append(f"CASE WHEN ok_{n} THEN top_{n} / close - 1 END AS mfe_{n}, CASE WHEN ok_{n} THEN low_{n} / close - 1 END AS mae_{n}")
    out = add(
        "out", hot,
        f"""SELECT *, {', '.join(outs)}, seg AS continuity_segment,
            CASE WHEN is_hot THEN symbol || '-HOT-' || lpad(CAST(sum(CASE WHEN is_episode_start THEN 1 ELSE 0 END)
                OVER (PARTITION BY symbol ORDER BY open_time) AS VARCHAR), 6, '0') END AS episode_id
        FROM {hot}""",
    )
    hits = []
    for n in spec.path_horizons:
        hits.append(f"""
            LEFT JOIN (SELECT a.symbol, a.open_time,
                min(CASE WHEN b.high >= a.close + 2.0 * a.atr_14 THEN b.open_time END) AS up_{n},
                min(CASE WHEN b.low <= a.close - 1.0 * a.atr_14 THEN b.open_time END) AS down_{n}
            FROM {out} a JOIN {out} b ON a.symbol = b.symbol AND b.open_time > a.open_time
                AND b.open_time <= a.open_time + INTERVAL {hours * spec.horizons[n]} HOUR
            GROUP BY 1, 2) h_{n} ON h_{n}.symbol = o.symbol AND h_{n}.open_time = o.open_time""")
    barriers = ", ".join(
        f"""CASE WHEN NOT ok_{n} OR atr_14 IS NULL OR NOT atr_14 > 0 THEN NULL
            WHEN up_{n} IS NULL AND down_{n} IS NULL THEN 'censored' WHEN up_{n} = down_{n} THEN 'ambiguous'
            WHEN down_{n} IS NULL OR up_{n} < down_{n} THEN 'success' ELSE 'failure' END AS barrier_{n}"""
        for n in spec.path_horizons
    )
    relative = ", ".join(
        f"o.fwd_return_{n} - b.r_{n} AS btc_relative_return_{n}, o.fwd_return_{n} - m.m_{n} AS cross_sectional_excess_return_{n}"
        for n in spec.horizons
    )
    firsts = ", ".join(f"fwd_return_{n} AS r_{n}" for n in spec.horizons)
    medians = ", ".join(f"median(fwd_return_{n}) AS m_{n}" for n in spec.horizons)
    return add(
        "final", out,
        f"""SELECT o.*, {barriers}, {relative} FROM {out} o {''.join(hits)}
            LEFT JOIN (SELECT open_time AS bt, {firsts} FROM {out} WHERE symbol = '{BENCHMARK}') b ON b.bt = o.open_time
            LEFT JOIN (SELECT open_time AS mt, {medians} FROM {out} WHERE is_eligible AND NOT is_benchmark GROUP BY 1) m ON m.mt = o.open_time""",
    )


_DAILY_SQL = _slice_views("sd", "bars_1d", "contracts2", DAILY)
_FOUR_SQL = _slice_views("sf", "bars_4h", "contracts2", FOUR_HOURS)


def daily_slice(v: Views):
    return build_slice(v.bars(86_400, 2), v.contracts_of(2), DAILY, allowed=ALL_SPLITS)


def four_hour_slice(v: Views):
    return build_slice(v.bars_4h, v.contracts_of(2), FOUR_HOURS, allowed=ALL_SPLITS)


@query("slice_daily", COLUMNS, f"SELECT * FROM {_DAILY_SQL}", _DAILY_SQL, recursive=True)
def _(v: Views):
    return daily_slice(v)


@query("slice_4h", COLUMNS, f"SELECT * FROM {_FOUR_SQL}", _FOUR_SQL, recursive=True)
def _(v: Views):
    return four_hour_slice(v)


_AUDIT = "i:output_rows i:eligible_altcoin_rows i:complete_hot_score_rows i:complete_3d_label_rows"
_AUDIT_SQL = """SELECT count(*) AS output_rows,
    sum(CASE WHEN is_eligible AND NOT is_benchmark THEN 1 ELSE 0 END) AS eligible_altcoin_rows,
    count(hot_score) AS complete_hot_score_rows, count(fwd_return_3d) AS complete_3d_label_rows FROM """


@query("slice_audit", _AUDIT, _AUDIT_SQL + _DAILY_SQL, _DAILY_SQL, recursive=True)
def _(v: Views):
    return slice_audit(daily_slice(v))


@query(
    "observation_gate", "gate passed i:detail_row_count i:detail_scored_rows",
    f"""SELECT 'observations' AS gate, count(*) > 0 AND count({SPLIT_SQL.format(t='open_time')}) = count(*) AND NOT bool_or(is_benchmark AND is_eligible)
            AND bool_and(is_hot = coalesce(hot_decile = 10, false)) AND bool_and(is_hot = (episode_id IS NOT NULL)) AS passed,
        count(*) AS detail_row_count, count(hot_score) AS detail_scored_rows FROM {_DAILY_SQL}
        UNION ALL SELECT 'all_hot', bool_and(coalesce(hot_decile = 10, false)), count(*), count(hot_score) FROM {_DAILY_SQL}""",
    _DAILY_SQL, recursive=True,
)
def _(v: Views):
    # The same observations once as computed and once with every row called hot.
    done = materialize(daily_slice(v), "observations")
    forced = observation_gate(done.withColumn("is_hot", F.lit(True)), SPLITS).withColumn("gate", F.lit("all_hot"))
    return observation_gate(done, SPLITS).unionByName(forced)


def eligible_daily(v: Views):
    from tidepanel.operators.scope import filter_scope, semi_scope

    scoped = filter_scope(v.contracts_of(2))
    bars = semi_scope(v.bars(86_400, 2), scoped).withColumn("source_hour_count", F.lit(24))
    return eligibility_projection(
        apply_eligibility(bars, scoped, DAILY.minimum_age_days, benchmark=BENCHMARK)
    )


@query(
    "eligibility_projection", "symbol t:open_time d:close d:contract_age_days is_eligible is_eth is_benchmark",
    "SELECT *, symbol = 'ETHUSDT' AS is_eth FROM sd_elig", "sd_elig",
)
def _(v: Views):
    return eligible_daily(v)


@query(
    "stage_observations", f"{COLUMNS} split",
    f"SELECT *, {SPLIT_SQL.format(t='open_time')} AS split FROM {_DAILY_SQL}", _DAILY_SQL, recursive=True,
)
def _(v: Views):
    # Observations from the eligibility stage, stored by split and read back.
    paths = StagePaths(scratch_path(v.spark, "stages"))
    write_stage(eligible_daily(v), paths.of("lifecycle_eligibility"))
    return stage_observations(v.spark, DAILY, paths)


@query(
    "sink_by_split", "symbol t:open_time d:close split",
    f"SELECT symbol, open_time, close, {SPLIT_SQL.format(t='open_time')} AS split FROM bars_4h WHERE {SPLIT_SQL.format(t='open_time')} IN ('development', 'validation')",
    "bars_4h",
)
def _(v: Views):
    path = scratch_path(v.spark, "by-split")
    write_by_split(v.bars_4h, SPLITS, path)
    return read_splits(v.spark, path, ["development", "validation"])


@query("sink_per_symbol", "symbol t:open_time d:close", "SELECT symbol, open_time, close FROM bars_1h", "bars_1h")
def _(v: Views):
    path = scratch_path(v.spark, "per-symbol")
    write_per_symbol(v.bars_1h, path, files_per_symbol=2)
    return v.spark.read.parquet(path)


@query("sink_stage", "symbol t:open_time d:close d:quote_volume", "SELECT * FROM bars_4h", "bars_4h")
def _(v: Views):
    path = scratch_path(v.spark, "stage")
    write_stage(v.bars_4h, path)
    return read_stage(v.spark, path)


SQL_VIEWS["whole"] = (
    "bars_1h",
    """SELECT symbol, epoch_us(open_time) // 14400000000 AS slot, max(trade_count) AS peak FROM bars_1h
        GROUP BY 1, 2 HAVING count(*) = 4""",
)


@query(
    "stage_replay", "gate i:stored_rows is_equal passed",
    """SELECT *, is_equal AND stored_rows > 0 AS passed FROM (
        SELECT 'completed_4h' AS gate, count(*) AS stored_rows, true AS is_equal FROM whole
        UNION ALL SELECT 'completed_4h_of_other_hours', count(*), count(*) = count(*) FILTER (peak < (SELECT max(trade_count) FROM bars_1h)) FROM whole)""",
    "whole",
)
def _(v: Views):
    # The stored stage is replayed from its own hours, then from hours that lack the busiest ones.
    hourly_path, path = scratch_path(v.spark, "hourly"), scratch_path(v.spark, "completed")
    write_stage(v.bars_1h, hourly_path)
    hourly = read_stage(v.spark, hourly_path)
    write_stage(rollup_strict(hourly), path)
    stored = read_stage(v.spark, path)
    busiest = hourly.agg(F.max("trade_count").alias("busiest"))  # one row
    fewer = hourly.join(F.broadcast(busiest), F.col("trade_count") < F.col("busiest")).drop("busiest")
    return replay_gate("completed_4h", stored, rollup_strict(hourly)).unionByName(
        replay_gate("completed_4h_of_other_hours", stored, rollup_strict(fewer))
    )


# --- outcomes ----------------------------------------------------------------------------------------

_LENGTH, _REPLICATES = 3, 100


def _starts_sql(index: str) -> str:
    """Poisson draws of a third from the first 32 bits of an MD5."""
    draw = f"CAST('0x' || substr(md5('block/' || CAST(replicate AS VARCHAR) || '/' || CAST({index} AS VARCHAR)), 1, 8) AS BIGINT)"
    return "(" + " + ".join(f"CASE WHEN {draw} >= {end} THEN 1 ELSE 0 END" for end in poisson_thresholds(1 / _LENGTH)) + ")"


SQL_VIEWS["outcomes"] = (
    _DAILY_SQL,
    f"""SELECT *, fresh AS is_fresh_breakout, CAST(hot_decile AS INTEGER) AS decile, CAST(epoch_us(open_time) // 86400000000 AS BIGINT) AS day FROM {_DAILY_SQL}
        WHERE is_eligible AND NOT is_benchmark AND hot_decile IS NOT NULL AND fwd_return_3d IS NOT NULL""",
)


def _outcomes(v: Views):
    kept = daily_slice(v).filter("is_eligible AND NOT is_benchmark AND hot_decile IS NOT NULL AND fwd_return_3d IS NOT NULL")
    shaped = kept.withColumns({"decile": F.col("hot_decile").cast("int"), "day": F.expr("unix_micros(open_time) div 86400000000")})
    return materialize(shaped, "outcomes")


SQL_VIEWS["tops"] = ("outcomes", "SELECT decile, count(*) AS n, sum(fwd_return_3d) / count(*) AS mean FROM outcomes GROUP BY decile")
SQL_VIEWS["bounds"] = (
    "outcomes",
    f"""SELECT decile, list_sort(list(m))[greatest(CAST(ceil(count(*) * CAST(0.025 AS DOUBLE)) AS INTEGER), 1)] AS low,
            list_sort(list(m))[greatest(CAST(ceil(count(*) * CAST(0.975 AS DOUBLE)) AS INTEGER), 1)] AS high
        FROM (SELECT decile, replicate, sum(w * fwd_return_3d) / sum(w) AS m
            FROM outcomes JOIN (SELECT day, replicate, {" + ".join(_starts_sql(f"(day - {j})") for j in range(_LENGTH))} AS w
                FROM (SELECT DISTINCT day FROM outcomes), range(1, {_REPLICATES + 1}) AS r(replicate)) USING (day)
            WHERE w > 0 GROUP BY 1, 2) GROUP BY decile""",
)
SQL_VIEWS["fits"] = (
    "tops",
    """SELECT decile, max(low) AS fitted FROM (
            SELECT i.decile, a.decile AS a, min(m) AS low FROM tops i
            JOIN (SELECT x.decile AS decile, y.decile AS b, sum(z.mean * z.n) / sum(z.n) AS m
                FROM tops x JOIN tops y ON y.decile >= x.decile JOIN tops z ON z.decile BETWEEN x.decile AND y.decile GROUP BY 1, 2) a
              ON a.decile <= i.decile AND a.b >= i.decile GROUP BY 1, 2) GROUP BY decile""",
)


@query(
    "decile_outcome_summary", "i:decile i:n d:mean d:low d:high d:fitted",
    f"""SELECT t.decile, t.n, t.mean, b.low, b.high, f.fitted FROM tops t LEFT JOIN bounds b USING (decile) JOIN fits f USING (decile)""",
    "tops bounds fits", recursive=True,
)
def _(v: Views):
    # Forward returns by decile: intervals clustered by time, and the nearest ordered plateau.
    summary = materialize(block_bootstrap(_outcomes(v), ["decile"], "fwd_return_3d", "day", _LENGTH, _REPLICATES), "summary")
    return plateau(summary, "decile", "mean", "n")


_BASELINES = {
    "hot_score": "hot_decile = 10", "strength_3d": "rs_3d_pct >= 0.8", "expansion_24h": "vol_exp_24h_pct >= 0.8",
    "fresh_breakout": "is_fresh_breakout", "unconditional": "true",
}
_STRATA = {
    "split": SPLIT_SQL.format(t="open_time"), "liquidity": "CASE WHEN liquidity_pct >= 0.5 THEN 'high' WHEN liquidity_pct < 0.5 THEN 'low' END",
    "age": "CASE WHEN contract_age_days >= 14 THEN 'old' ELSE 'young' END",
}


@query(
    "baseline_strata", "baseline stratum level i:symbols i:n d:mean d:least d:most",
    f"""WITH member AS (SELECT symbol, fwd_return_3d AS value, baseline, {', '.join(f"coalesce({c}, 'unknown') AS {n}" for n, c in _STRATA.items())}
            FROM outcomes, (VALUES {', '.join(f"('{n}')" for n in _BASELINES)}) AS b(baseline)
            WHERE CASE baseline {' '.join(f"WHEN '{n}' THEN {c}" for n, c in _BASELINES.items())} END),
        cells AS (SELECT baseline, 'all' AS stratum, 'all' AS level, symbol, value FROM member
            {' '.join(f"UNION ALL SELECT baseline, '{n}', {n}, symbol, value FROM member" for n in _STRATA)}),
        each AS (SELECT baseline, stratum, level, symbol, sum(value) AS s, count(*) AS k FROM cells GROUP BY ALL),
        rest AS (SELECT *, (sum(s) OVER w - s) / nullif(sum(k) OVER w - k, 0) AS without FROM each WINDOW w AS (PARTITION BY baseline, stratum, level))
        SELECT baseline, stratum, level, count(*) AS symbols, sum(k) AS n, sum(s) / sum(k) AS mean, min(without) AS least, max(without) AS most
        FROM rest GROUP BY 1, 2, 3""",
    "outcomes", recursive=True,
)
def _(v: Views):
    return baseline_strata(
        _outcomes(v), {n: F.expr(c) for n, c in _BASELINES.items()}, {n: F.expr(c) for n, c in _STRATA.items()}, "fwd_return_3d"
    )
