"""Scope, eligibility, gaps, presence, planning and pages on hand-made cases."""

from __future__ import annotations

from datetime import date, datetime

import pandas as pd
import pytest
from conftest import contract, contracts_df, four_hourly, hourly
from pyspark.sql import functions as F

from tidepanel.fixed_values import ACCEPTED_CUTOFF
from tidepanel.functions.keys import daily_bar_key, monthly_bar_key, parse_object_key
from tidepanel.operators import gaps, pages, planning
from tidepanel.operators.contracts import ContractViolation, lookup_many_to_one, validate_bars
from tidepanel.operators.eligibility import apply_eligibility
from tidepanel.operators.presence import presence_findings
from tidepanel.operators.rollup import rollup_rejected, rollup_strict, unexplained_rejects
from tidepanel.operators.scope import filter_scope

ANCHOR = "first_observed_binance_futures_trade"


def ts(text: str):
    return F.lit(text).cast("timestamp")


def eligible(spark, bars: pd.DataFrame, rows: list[dict], **options) -> pd.DataFrame:
    return apply_eligibility(
        spark.createDataFrame(bars), contracts_df(spark, rows), **options
    ).toPandas().sort_values("open_time", ignore_index=True)


def test_age_is_counted_to_the_close(spark):
    bars = four_hourly("ETHUSDT", 2, "2023-01-31")
    got = eligible(spark, bars, [contract("ETHUSDT", "2023-01-01 04:00")])
    assert got.is_eligible.tolist() == [False, True]
    assert got.is_eth.all() and not got.is_benchmark.any()


def test_no_events_from_the_announcement_on(spark):
    bars = four_hourly("ETHUSDT", 2, "2023-03-01")
    row = contract("ETHUSDT", "2023-01-01", delisting_announcement_published_at=datetime(2023, 3, 1, 5))
    assert eligible(spark, bars, [row]).is_eligible.tolist() == [True, False]


def test_contract_checks_fail_closed(spark):
    bars = four_hourly("ETHUSDT", 1, "2023-03-01")
    with pytest.raises(ContractViolation, match="first-trade"):
        eligible(spark, bars, [contract("ETHUSDT", first_observed_trade_at=None)])
    with pytest.raises(ContractViolation, match="one row"):
        eligible(spark, bars, [contract("ETHUSDT"), contract("ETHUSDT")])
    with pytest.raises(ContractViolation, match="identity"):
        eligible(spark, bars.assign(symbol="ethusdt"), [contract("ETHUSDT")])
    with pytest.raises(ValueError, match="missing"):
        frame = contracts_df(spark, [contract("ETHUSDT")]).drop("first_observed_trade_at")
        apply_eligibility(spark.createDataFrame(bars), frame)


def test_unresolved_scope_and_unmatched_contract_are_ineligible(spark):
    bars = pd.concat([four_hourly(s, 1, "2023-03-01") for s in ("ETHUSDT", "NEWUSDT")], ignore_index=True)
    rows = [contract("ETHUSDT", scope_classification_status="unresolved")]
    assert not eligible(spark, bars, rows).is_eligible.any()


INTERVALS = (
    ", lifecycle_intervals array<struct<symbol:string,lifecycle_episode_id:string,"
    "age_live_anchor_at:timestamp,anchor_basis:string,eligibility_end_at:timestamp,last_trading_at:timestamp>>"
)


def interval_contract(spark, spec: list[tuple]):
    ddl = "symbol string" + INTERVALS
    nested = spark.createDataFrame([("AAAUSDT", spec)], ddl)
    return contracts_df(spark, [contract("AAAUSDT", "2023-01-01")]).join(nested, "symbol")


def test_relisting_blocks_the_gap_and_resets_age(spark):
    times = ["2022-12-31 23:59:59", "2023-02-01", "2023-03-01", "2023-03-20", "2023-04-30 23:59:59.999", "2023-05-01"]
    bars = spark.createDataFrame(
        [("AAAUSDT", t, 1.0) for t in times], "symbol string, close_time string, close double"
    ).withColumn("close_time", F.col("close_time").cast("timestamp"))
    spec = [
        ("AAAUSDT", "AAAUSDT:1", datetime(2023, 1, 1), ANCHOR, datetime(2023, 3, 1), datetime(2023, 3, 10)),
        ("AAAUSDT", "AAAUSDT:2", datetime(2023, 4, 1), ANCHOR, None, None),
    ]
    got = apply_eligibility(bars, interval_contract(spark, spec)).orderBy("close_time").toPandas()
    assert got.is_eligible.tolist() == [False, True, False, False, False, True]
    assert got.selected_lifecycle_episode_id.iloc[-1] == "AAAUSDT:2"
    text = interval_contract(spark, spec).withColumn("lifecycle_intervals", F.to_json("lifecycle_intervals"))
    again = apply_eligibility(bars, text).orderBy("close_time").toPandas()
    assert again.is_eligible.tolist() == got.is_eligible.tolist()


def test_overlapping_intervals_raise_only_when_a_bar_is_hit(spark):
    bars = spark.createDataFrame(
        [("AAAUSDT", datetime(2023, 2, 1), 1.0)], "symbol string, close_time timestamp, close double"
    )
    spec = [
        ("AAAUSDT", "AAAUSDT:1", datetime(2023, 1, 1), ANCHOR, None, datetime(2023, 3, 1)),
        ("AAAUSDT", "AAAUSDT:2", datetime(2023, 1, 20), ANCHOR, None, None),
    ]
    with pytest.raises(ContractViolation, match="more than one"):
        apply_eligibility(bars, interval_contract(spark, spec))
    early = bars.withColumn("close_time", ts("2023-01-10 00:00:00"))
    assert apply_eligibility(early, interval_contract(spark, spec)).count() == 1


@pytest.mark.parametrize(
    "change",
    [
        {"scope_classification_status": "unresolved"}, {"is_stablecoin_underlying": None},
        {"is_leveraged_token": True}, {"is_crypto_underlying": False}, {"contract_type": "CURRENT"},
        {"base_asset": "USDC", "symbol": "USDCUSDT"}, {"underlying_subtype": []}, {"quote_asset": "usdt"},
        {"base_asset": "OTHER"}, {"scope_classification_provenance": None},
    ],
)
def test_scope_drops_anything_not_positively_in_scope(spark, change):
    rows = [contract("ETHUSDT"), {**contract("ADAUSDT"), **change}]
    assert [r.symbol for r in filter_scope(contracts_df(spark, rows)).collect()] == ["ETHUSDT"]


def test_scope_keeps_non_ascii_symbols(spark):
    rows = [contract("币安人生USDT", base_asset="币安人生")]
    assert filter_scope(contracts_df(spark, rows)).count() == 1


# --- rollup and contract --------------------------------------------------------------------------------


def test_rollup_is_strict_and_utc_aligned(spark):
    frame = hourly("ETHUSDT", 12, "2023-01-01 01:00:00").drop(index=6)
    bars = rollup_strict(spark.createDataFrame(frame)).toPandas()
    assert bars.open_time.tolist() == [pd.Timestamp("2023-01-01 08:00:00")]
    row = bars.iloc[0]
    part = frame[frame.open_time.between("2023-01-01 08:00", "2023-01-01 11:00")]
    assert row.open == part.open.iloc[0] and row.close == part.close.iloc[-1]
    assert row.high == part.high.max() and row.quote_volume == part.quote_volume.sum()
    rejected = rollup_rejected(spark.createDataFrame(frame)).orderBy("open_time").toPandas()
    assert [list(o) for o in rejected.offsets] == [[1, 2, 3], [0, 1, 2], [0]]
    edge = spark.createDataFrame([("ETHUSDT", datetime(2023, 1, 1, 1))], "symbol string, point timestamp")
    left = unexplained_rejects(rollup_rejected(spark.createDataFrame(frame)), edge, ts("2023-01-01 13:00:00"))
    assert [r.open_time.hour for r in left.collect()] == [4]


def test_bar_contract_names_every_broken_rule(spark):
    frame = hourly("ETHUSDT", 6)
    frame.loc[1, "high"] = 1.0
    frame.loc[2, "close_time"] += pd.Timedelta(milliseconds=1)
    frame.loc[3, "trade_count"] = -1
    frame.loc[4, "open_time"] = frame.loc[0, "open_time"]
    checked = validate_bars(spark.createDataFrame(frame))
    found = sorted(r.rule for r in checked.violations.collect())
    assert found == [
        "bad_price_order", "duplicate_key", "duplicate_key", "negative_volume", "wrong_close_time", "wrong_close_time",
    ]
    assert checked.valid.count() == 1
    with pytest.raises(ContractViolation):
        checked.require()
    assert validate_bars(spark.createDataFrame(hourly("ETHUSDT", 6))).require().count() == 6


def test_lookup_rejects_duplicate_keys(spark):
    left, right = spark.range(3), spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(ContractViolation):
        lookup_many_to_one(left, right, ["id"])


# --- gaps and planning ----------------------------------------------------------------------------------


def test_gap_kinds_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(gaps, "_CHUNK_STEPS", 3)
    frame = hourly("AUSDT", 48)
    keep = frame.drop(index=[0, 1, 10, 11, 12, 13, 14, 15, 16, 17, 30, 47])
    points = spark.createDataFrame(keep[["symbol", "open_time"]])
    expected = spark.createDataFrame([("AUSDT",), ("BUSDT",)], "symbol string").withColumns(
        {"range_start": ts("2023-01-01 00:00:00"), "range_end": ts("2023-01-03 00:00:00")}
    )
    got = {
        (r.symbol, r.kind, r.gap_start, r.gap_end) for r in gaps.classify_gaps(points, expected).collect()
    }
    d = lambda day, hour: datetime(2023, 1, day, hour)
    assert got == {
        ("AUSDT", "leading_source_gap", d(1, 0), d(1, 2)),
        ("AUSDT", "interior_source_gap", d(1, 10), d(1, 18)),
        ("AUSDT", "interior_source_gap", d(2, 6), d(2, 7)),
        ("AUSDT", "trailing_source_gap", d(2, 23), d(3, 0)),
        ("BUSDT", "unexplained_missing_planned_archive", d(1, 0), d(3, 0)),
    }


def plan(spark, daily_days: list[int], cutoff: str, live_until: str = "2024-03-20 00:00:00"):
    symbols = spark.createDataFrame([("AUSDT",)], "symbol string")
    months = spark.createDataFrame([("2024-01",), ("2024-02",)], "m string").select(
        monthly_bar_key(F.lit("AUSDT"), F.col("m")).alias("object_key")
    )
    days = spark.createDataFrame([(f"2024-03-{d:02d}",) for d in daily_days], "d string").select(
        daily_bar_key(F.lit("AUSDT"), F.col("d")).alias("object_key")
    )
    ranges = symbols.withColumns({"range_start": ts("2024-01-10 00:00:00"), "range_end": ts(live_until)})
    return planning.plan_source_tiers(
        planning.parsed_keys(months), planning.parsed_keys(days), symbols, symbols, ranges,
        F.lit("2024-01-01").cast("timestamp"), ts(cutoff), page_hours=10,
    )


def test_plan_tiers_and_tail(spark):
    result = plan(spark, [1, 2], "2024-03-04 05:30:00")
    rows = [(r.source_kind, r.range_start, r.range_end) for r in planning.source_inventory(result.require()).collect()]
    assert [kind for kind, _, _ in rows] == ["monthly", "monthly", "daily", "daily", "api", "api", "api"]
    assert rows[-3][1] == datetime(2024, 3, 3) and rows[-1][2] == datetime(2024, 3, 4, 5)
    assert planning.source_overlaps(result.sources, ts("2024-03-04 05:30:00")).isEmpty()


def test_plan_rejects_interior_gap_and_missing_month(spark):
    with pytest.raises(ContractViolation, match="interior"):
        plan(spark, [1, 3], "2024-03-05 00:00:00").require()
    with pytest.raises(ContractViolation, match="missing_months"):
        plan(spark, [1], "2024-04-02 00:00:00").require()
    ended = plan(spark, [1, 2], "2024-03-04 05:30:00", "2024-03-02 12:00:00").require()
    assert ended.filter("source_kind = 'api'").isEmpty()


def test_keys_must_repeat_the_symbol_and_be_real_dates(spark):
    keys = [
        ("data/futures/um/monthly/klines/AUSDT/1h/AUSDT-1h-2024-01.zip", "monthly"),
        ("data/futures/um/daily/klines/币USDT/1h/币USDT-1h-2024-02-29.zip", "daily"),
        ("data/futures/um/daily/trades/AUSDT/AUSDT-trades-2024-01-31.zip", "daily_trade"),
        ("data/futures/um/daily/klines/AUSDT/1h/AUSDT-1h-2023-02-29.zip", None),
        ("data/futures/um/monthly/klines/AUSDT/1h/BUSDT-1h-2024-01.zip", None),
        ("data/futures/um/monthly/klines/AUSDT/1h/AUSDT-1h-2024-13.zip", None),
        ("data/futures/um/monthly/klines/ausdt/1h/ausdt-1h-2024-01.zip", None),
        ("data/futures/um/monthly/klines/AUSDT/1h/AUSDT-1h-2024-01.zip\n", None),
    ]
    frame = spark.createDataFrame(keys, "key string, want string")
    got = frame.select(parse_object_key(F.col("key"))["source_kind"].alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_page_chain_findings(spark):
    ddl = "g string, page int, truncated boolean, next_token string, request_token string, declared_count int, entry_count int"
    good = [("ok", 1, True, "a", None, 2, 2), ("ok", 2, True, "b", "a", 1, 1), ("ok", 3, False, None, "b", 0, 0)]
    bad = [
        ("hole", 1, True, "a", None, 1, 1), ("hole", 3, False, None, "a", 1, 1),
        ("open", 1, True, "a", None, 1, 1),
        ("loop", 1, True, "a", None, 1, 1), ("loop", 2, True, "a", "a", 1, 1), ("loop", 3, False, None, "a", 1, 1),
        ("late", 1, False, None, None, 1, 1), ("late", 2, False, None, None, 1, 1),
        ("cut", 1, False, None, "x", 1, 2),
    ]
    got = pages.page_chain_findings(spark.createDataFrame(good + bad, ddl), ["g"]).collect()
    assert {(r.g, r.page, r.finding) for r in got} == {
        ("hole", 3, "page_missing"), ("open", 1, "no_terminal_page"), ("loop", 1, "token_repeated"),
        ("loop", 2, "token_repeated"), ("late", 2, "page_after_terminal"), ("cut", 1, "chain_broken"),
        ("cut", 1, "count_disagrees"),
    }


def test_page_suffix_findings(spark):
    page = spark.createDataFrame([("p",), ("q",)], "page_key string").withColumns(
        {"page_start": ts("2024-01-01 00:00:00"), "page_end": ts("2024-01-01 03:00:00")}
    )
    rows = [("p", 0), ("p", 1), ("p", 2), ("q", 0), ("q", 0), ("q", 2), ("q", 3)]
    frame = spark.createDataFrame([(k, datetime(2024, 1, 1, h)) for k, h in rows], "page_key string, open_time timestamp")
    got = pages.page_suffix_findings(frame, page).collect()
    assert [(r.page_key, r.missing, r.outside, r.repeated) for r in got] == [("q", 1, 1, 1)]


def test_presence_rules_and_precedence(spark):
    def span(symbol, first, last, skip=()):
        return [(symbol, date(2024, 1, d)) for d in range(first, last + 1) if d not in skip]

    rows = (
        span("FINE", 1, 29) + span("HOLE", 1, 29, {5, 9}) + span("KNOWN", 1, 29, {5, 6}) + span("MOVED", 1, 29)
        + span("ENDED", 1, 22) + span("REG", 1, 26) + span("SHORT", 1, 20) + span("CLOSED", 1, 20)
    )
    presence = spark.createDataFrame(rows, "symbol string, day date")
    reviewed = spark.createDataFrame(
        [("KNOWN", date(2024, 1, 4), date(2024, 1, 7), None), ("MOVED", date(2024, 1, 4), date(2024, 1, 7), None)],
        "symbol string, last_before date, first_after date, terminal_day date",
    )
    episodes = spark.createDataFrame(
        [("ENDED", 1, date(2024, 1, 20)), ("CLOSED", 1, date(2024, 1, 20))],
        "symbol string, position int, terminated_day date",
    )
    cutoffs = spark.createDataFrame(
        [("REG", 1, ACCEPTED_CUTOFF, date(2024, 1, 25))],
        "symbol string, position int, review_status string, terminal_day date",
    )
    found = presence_findings(presence, reviewed, episodes, cutoffs, F.lit("2024-01-30").cast("date"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    repeated = presence_findings(
        presence.unionByName(presence).unionByName(spark.createDataFrame([(None, date(2024, 1, 1)), ("FINE", None), ("FINE", date(2024, 3, 1))], presence.schema)),
        reviewed, episodes, cutoffs, F.lit("2024-01-30").cast("date"),
    )
    assert sorted(map(tuple, repeated.collect())) == sorted(map(tuple, found.collect()))
    none = presence.where("false")
    assert presence_findings(none, reviewed, episodes, cutoffs, F.lit("2024-01-30").cast("date")).count() == 0
    got = found.collect()
    assert {(r.symbol, r.finding, str(r.detected_from), str(r.detected_to)) for r in got} == {
        ("HOLE", "interior_discontinuity", "2024-01-04", "2024-01-06"),
        ("MOVED", "reviewed_gap_changed", "2024-01-04", "2024-01-07"),
        ("ENDED", "activity_after_terminal", "2024-01-20", "2024-01-22"),
        ("REG", "activity_after_registry_terminal", "2024-01-25", "2024-01-26"),
        ("SHORT", "frontier_missing", "2024-01-20", "2024-01-29"),
    }
