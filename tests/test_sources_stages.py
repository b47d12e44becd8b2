"""File sources on real files, stage writers, and the stage chain end to end."""

from __future__ import annotations

import hashlib
import zipfile
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import contract, contracts_df, four_hourly, hourly
from pyspark.sql import functions as F

from tidepanel.operators import quality as ql
from tidepanel.operators.contracts import ContractViolation
from tidepanel.operators.gaps import active_ranges
from tidepanel.operators.splits import SplitAccessError
from tidepanel.plans.slice import SliceSpec, build_slice, observations_from_eligible
from tidepanel.plans.stages import (
    StagePaths,
    gates,
    stage_completed,
    stage_eligibility,
    stage_normalized,
    stage_observations,
)
from tidepanel.sources.bars import normalize_bars, read_bar_archives, read_trades
from tidepanel.sources.documents import listing_keys, read_listing_pages
from tidepanel.sources.sinks import StageChanged, read_splits, read_stage, write_stage

HEADER = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore"


def bar_line(open_ms: int, **changes) -> str:
    row = {"o": "1.5", "h": "2", "l": "1", "c": "1.7", "v": "3", "q": "4.5", "n": "7", **changes}
    return f"{open_ms},{row['o']},{row['h']},{row['l']},{row['c']},{row['v']},{open_ms + 3_599_999},{row['q']},{row['n']},1,2,0"


def write_zip(path, members: dict[str, str]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)


def test_zipped_bars_with_and_without_header(spark, tmp_path):
    t0 = 1_672_531_200_000
    write_zip(tmp_path / "AUSDT/1h/AUSDT-1h-2023-01.zip", {"x.csv": "\n".join([HEADER, bar_line(t0), bar_line(t0 + 3_600_000)]) + "\n"})
    write_zip(tmp_path / "BUSDT/1h/BUSDT-1h-2023-01.zip", {"x.csv": bar_line(t0, n="7.5") + "\r\n" + bar_line(t0, o="abc")})
    write_zip(tmp_path / "CUSDT/1h/CUSDT-1h-2023-01.zip", {"a.csv": "", "b.csv": ""})
    got = normalize_bars(read_bar_archives(spark, str(tmp_path))).toPandas()
    a = got[got.symbol == "AUSDT"].sort_values("open_time")
    assert a.open_time.tolist() == [pd.Timestamp("2023-01-01"), pd.Timestamp("2023-01-01 01:00")]
    assert a.cast_errors.map(list).tolist() == [[], []] and a.trade_count.tolist() == [7, 7]
    assert sorted(got[got.symbol == "BUSDT"].cast_errors.map(list).tolist()) == [["open"], ["trade_count"]]
    assert "field_count" in list(got[got.symbol == "CUSDT"].cast_errors.iloc[0])


def test_trade_times(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,price,qty,quote_qty,time,is_buyer_maker\n1,2,3,6,1672531200123,true\n2,2,3,6,1672531200001,true\n3,2,3,6,12.5,true\n")
    rows = read_trades(spark, str(tmp_path)).collect()
    assert sorted(r.is_valid for r in rows) == [False, True, True]
    assert min(r.traded_at for r in rows if r.is_valid) == datetime(2023, 1, 1, 0, 0, 0, 1000)


def test_listing_pages(spark, tmp_path):
    body = (
        '<?xml version="1.0"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Prefix>p/</Prefix>'
        "<KeyCount>3</KeyCount><IsTruncated>{t}</IsTruncated>{x}<CommonPrefixes><Prefix>p/q/</Prefix></CommonPrefixes>"
        "<Contents><Key>p/a.zip</Key></Contents><Contents><Key>p/a.zip.CHECKSUM</Key></Contents></ListBucketResult>"
    )
    (tmp_path / "1.xml").write_text(body.format(t="true", x="<NextContinuationToken>n</NextContinuationToken>"))
    (tmp_path / "2.xml").write_text(body.format(t="false", x=""))
    pages = read_listing_pages(spark, str(tmp_path))
    rows = pages.orderBy("source_path").collect()
    assert [(r.truncated, r.next_token, r.declared_count, r.entry_count) for r in rows] == [(True, "n", 3, 3), (False, None, 3, 3)]
    assert [list(r.prefixes) for r in rows] == [["p/q/"]] * 2
    assert {r.object_key for r in listing_keys(pages).collect()} == {"p/a.zip"}


def test_checksums_of_real_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"def")
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    digest = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame(
        [("a.bin", digest, 3), ("b.bin", digest, 4), ("c.bin", digest, 3)], "path string, sha256 string, byte_count long"
    )
    got = {(r.path, r.finding) for r in ql.checksum_findings(files, manifest).collect()}
    assert got == {("b.bin", "hash_changed"), ("b.bin", "size_changed"), ("c.bin", "missing_file")}


def test_stage_fingerprint_detects_changes(spark, tmp_path):
    path = str(tmp_path / "stage")
    frame = spark.createDataFrame(four_hourly("AUSDT", 20))
    write_stage(frame, path)
    assert read_stage(spark, path).count() == 20
    with pytest.raises(Exception, match="already exists"):
        write_stage(frame, path)
    frame.limit(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(StageChanged):
        read_stage(spark, path)


def test_fingerprint_ignores_order_and_sees_nulls_and_repeats(spark):
    one = spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a int, b int")
    rows = lambda df: ql.frame_fingerprint(df).first()
    assert rows(one) == rows(one.repartition(3).orderBy("b"))
    assert rows(one) != rows(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    assert rows(one.union(one)) != rows(one.union(one).union(one).union(one))


def slice_input(spark, n: int = 250):
    bars, rows = [], []
    for i, symbol in enumerate(["BTCUSDT", "ETHUSDT", "BNBUSDT", "ADAUSDT", "SOLUSDT"]):
        frame = four_hourly(symbol, n, "2023-02-01")
        frame["close"] *= 1 + i * 0.0002 * np.arange(n)
        frame["open"], frame["high"], frame["low"] = frame.close, frame.close * 1.01, frame.close * 0.99
        frame["quote_volume"] *= i + 1
        bars.append(frame)
        rows.append(contract(symbol))
    return spark.createDataFrame(pd.concat(bars, ignore_index=True)), contracts_df(spark, rows)


def test_slice_end_to_end(spark):
    bars, contracts = slice_input(spark)
    got = build_slice(bars, contracts).toPandas()
    assert len(got) == 1250
    alt = got[~got.is_benchmark]
    assert alt.is_eligible.all() and alt.hot_score.notna().any() and alt.fwd_return_7d.notna().any()
    assert not got[got.is_benchmark].is_eligible.any() and got[got.is_benchmark].hot_score.isna().all()
    assert {"barrier_7d", "btc_relative_return_3d", "cross_sectional_excess_return_3d", "stage", "episode_id"} <= set(got)
    with pytest.raises(SplitAccessError):
        build_slice(bars.withColumn("open_time", F.col("open_time") + F.expr("INTERVAL 1 YEAR")), contracts)
    with pytest.raises(ValueError, match="scope"):
        build_slice(bars, contracts.withColumn("is_leveraged_token", F.lit(True)))


def test_stage_chain_and_gates(spark, tmp_path):
    hours = 24 * 70
    frames = [hourly(s, hours, "2023-01-01") for s in ("BTCUSDT", "ETHUSDT")]
    bars = spark.createDataFrame(pd.concat(frames, ignore_index=True)).withColumns(
        {"source_key": F.col("symbol"), "source_sha256": F.sha2("symbol", 256)}
    )
    rows = [contract(s, "2023-01-01", scope_disposition=d) for s, d in (("BTCUSDT", "benchmark_only"), ("ETHUSDT", "in_scope_crypto_perpetual"))]
    catalog = contracts_df(spark, rows, ", scope_disposition string").withColumn("last_trading_at", F.lit(None).cast("timestamp"))
    catalog = catalog.drop("base_asset") .withColumn("lifecycle_intervals", F.array(F.struct(
        "symbol", F.concat("symbol", F.lit(":1")).alias("lifecycle_episode_id"), F.col("eligibility_age_anchor_at").alias("age_live_anchor_at"),
        F.col("eligibility_age_anchor_basis").alias("anchor_basis"), F.lit(None).cast("timestamp").alias("eligibility_end_at"),
        F.lit(None).cast("timestamp").alias("last_trading_at"),
    )))
    start, cutoff = (F.lit(t).cast("timestamp") for t in ("2022-12-01 00:00:00", "2023-03-12 00:00:00"))
    sources = catalog.select(F.col("symbol").alias("source_key"), start.alias("range_start"), cutoff.alias("range_end"))
    paths, spec = StagePaths(str(tmp_path)), SliceSpec()
    with pytest.raises(ContractViolation, match="gaps"):
        stage_normalized(bars.filter("open_time <> timestamp'2023-01-05 03:00:00'"), catalog, sources, catalog, start, cutoff, paths)
    assert stage_normalized(bars, catalog, sources, catalog, start, cutoff, paths).count() == 2 * hours
    ranges = active_ranges(catalog, start, cutoff)
    assert stage_completed(spark, ranges, cutoff, paths).count() == 2 * hours / 4
    eligible = stage_eligibility(spark, catalog, spec, paths)
    assert eligible.filter("is_eligible").select("symbol").distinct().collect()[0].symbol == "ETHUSDT"
    observed = stage_observations(spark, spec, paths)
    assert observed.count() == 2 * hours / 4 and read_splits(spark, paths.of("observations"), ["validation"]).isEmpty()
    result = gates(spark, catalog, spec, paths).toPandas()
    assert result.passed.all() and len(result) == 4
    replay = observations_from_eligible(eligible, spec)
    assert replay.count() == observed.count()


def test_listing_query_writes_few_files_however_many_users(spark, tmp_path):
    """One folder a user took 36 s at sf0.1; now files depend on tasks alone and facts travel with their page."""
    from pathlib import Path

    from tidepanel.session import shared_folder
    from tidepanel.workload import QUERIES

    days = [datetime(2024, 1, 1), datetime(2024, 1, 2)]
    rows = [(u * 2 + i, day, u, "click", 1.0, "{}") for u in range(40) for i, day in enumerate(days)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    root = Path(shared_folder(spark))
    before = set(root.glob("listing-*"))
    got = QUERIES["src_listing_xml"](spark, str(tmp_path)).collect()
    (written,) = set(root.glob("listing-*")) - before
    assert not [p for p in written.iterdir() if p.is_dir()]
    assert len(got) == 80 and all(r.declared_count == r.entry_count == 4 and r.truncated for r in got)
    assert {r.object_key for r in got if r.prefix == "k/U7USDT/"} == {"k/U7USDT/2024-01-01.zip", "k/U7USDT/2024-01-02.zip"}
