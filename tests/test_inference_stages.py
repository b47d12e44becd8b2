"""Outcome inference, row numbers, partition gates and the single reading of article texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import evidence as ev
from tidepanel.operators import inference as inf
from tidepanel.operators.numbering import with_row_number
from tidepanel.operators.quality import located_differences, located_summary
from tidepanel.plans.stages import partition_gate, source_gate
from tidepanel.sources.sinks import StageChanged, changed_partitions, read_stage, restored_stage, write_stage

from conftest import four_hourly


def test_poisson_draws_have_the_rate(spark):
    draws = spark.range(20_000).select(inf.block_starts(F.lit(1), F.col("id"), 1 / 3, "x").alias("k")).groupBy("k").count().collect()
    share = {r.k: r["count"] / 20_000 for r in draws}
    assert abs(sum(k * p for k, p in share.items()) - 1 / 3) < 0.02 and abs(share[0] - 0.7165) < 0.02
    assert inf.poisson_thresholds(1.0)[0] == int(0.36787944117144233 * 2**32)


def test_bootstrap_equals_row_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), t, rng.choice([None, rng.gauss(0, 1)])) for t in range(40) for _ in range(3)]
    frame = spark.createDataFrame(rows, "g string, t bigint, y double")
    got = {r.g: r for r in inf.block_bootstrap(frame, ["g"], "y", "t", 4, 60).collect()}
    ends = inf.poisson_thresholds(0.25)

    def start(replicate: int, t: int) -> int:
        draw = int(hashlib.md5(f"block/{replicate}/{t}".encode()).hexdigest()[:8], 16)
        return sum(draw >= e for e in ends)

    for g in "ab":
        means = []
        for replicate in range(1, 61):
            held = [(sum(start(replicate, t - j) for j in range(4)), y) for h, t, y in rows if h == g and y is not None]
            if mass := sum(w for w, _ in held):
                means.append(sum(w * y for w, y in held) / mass)
        means.sort()
        low, high = means[max(-(-len(means) * 25 // 1000), 1) - 1], means[-(-len(means) * 975 // 1000) - 1]
        assert got[g].low == pytest.approx(low) and got[g].high == pytest.approx(high)
        assert got[g].n == sum(h == g and y is not None for h, _, y in rows) and got[g].low < got[g].mean < got[g].high


def test_plateau_pools_violators(spark):
    means = spark.createDataFrame([(1, 1.0, 1), (2, 4.0, 1), (3, 2.0, 3), (5, 9.0, 2), (6, 8.0, 2)], "d int, m double, w int")
    fit = {r.d: r.fitted for r in inf.plateau(means, "d", "m", "w").collect()}
    assert fit == pytest.approx({1: 1.0, 2: 2.5, 3: 2.5, 5: 8.5, 6: 8.5})


def test_strata_leave_one_symbol_out(spark):
    rows = [("x", 1.0, "p", True), ("x", 3.0, "q", False), ("y", 5.0, "p", True), ("z", None, "p", True), ("y", 7.0, None, True)]
    frame = spark.createDataFrame(rows, "symbol string, y double, s string, hit boolean")
    got = {
        (r.baseline, r.stratum, r.level): (r.symbols, r.n, r["mean"], r.least, r.most)
        for r in inf.baseline_strata(frame, {"hit": F.col("hit"), "every": F.lit(True)}, {"s": F.col("s")}, "y").collect()
    }
    assert got["every", "all", "all"] == (2, 4, 4.0, 2.0, 6.0) and got["hit", "all", "all"] == (2, 3, 13 / 3, 1.0, 6.0)
    assert got["every", "s", "p"] == (2, 2, 3.0, 1.0, 5.0) and got["every", "s", "q"] == (1, 1, 3.0, None, None)
    assert got["hit", "s", "unknown"] == (1, 1, 7.0, None, None) and len(got) == 7


def test_row_numbers_have_no_gap(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 500).alias("k"), F.col("id").alias("v")).repartition(5)
    numbered = with_row_number(frame, ["k"], "n")
    rows = sorted((r.n, r.k) for r in numbered.collect())
    assert [n for n, _ in rows] == list(range(1, 1001)) and [k for _, k in rows] == sorted(k for _, k in rows)
    assert with_row_number(frame.where("false"), ["k"], "n").count() == 0


def test_changed_partition_is_named_and_restored(spark, tmp_path):
    frame = spark.createDataFrame(four_hourly("AUSDT", 120, "2023-01-20"))
    path = str(tmp_path / "stage")
    write_stage(frame, path)
    spoiled = frame.withColumn("close", F.when(F.month("open_time") == 2, F.col("close") + 1).otherwise(F.col("close")))
    spoiled.write.mode("overwrite").parquet(f"{path}/data")
    changed = changed_partitions(spark, path).collect()
    assert [r.partition for r in changed] == ["2023-02"] and changed[0].recorded_rows == changed[0].stored_rows
    with pytest.raises(StageChanged, match="2023-02"):
        read_stage(spark, path)
    gate = {r.partition: r.passed for r in partition_gate("g", read_stage(spark, path, verify=False), frame).collect()}
    assert gate == {"2023-01": True, "2023-02": False}
    whole = restored_stage(spark, path, frame)
    assert whole.exceptAll(frame).isEmpty() and frame.exceptAll(whole).isEmpty()


def test_differences_are_located(spark):
    schema = "k string, x int"
    stored = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3), ("e", 5), (None, 6)], schema)
    replayed = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4), ("e", 6), (None, 6)], schema)
    for buckets in (1, 4096):
        found = {r.k: r.finding for r in located_differences(stored, replayed, ["k"], buckets).collect()}
        assert found == {"a": "changed", "c": "only_stored", "d": "only_replayed", "e": "changed"}
    assert located_differences(stored, stored, ["k"]).count() == 0
    row = located_summary("t", stored, stored.orderBy("x"), ["k"]).first()
    assert row.is_equal and row.stored_rows == row.replayed_rows == 6


def test_source_gate(spark):
    keys = lambda names: spark.createDataFrame([(n,) for n in names], "source_key string")
    attempts = keys("ab").withColumn("status", F.lit("verified"))
    files = spark.createDataFrame([("a", bytearray(b"1"))], "path string, content binary")
    manifest = files.select("path", F.sha2("content", 256).alias("sha256"), F.lit(1).cast("bigint").alias("byte_count"))
    assert source_gate(keys("ab"), attempts, files, manifest).first().passed
    row = source_gate(keys("abc"), attempts, files, manifest.withColumn("byte_count", F.lit(2).cast("bigint"))).first()
    assert (row.unequal_keys, row.attempt_findings, row.file_findings, row.passed) == (1, 1, 1, False)


ARTICLES = [
    ("listing", "1", "Binance Futures Will Launch AAAUSDT Perpetual Contract", "Binance Futures will launch AAAUSDT at 2024-01-02 11:30 (UTC)."),
    ("listing", "2", "Binance Futures Will Launch Perpetual Contracts", "Binance Futures will launch:\n2024-01-02 11:30 (UTC): AAAUSDT\n2024-01-02 11:45 (UTC): ZZZUSDT\nnotes\n2024-01-02 11:50 (UTC): BBBUSDT"),
    ("listing", "3", "Weekly notes", "nothing here"), ("listing", "4", "Notes on ZZZUSDT", "See AAAUSDT."), ("listing", "5", None, None),
]


def test_texts_are_read_once_and_stay(spark):
    articles = spark.createDataFrame(
        [(*a, "2024-01-01 00:00:00") for a in ARTICLES], "event_type string, article_code string, title string, body_text string, article_published_at string"
    )
    read = ev.read_articles(articles)
    assert "body_text" not in read.columns and "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    known = spark.createDataFrame([("AAAUSDT",), ("BBBUSDT",)], "symbol string")
    result = ev.evidence_rows(articles, known)
    assert "body_text" not in result._jdf.queryExecution().optimizedPlan().toString()
    got = defaultdict(dict)
    for r in result.collect():
        got[r.article_code][r.symbol] = r.official_event_at and r.official_event_at.strftime("%d %H:%M")
    # An unknown symbol's row ends the table below a header, as any other line does.
    assert got["1"] == {"AAAUSDT": "02 11:30"} and set(got["2"]) == {"AAAUSDT", "BBBUSDT"} and got["2"]["AAAUSDT"] == "02 11:30"
    assert Counter(map(len, got.values())) == {1: 2, 2: 1} and got["4"] == {"AAAUSDT": None}
