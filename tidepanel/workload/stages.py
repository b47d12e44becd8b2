"""The stage chain over stored hourly bars, and the gates that replay it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.timefn import plus_seconds
from tidepanel.operators.eligibility import apply_eligibility, eligibility_projection
from tidepanel.operators.rollup import rollup_strict
from tidepanel.plans.slice import SliceSpec
from tidepanel.plans.stages import StagePaths, partition_gate, source_gate, stage_completed, stage_eligibility, stage_normalized
from tidepanel.session import scratch_path
from tidepanel.sources.sinks import changed_partitions, read_stage, restored_stage, write_stage
from tidepanel.workload.core import _GROUPS
from tidepanel.workload.registry import query
from tidepanel.workload.views import BENCHMARK, SQL_VIEWS, Views, at

START, CUTOFF = "2023-12-01 00:00:00", "2030-01-01 00:00:00"
SPEC = SliceSpec(minimum_age_days=5, benchmark=BENCHMARK)
_HOUR = 3600


def _catalog(v: Views) -> DataFrame:
    """Contracts of the hourly symbols, each with one open episode from its first trade on."""
    none = F.lit(None).cast("timestamp")
    episode = F.struct(
        "symbol", F.concat("symbol", F.lit(":1")).alias("lifecycle_episode_id"), F.col("eligibility_age_anchor_at").alias("age_live_anchor_at"),
        F.col("eligibility_age_anchor_basis").alias("anchor_basis"), none.alias("eligibility_end_at"), none.alias("last_trading_at"),
    )
    return v.contracts_of(1).withColumns({"lifecycle_intervals": F.array(episode), "last_trading_at": none})


def _hourly(v: Views) -> DataFrame:
    key = F.concat_ws("/", "symbol", F.to_date("open_time").cast("string"))
    return v.bars_1h.withColumns({"source_key": key, "source_sha256": F.sha2(key, 256)})


def _edges(hourly: DataFrame) -> DataFrame:
    """Where unbroken runs of hours begin and end, each as a range of no length.

    An hour without the hour before it begins a run, one without the hour after it ends one: two
    anti-joins on (symbol, hour), so no series is ever ordered in one task.
    """
    keys = hourly.select("symbol", "open_time")

    def lacking(shift: int) -> DataFrame:
        near = keys.select("symbol", plus_seconds(F.col("open_time"), shift).alias("open_time"))
        return keys.join(near, ["symbol", "open_time"], "left_anti")

    points = lacking(_HOUR).select("symbol", F.col("open_time").alias("range_start")).unionByName(
        lacking(-_HOUR).select("symbol", plus_seconds(F.col("open_time"), _HOUR).alias("range_start"))
    )
    return points.withColumn("range_end", F.col("range_start"))


def _normalized(v: Views, paths: StagePaths) -> DataFrame:
    """Hourly bars as a stage; instruments without a hole up to the last hour count as approved."""
    hourly = _hourly(v)
    day = F.to_date("open_time").cast("timestamp")
    sources = hourly.select("source_key", day.alias("range_start")).distinct().withColumn("range_end", plus_seconds(F.col("range_start"), 86_400))
    last = v.table("events").agg((F.date_trunc("hour", F.max("ts")) + F.expr("INTERVAL 1 HOUR")).alias("end"))  # one row
    spans = hourly.groupBy("symbol").agg(F.count(F.lit(1)).alias("hours"), F.min("open_time").alias("from"))
    whole = spans.join(F.broadcast(last)).filter(F.col("hours") * _HOUR == F.unix_seconds("end") - F.unix_seconds("from")).select("symbol")
    end = v.table("events").agg(F.max("ts")).first()[0]
    cutoff = F.date_trunc("hour", F.lit(end)) + F.expr("INTERVAL 1 HOUR")
    return stage_normalized(hourly, _catalog(v), sources, whole, at(START), cutoff, paths)


def _completed(v: Views, paths: StagePaths) -> DataFrame:
    normalized = _normalized(v, paths)
    return stage_completed(v.spark, _edges(normalized), at(CUTOFF), paths)


@query(
    "stage_normalized", "symbol t:open_time d:close d:quote_volume source_key",
    "SELECT *, symbol || '/' || strftime(open_time, '%Y-%m-%d') AS source_key FROM bars_1h", "bars_1h",
)
def _(v: Views):
    return _normalized(v, StagePaths(scratch_path(v.spark, "stages")))


SQL_VIEWS["completed_4h"] = (
    "bars_1h", f"SELECT *, group_open AS open_time, n AS source_hour_count FROM ({_GROUPS}) WHERE slots = '0,1,2,3'",
)


@query(
    "stage_4h", "symbol t:open_time d:open d:high d:low d:close d:quote_volume i:trade_count i:source_hour_count",
    "SELECT * FROM completed_4h", "completed_4h",
)
def _(v: Views):
    return _completed(v, StagePaths(scratch_path(v.spark, "stages")))


@query(
    "stage_eligibility", "symbol t:open_time d:close d:contract_age_days is_eligible is_benchmark",
    f"""SELECT c.symbol, open_time, close, epoch_us(close_time) / 86400000000.0 - epoch_us(first_ts) / 86400000000.0 AS contract_age_days,
            c.symbol <> '{BENCHMARK}' AND close_time - first_ts >= INTERVAL 5 DAY AS is_eligible, c.symbol = '{BENCHMARK}' AS is_benchmark
        FROM completed_4h c JOIN (SELECT upper(event_type) || '0USDT' AS symbol, min(ts) AS first_ts FROM events GROUP BY 1) USING (symbol)""",
    "completed_4h",
)
def _(v: Views):
    paths = StagePaths(scratch_path(v.spark, "stages"))
    _completed(v, paths)
    return stage_eligibility(v.spark, _catalog(v), SPEC, paths)


@query(
    "stage_gates", "gate partition i:stored_rows i:replayed_rows passed",
    """WITH days AS (SELECT strftime(open_time, '%Y-%m-%d') AS partition, count(*) AS n, count(*) FILTER (dayofweek(open_time) = 3 AND hour(open_time) = 8) AS hit
            FROM completed_4h GROUP BY 1),
        each AS (
            SELECT 'completed_4h' AS gate, partition, n AS stored_rows, n AS replayed_rows, true AS passed FROM days
            UNION ALL SELECT 'lifecycle_eligibility', partition, n, n, true FROM days
            UNION ALL SELECT 'completed_4h_tampered', partition, n, n, hit = 0 FROM days
            UNION ALL SELECT 'manifest_of_tampered', partition, n, n, false FROM days WHERE hit > 0
            UNION ALL SELECT 'completed_4h_restored', partition, n, n, true FROM days)
        SELECT * FROM each""",
    "completed_4h",
)
def _(v: Views):
    # The stages against a fresh replay by day; then a copy whose Wednesday mornings were changed, and that copy restored.
    spark, paths, day = v.spark, StagePaths(scratch_path(v.spark, "stages")), "yyyy-MM-dd"
    completed = _completed(v, paths)
    eligible = stage_eligibility(spark, _catalog(v), SPEC, paths)
    replayed = rollup_strict(read_stage(spark, paths.of("normalized_1h")))
    again = eligibility_projection(apply_eligibility(completed, _catalog(v), SPEC.minimum_age_days, benchmark=BENCHMARK))
    wednesday = (F.dayofweek("open_time") == 4) & (F.hour("open_time") == 8)
    copy = paths.of("copy")
    write_stage(completed, copy, day)
    altered = completed.withColumn("close", F.when(wednesday, F.col("close") + 1).otherwise(F.col("close")))
    altered.write.mode("overwrite").parquet(f"{copy}/data")
    damaged = read_stage(spark, copy, verify=False)
    named = changed_partitions(spark, copy).select(
        F.lit("manifest_of_tampered").alias("gate"), "partition", "stored_rows", F.col("recorded_rows").alias("replayed_rows"), F.lit(False).alias("passed")
    )
    return (
        partition_gate("completed_4h", completed, replayed, day)
        .unionByName(partition_gate("lifecycle_eligibility", eligible, again, day))
        .unionByName(partition_gate("completed_4h_tampered", damaged, replayed, day))
        .unionByName(named)
        .unionByName(partition_gate("completed_4h_restored", restored_stage(spark, copy, replayed), replayed, day))
    )


@query(
    "source_gate", "gate i:unequal_keys i:attempt_findings i:file_findings passed",
    """SELECT 'sources' AS gate, 0 AS unequal_keys, 0 AS attempt_findings, 0 AS file_findings, count(*) >= 0 AS passed FROM documents
        UNION ALL SELECT 'sources_damaged', count(*) FILTER (lang = 'fr'), count(*) FILTER (lang = 'fr') + count(*) FILTER (lang = 'es'), count(*) FILTER (lang = 'de'),
            count(*) FILTER (lang IN ('fr', 'es', 'de')) = 0 FROM documents""",
)
def _(v: Views):
    # Every document is a planned source; the second time French ones were never fetched, Spanish ones not verified, German ones altered.
    docs = v.table("documents").withColumn("path", F.col("doc_id").cast("string"))
    planned = docs.select(F.col("path").alias("source_key"))
    manifest = docs.select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("byte_count"))
    attempts = docs.select(F.col("path").alias("source_key"), F.lit("verified").alias("status"), "lang")
    files = docs.select("path", F.encode("text", "UTF-8").alias("content"))
    unsure = attempts.filter("lang <> 'fr'").withColumn("status", F.when(F.col("lang") == "es", "partial").otherwise(F.col("status")))
    swapped = docs.select("path", F.encode(F.when(F.col("lang") == "de", F.reverse("text")).otherwise(F.col("text")), "UTF-8").alias("content"))
    good = source_gate(planned, attempts, files, manifest)
    return good.unionByName(source_gate(planned, unsure, swapped, manifest).withColumn("gate", F.lit("sources_damaged")))
