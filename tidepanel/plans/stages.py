"""The stage chain: each stage is a stored table, each gate compares it with a fresh replay once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.operators.contracts import ContractViolation, source_containment, validate_canonical
from tidepanel.operators.eligibility import apply_eligibility, eligibility_projection
from tidepanel.operators.gaps import active_gaps, active_ranges
from tidepanel.operators.planning import attempt_findings
from tidepanel.operators.quality import checksum_findings, replay_equal, set_difference
from tidepanel.operators.rollup import rollup_rejected, rollup_strict, unexplained_rejects
from tidepanel.operators.scope import unknown_identities
from tidepanel.plans.slice import SliceSpec, observations_from_eligible
from tidepanel.sources.sinks import partition_fingerprints, read_splits, read_stage, write_by_split, write_stage


@dataclass(frozen=True)
class StagePaths:
    """Where the stages of one run live (a shared folder or object store)."""

    root: str

    def of(self, stage: str) -> str:
        return f"{self.root}/{stage}"


def _require_empty(df: DataFrame, what: str) -> None:
    if not df.isEmpty():
        raise ContractViolation(what)


def lifecycle_boundaries(ranges: DataFrame) -> DataFrame:
    """Starts and ends of active ranges as (symbol, point)."""
    return ranges.select("symbol", F.explode(F.array("range_start", "range_end")).alias("point"))


def stage_normalized(
    hourly: DataFrame, catalog: DataFrame, sources: DataFrame, approved: DataFrame,
    window_start: Column, cutoff: Column, paths: StagePaths,
) -> DataFrame:
    """Store canonical hourly bars once contract, containment, identity and gap checks hold."""
    metrics = validate_canonical(hourly, cutoff, sources).first()
    if not metrics["passed"]:
        raise ContractViolation(f"canonical bars violate their contract: {metrics.asDict()}")
    _require_empty(source_containment(hourly, sources), "rows outside the period of their source")
    _require_empty(unknown_identities(hourly, catalog), "bars of unknown instruments")
    ranges = active_ranges(catalog, window_start, cutoff).join(
        approved.select("symbol"), "symbol", "left_semi"
    )
    _require_empty(active_gaps(hourly, ranges), "unresolved gaps in active ranges")
    write_stage(hourly, paths.of("normalized_1h"))
    return read_stage(hourly.sparkSession, paths.of("normalized_1h"), verify=False)


def stage_completed(
    spark: SparkSession, ranges: DataFrame, cutoff: Column, paths: StagePaths
) -> DataFrame:
    """Store strict 4-hour bars and the rejected groups, all of which must be explained."""
    hourly = read_stage(spark, paths.of("normalized_1h"))
    rejected = rollup_rejected(hourly)
    _require_empty(
        unexplained_rejects(rejected, lifecycle_boundaries(ranges), cutoff), "unexplained rejected groups"
    )
    write_stage(rollup_strict(hourly), paths.of("completed_4h"))
    write_stage(rejected, paths.of("rejected_4h"))
    return read_stage(spark, paths.of("completed_4h"), verify=False)


def stage_eligibility(
    spark: SparkSession, catalog: DataFrame, spec: SliceSpec, paths: StagePaths
) -> DataFrame:
    """Store the eligibility projection of the 4-hour stage."""
    bars = read_stage(spark, paths.of("completed_4h"))
    _require_empty(unknown_identities(bars, catalog), "4-hour bars of unknown instruments")
    eligible = eligibility_projection(
        apply_eligibility(bars, catalog, spec.minimum_age_days, benchmark=spec.benchmark)
    )
    _require_empty(eligible.filter("is_benchmark AND is_eligible"), "the benchmark became tradable")
    write_stage(eligible, paths.of("lifecycle_eligibility"))
    return read_stage(spark, paths.of("lifecycle_eligibility"), verify=False)


def stage_observations(spark: SparkSession, spec: SliceSpec, paths: StagePaths) -> DataFrame:
    """Store observations by split; the union of the splits is the stage."""
    eligible = read_stage(spark, paths.of("lifecycle_eligibility"))
    write_by_split(observations_from_eligible(eligible, spec), spec.splits, paths.of("observations"))
    return read_splits(spark, paths.of("observations"))


def replay_gate(
    stage: str, stored: DataFrame, replayed: DataFrame, may_be_empty: bool = False
) -> DataFrame:
    """One row: the stored stage equals a fresh computation and, unless allowed, is not empty."""
    filled = F.lit(may_be_empty) | (F.col("stored_rows") > 0)
    return replay_equal(stored, replayed).select(
        F.lit(stage).alias("gate"), "*", (F.col("is_equal") & filled).alias("passed")
    )


def partition_gate(stage: str, stored: DataFrame, replayed: DataFrame, period: str = "yyyy-MM") -> DataFrame:
    """The same by time partition: gate, partition, stored_rows, replayed_rows, passed."""
    marks = F.struct("row_count", "hash_sum", "hash_xor")
    a, b = (partition_fingerprints(t, period).select("partition", marks.alias(n)) for t, n in ((stored, "a"), (replayed, "b")))
    return a.join(b, "partition", "full_outer").select(
        F.lit(stage).alias("gate"), "partition", F.coalesce("a.row_count", F.lit(0)).alias("stored_rows"),
        F.coalesce("b.row_count", F.lit(0)).alias("replayed_rows"), F.col("a").eqNullSafe(F.col("b")).alias("passed"),
    )


def source_gate(planned: DataFrame, attempts: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: every planned source was fetched once, verified, and its bytes are what the manifest says.

    ``planned`` has (source_key), ``attempts`` (source_key, status), ``files`` (path, content), ``manifest``
    (path, sha256, byte_count).
    """
    unequal = set_difference(planned, attempts, ["source_key"]).agg(F.count(F.lit(1)).alias("unequal_keys"))
    unfit = attempt_findings(attempts, planned).agg(F.count(F.lit(1)).alias("attempt_findings"))
    broken = checksum_findings(files, manifest).agg(F.count(F.lit(1)).alias("file_findings"))
    # Three aggregate rows.
    one = unequal.join(F.broadcast(unfit)).join(F.broadcast(broken))
    return one.select(
        F.lit("sources").alias("gate"), "*",
        ((F.col("unequal_keys") == 0) & (F.col("attempt_findings") == 0) & (F.col("file_findings") == 0)).alias("passed"),
    )


def gates(
    spark: SparkSession, catalog: DataFrame, spec: SliceSpec, paths: StagePaths,
    names: Sequence[str] = ("completed_4h", "rejected_4h", "lifecycle_eligibility", "observations"),
) -> DataFrame:
    """Replay every named stage from the stored stage before it."""
    hourly = spark.read.parquet(f"{paths.of('normalized_1h')}/data")
    replays = {
        "completed_4h": lambda: rollup_strict(hourly),
        "rejected_4h": lambda: rollup_rejected(hourly),
        "lifecycle_eligibility": lambda: eligibility_projection(
            apply_eligibility(
                read_stage(spark, paths.of("completed_4h")), catalog, spec.minimum_age_days,
                benchmark=spec.benchmark,
            )
        ),
        "observations": lambda: observations_from_eligible(
            read_stage(spark, paths.of("lifecycle_eligibility")), spec
        ),
    }
    result = None
    for name in names:
        if name == "observations":
            stored = read_splits(spark, paths.of(name)).drop("split")
        else:
            stored = read_stage(spark, paths.of(name))
        row = replay_gate(name, stored, replays[name](), may_be_empty=name == "rejected_4h")
        result = row if result is None else result.unionByName(row)
    return result
