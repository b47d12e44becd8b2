"""Fingerprints, replay equality, set equality, gate metrics and file checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.hashing import row_hash
from tidepanel.functions.timefn import Split, classify_split
from tidepanel.operators.rank import rankable


def frame_fingerprint(
    df: DataFrame, columns: Sequence[str] | None = None, hashed: Column | None = None
) -> DataFrame:
    """Content identity of a table: row count, hash sum and hash xor.

    Order and partitioning do not matter, so no sort is needed; the sum tells repeated rows apart
    from the xor. One pass, one small row out. ``hashed`` (bigint) stands in for the built-in row
    hash where other systems must compute the same fingerprint.
    """
    if hashed is None:
        hashed = row_hash(sorted(columns or df.columns))
    hashed = df.select(hashed.alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0).cast("bigint")).alias("hash_xor"),
    )


def set_fingerprint(df: DataFrame, column: str) -> DataFrame:
    """Content identity of an identity set, its size, and how many identities repeat."""
    counted = df.groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.count(F.lit(1)).alias("identity_count"),
        F.count_if(F.col("n") > 1).alias("repeated_identities"),
        F.coalesce(
            F.sum(F.xxhash64("id").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")
        ).alias("hash_sum"),
        F.coalesce(F.bit_xor(F.xxhash64("id")), F.lit(0).cast("bigint")).alias("hash_xor"),
    )


def replay_equal(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """One row: do two tables hold the same rows? Compare ``row_difference`` to see which differ."""
    if sorted(stored.columns) != sorted(replayed.columns):
        raise ValueError("stored and replayed tables have different columns")
    left = frame_fingerprint(stored).select(F.struct("*").alias("stored"))
    right = frame_fingerprint(replayed).select(F.struct("*").alias("replayed"))
    # Both sides are one aggregate row.
    return left.join(F.broadcast(right)).select(
        F.col("stored.row_count").alias("stored_rows"),
        F.col("replayed.row_count").alias("replayed_rows"),
        (F.col("stored") == F.col("replayed")).alias("is_equal"),
    )


def row_difference(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Rows held by one side only, with multiplicity, labelled by side."""
    columns = sorted(stored.columns)
    a, b = stored.select(columns), replayed.select(columns)
    return (
        a.exceptAll(b).withColumn("side", F.lit("stored"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("replayed")))
    )


def content_tree(df: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Fingerprint of a table by bucket of its keys: at most ``buckets`` small rows, one pass.

    Rows hash over all columns by name; a bucket holds the row count, sum and xor of its hashes.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    hashed = df.select(bucket.alias("bucket"), row_hash(sorted(df.columns)).alias("h"))
    return hashed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor")
    )


def differing_buckets(stored: DataFrame, replayed: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Every bucket of either table with its row counts and whether both sides agree in it."""
    a, b = (content_tree(t, keys, buckets).select("bucket", F.struct("rows", "hash_sum", "hash_xor").alias(n)) for t, n in ((stored, "a"), (replayed, "b")))
    return a.join(b, "bucket", "full_outer").select(
        "bucket", F.coalesce("a.rows", F.lit(0)).alias("stored_rows"), F.coalesce("b.rows", F.lit(0)).alias("replayed_rows"),
        (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"),
    )


def located_differences(stored: DataFrame, replayed: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Keys whose rows differ: ``changed``, ``only_stored`` or ``only_replayed``.

    Two levels: fingerprints by bucket first, then keys, but only of buckets that differ, so a table that
    agrees costs no shuffle of its rows and one with few changes shuffles few. Repeated rows count.
    """
    names = sorted(stored.columns)
    if names != sorted(replayed.columns):
        raise ValueError("stored and replayed tables have different columns")
    wrong = F.broadcast(differing_buckets(stored, replayed, keys, buckets).filter("differs").select("bucket"))  # ``buckets`` rows at most

    def side(df: DataFrame, stored_side: bool) -> DataFrame:
        near = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).join(wrong, "bucket", "left_semi")
        return near.select(*keys, row_hash(names).alias("h"), F.lit(stored_side).alias("is_stored"))

    def mark(is_stored: bool) -> Column:
        mine = F.when(F.col("is_stored") == is_stored, F.col("h"))
        return F.struct(F.count(mine).alias("n"), F.sum(mine.cast("decimal(38,0)")).alias("s"), F.bit_xor(mine).alias("x"))

    both = side(stored, True).unionByName(side(replayed, False)).groupBy(*keys).agg(mark(True).alias("a"), mark(False).alias("b"))
    return both.filter("a <> b").select(
        *keys, F.when(F.col("a.n") == 0, "only_replayed").when(F.col("b.n") == 0, "only_stored").otherwise("changed").alias("finding")
    )


def located_summary(name: str, stored: DataFrame, replayed: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """One row: source, stored_rows, replayed_rows, is_equal, from the bucket fingerprints alone."""
    return differing_buckets(stored, replayed, keys, buckets).agg(
        F.coalesce(F.sum("stored_rows"), F.lit(0)).alias("stored_rows"), F.coalesce(F.sum("replayed_rows"), F.lit(0)).alias("replayed_rows"),
        (F.count_if("differs") == 0).alias("is_equal"),
    ).withColumn("source", F.lit(name))


def set_difference(planned: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key rows of one side only; empty means the key sets are equal."""
    keys = list(keys)
    left = planned.select(*keys).distinct().withColumn("__planned", F.lit(True))
    right = actual.select(*keys).distinct().withColumn("__actual", F.lit(True))
    both = left.join(right, keys, "full_outer")
    side = F.when(F.col("__actual").isNull(), "planned_only").when(
        F.col("__planned").isNull(), "actual_only"
    )
    return both.withColumn("side", side).filter("side IS NOT NULL").select(*keys, "side")


def freshness_horizon(
    components: DataFrame, required: Column, corpus_start: Column, delisting: str = "delisting"
) -> DataFrame:
    """Common horizon of component high-water marks and whether it reaches the required one.

    ``components`` has (dataset, component, valid_through). The delisting component must not claim
    more than the start of the corpus it was read from.
    """
    beyond = (F.col("component") == delisting) & (F.col("valid_through") > corpus_start)
    return components.groupBy("dataset").agg(
        F.min("valid_through").alias("common_valid_through"),
        F.count_if(F.coalesce(beyond, F.lit(False))).alias("beyond_corpus"),
    ).withColumn(
        "is_fresh", (F.col("common_valid_through") >= required) & (F.col("beyond_corpus") == 0)
    )


def gate_metrics(name: str, checks: dict[str, Column], details: dict[str, Column], df: DataFrame) -> DataFrame:
    """One row of named boolean checks and count details; passes only if non-empty and all true.

    Checks and details are aggregate expressions over the stage table, so the gate is one job.
    Details carry counts, never aggregates of outcomes.
    """
    if not checks:
        raise ValueError("a gate needs at least one check")
    measured = df.agg(
        *[F.coalesce(expr, F.lit(False)).alias(f"check_{key}") for key, expr in checks.items()],
        *[expr.alias(f"detail_{key}") for key, expr in details.items()],
    )
    passed = F.lit(True)
    for key in checks:
        passed = passed & F.col(f"check_{key}")
    return measured.select(F.lit(name).alias("gate"), "*", passed.alias("passed"))


def slice_audit(observations: DataFrame) -> DataFrame:
    """Completeness counts of an observation table; no outcome is summarised."""
    return observations.agg(
        F.count(F.lit(1)).alias("output_rows"),
        F.count_if(rankable()).alias("eligible_altcoin_rows"),
        F.count("hot_score").alias("complete_hot_score_rows"),
        F.count("fwd_return_3d").alias("complete_3d_label_rows"),
    )


def observation_gate(observations: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Stage checks of the observation table that need no second pass."""
    split = classify_split(F.col("open_time"), splits)
    return gate_metrics(
        "observations",
        {
            "non_empty": F.count(F.lit(1)) > 0,
            "all_rows_in_a_split": F.count(split) == F.count(F.lit(1)),
            "benchmark_never_hot": F.count_if(F.col("is_benchmark") & F.col("is_hot")) == 0,
            "benchmark_never_eligible": F.count_if(F.col("is_benchmark") & F.col("is_eligible")) == 0,
            "hot_means_top_decile": F.count_if(
                F.col("is_hot") != F.coalesce(F.col("hot_decile") == 10, F.lit(False))
            ) == 0,
            "episode_only_on_hot": F.count_if(F.col("is_hot") != F.col("episode_id").isNotNull()) == 0,
        },
        {"row_count": F.count(F.lit(1)), "scored_rows": F.count("hot_score")},
        observations,
    )


def rollup_gate(groups: DataFrame) -> DataFrame:
    """Stage checks of the rollup: every accepted group is complete, groups are unique."""
    slots = F.size("offset_counts")
    complete = F.col("source_hour_count") == slots
    return gate_metrics(
        "completed_bars",
        {
            "non_empty": F.count(F.lit(1)) > 0,
            "accepted_groups_complete": F.count_if(F.col("is_accepted") & ~complete) == 0,
            "counts_reconcile": F.sum("source_hour_count")
            == F.sum(F.aggregate("offset_counts", F.lit(0).cast("bigint"), lambda a, n: a + n)),
        },
        {
            "row_count": F.count_if("is_accepted"),
            "rejected_group_count": F.count_if(~F.col("is_accepted")),
        },
        groups,
    )


def checksum_findings(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recomputed SHA-256 and size of stored files against their manifest.

    ``files`` has (path, content) as read by the binaryFile source, ``manifest`` (path, sha256,
    byte_count). Content is hashed where it is read; only digests are shuffled.
    """
    measured = files.select(
        "path",
        F.sha2(F.col("content"), 256).alias("actual_sha256"),
        F.octet_length("content").cast("bigint").alias("actual_bytes"),
    )
    listed = manifest.select("path", "sha256", "byte_count", F.lit(True).alias("__listed"))
    both = measured.join(listed, "path", "full_outer")
    finding = F.array_compact(
        F.array(
            F.when(F.col("actual_sha256").isNull(), F.lit("missing_file")),
            F.when(F.col("__listed").isNull(), F.lit("not_in_manifest")),
            F.when(F.col("actual_sha256") != F.col("sha256"), F.lit("hash_changed")),
            F.when(F.col("actual_bytes") != F.col("byte_count"), F.lit("size_changed")),
        )
    )
    return both.select("path", F.explode(finding).alias("finding"))


def conflict_class(frozen: Column, current: Column, local: Column) -> Column:
    """Corruption of the local copy is told first, then a revision upstream."""
    return (
        F.when(~local.eqNullSafe(frozen), "local_corruption")
        .when(~current.eqNullSafe(frozen), "upstream_source_revision")
        .otherwise("verified")
    )


def sidecar_provenance(snapshots: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Match snapshots to their sidecars on path, then compare URL and hash.

    Snapshots without a sidecar stay unresolved (no retrieval time); sidecars without a snapshot
    are reported, because every sidecar must belong to the manifest.
    """
    left = snapshots.select("path", F.col("url").alias("__url"), F.col("sha256").alias("__sha"))
    right = sidecars.select("path", "url", "sha256", "retrieved_at", F.lit(True).alias("__side"))
    both = left.join(right, "path", "full_outer")
    status = (
        F.when(F.col("__sha").isNull(), "sidecar_without_snapshot")
        .when(F.col("__side").isNull(), "unresolved")
        .when(~F.col("__sha").eqNullSafe(F.col("sha256")), "hash_mismatch")
        .when(F.col("__url").isNotNull() & (F.col("__url") != F.coalesce("url", F.lit(""))), "url_mismatch")
        .when(F.length(F.coalesce("retrieved_at", F.lit(""))) == 0, "no_retrieval_time")
        .otherwise("matched")
    )
    return both.select(
        "path", status.alias("status"), F.when(status == "matched", F.col("retrieved_at")).alias("retrieved_at")
    )


def evidence_role(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Role of an evidence file from the first path pattern that matches; else NULL."""
    role = F.lit(None).cast("string")
    for pattern, name in reversed(list(rules)):
        role = F.when(path.rlike(pattern), F.lit(name)).otherwise(role)
    return role

