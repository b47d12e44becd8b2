"""Stage writers and readers. Spark's committer and ``_SUCCESS`` marker do the publishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.functions.hashing import row_hash
from tidepanel.functions.timefn import Split
from tidepanel.operators.splits import with_split

_SORT = ["symbol", "open_time"]


class StageChanged(ValueError):
    """A stage read back does not match the fingerprint it was written with."""


def _sorted_within(df: DataFrame) -> DataFrame:
    keys = [k for k in _SORT if k in df.columns]
    return df.sortWithinPartitions(*keys) if keys else df


def partition_of(df: DataFrame, period: str = "yyyy-MM") -> Column:
    """Time partition of a row, or one for all where a table has no time."""
    return F.date_format("open_time", period) if "open_time" in df.columns else F.lit("all")


def partition_fingerprints(df: DataFrame, period: str = "yyyy-MM") -> DataFrame:
    """Fingerprint of every time partition: a few small rows, one pass, map-side combined."""
    hashed = df.select(partition_of(df, period).alias("partition"), row_hash(sorted(df.columns)).alias("h"))
    return hashed.groupBy("partition").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor")
    )


def write_stage(df: DataFrame, path: str, period: str = "yyyy-MM") -> None:
    """Write a new stage with the fingerprints of its partitions beside it; an existing stage is never replaced.

    Rows are sorted inside each file for tight row-group statistics; a global sort would add a
    range shuffle and change nothing, since order is no property of a table.
    """
    spark = df.sparkSession
    _sorted_within(df).write.mode("errorifexists").parquet(f"{path}/data")
    stored = spark.read.parquet(f"{path}/data")
    partition_fingerprints(stored, period).withColumn("period", F.lit(period)).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def changed_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Partitions that are not what the manifest says: (partition, recorded_rows, stored_rows)."""
    recorded = spark.read.schema(
        "partition string, row_count bigint, hash_sum decimal(38,0), hash_xor bigint, period string"
    ).json(f"{path}/manifest")
    first = recorded.select("period").first()
    marks = F.struct("row_count", "hash_sum", "hash_xor")
    now = partition_fingerprints(spark.read.parquet(f"{path}/data"), first["period"] if first else "yyyy-MM")
    both = recorded.select("partition", marks.alias("a")).join(now.select("partition", marks.alias("b")), "partition", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        "partition", F.coalesce("a.row_count", F.lit(0)).alias("recorded_rows"), F.coalesce("b.row_count", F.lit(0)).alias("stored_rows")
    )


def read_stage(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Read a stage; ``verify`` recomputes its fingerprints first and names the partitions that changed."""
    if verify and (changed := changed_partitions(spark, path).select("partition").limit(20).collect()):
        raise StageChanged(f"stage content changed: {path}, partitions {sorted(r['partition'] for r in changed)}")
    return spark.read.parquet(f"{path}/data")


def restored_stage(spark: SparkSession, path: str, replayed: DataFrame) -> DataFrame:
    """A damaged stage made whole: stored rows where the manifest holds, replayed ones where it does not.

    Only changed partitions are derived again; the caller stores the result as a new stage.
    """
    period = spark.read.schema("period string").json(f"{path}/manifest").first()["period"]
    changed = F.broadcast(changed_partitions(spark, path).select("partition"))  # one row for each period of time at most
    stored = spark.read.parquet(f"{path}/data")

    def split(df: DataFrame, how: str) -> DataFrame:
        return df.withColumn("partition", partition_of(df, period)).join(changed, "partition", how).select(*stored.columns)

    return split(stored, "left_anti").unionByName(split(replayed, "left_semi"))


def write_by_split(df: DataFrame, splits: Sequence[Split], path: str) -> None:
    """One directory per split, so a reader of one split never opens the others.

    No shuffle is added: every task writes to the few splits it holds.
    """
    with_split(df, splits).write.mode("errorifexists").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """Union of the written splits, or of the allowed ones (partition pruning)."""
    df = spark.read.parquet(path)
    if allowed is not None:
        df = df.filter(F.col("split").isin(list(allowed)))
    return df


def write_per_symbol(df: DataFrame, path: str, files_per_symbol: int = 1) -> None:
    """One directory per symbol. Raise ``files_per_symbol`` to spread a dominant symbol.

    Rows are salted by time inside a symbol, so a symbol's rows go to that many tasks.
    """
    salt = F.pmod(F.xxhash64("open_time"), F.lit(files_per_symbol))
    spread = df.repartition("symbol", salt) if files_per_symbol > 1 else df.repartition("symbol")
    spread.sortWithinPartitions(*_SORT).write.mode("errorifexists").partitionBy("symbol").parquet(path)
