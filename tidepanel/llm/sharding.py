"""Two-pass external shuffle into shards.

Pass one scatters the records by a seeded hash of their key into buckets small enough for memory.
Pass two shuffles each bucket with a seeded Fisher-Yates and writes it. Buckets follow one
another, so a record's place in the whole order is the number of records in earlier buckets plus its
place in its own; shard i of k takes places floor(i*n/k) to floor((i+1)*n/k) - 1. The law is ``rows``:
shard sizes differ by one row at most.

A bucket is sorted by key and content before it is shuffled, so a task that runs again gives the
same order. Records with a null key share one bucket, as do repeated records: keys should be close to
unique, otherwise name more key columns. Shards may be empty when there are fewer rows than shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tidepanel.session import scratch_path

SHARDS = 8
SEED = 20_240_229
BUCKET_BYTES = 32 << 20


def shuffle_into_shards(
    df: DataFrame, keys: list[str], size: str, shards: int = SHARDS, seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES, path: str | None = None,
) -> tuple[DataFrame, str]:
    """Write the shards below ``path`` (a fresh folder of the shared one by default) and open them.

    ``size`` is an SQL expression for the bytes of a record. Returns the written table with the
    columns of ``df`` (less any named shard, slot or bucket) plus shard and slot, and its folder.
    Files of one shard, read by slot, are in shuffled order. Only one count per bucket reaches the driver.
    """
    df = df.drop("shard", "slot", "bucket")
    total = df.agg(F.coalesce(F.sum(F.expr(size)), F.lit(0)).alias("bytes")).first()["bytes"]
    buckets = max(1, -(-int(total) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).cast("int")
    counts = np.zeros(buckets + 1, np.int64)
    for row in df.select(bucket.alias("b")).groupBy("b").count().toLocalIterator():
        counts[row["b"] + 1] = row["count"]
    before = np.cumsum(counts)
    rows = int(before[-1])
    bounds = np.array([i * rows // shards for i in range(shards + 1)], np.int64)
    out = StructType(list(df.schema.fields)).add("shard", IntegerType(), False).add("slot", LongType(), False)

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not own:
            return
        records = pa.Table.from_batches(own)
        b = records["bucket"][0].as_py()
        order = np.arange(len(records))
        rng = np.random.Generator(np.random.PCG64([seed, b]))
        for i, j in zip(range(len(order) - 1, 0, -1), rng.integers(0, np.arange(len(order), 1, -1)), strict=True):
            order[i], order[j] = order[j], order[i]
        place = before[b] + np.arange(len(order))
        shard = np.searchsorted(bounds, place, side="right") - 1
        records = records.drop_columns(["bucket"]).take(pa.array(order))
        records = records.append_column("shard", pa.array(shard, pa.int32()))
        yield from records.append_column("slot", pa.array(place - bounds[shard], pa.int64())).to_batches(max_chunksize=5000)

    # Sorting by the hash of the whole record makes the order before the shuffle definite.
    content = F.xxhash64(*[c for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")])
    scattered = (
        df.withColumn("bucket", bucket)
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions(*keys, content)
    )
    path = path or scratch_path(df.sparkSession, "shards")
    scattered.mapInArrow(fisher_yates, out).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(out).parquet(path), path
