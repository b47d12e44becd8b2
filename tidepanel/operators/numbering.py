"""Row numbers over a whole table without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.session import materialize

_PLACE_BITS = 33  # of monotonically_increasing_id: the place of a row in its partition


def with_row_number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in the order of the columns; rows equal in all of them in any order.

    Rows are dealt to ranges and sorted there, each range numbers its own and adds the count of the ranges
    before it. The ranges are stored first, so a lost executor cannot deal them anew. Only one count per range goes
    through a single task.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    id_ = F.monotonically_increasing_id()
    stored = materialize(
        sorted_.withColumns({"__range": F.shiftright(id_, _PLACE_BITS), "__place": id_.bitwiseAND((1 << _PLACE_BITS) - 1)}), "ranges"
    )
    counts = stored.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    # One row for each range, as many as the shuffle has partitions.
    return stored.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__range", "__place", "__before")
