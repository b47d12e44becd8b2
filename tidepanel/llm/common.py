"""Small native helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.session import materialize  # noqa: F401  (re-used by the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Where a text is pure ASCII the built-in does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Key of a row for joins back to it: the id (null-safe) and a hash of the whole text.

    Rows that agree in both are copies of one another and get the same answer.
    """
    return [
        doc_id.alias("_id"),
        F.xxhash64(text, F.sha2(text, 256)).alias("_th"),
    ]


def packed(df: DataFrame) -> Column:
    """All columns of a table as the struct ``_row``, out of the way of the names an operator works with."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("_row")


def running_total(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of longs.

    Two levels, so an array of n entries costs about n * block / 2 steps of copying at most and
    not n * n.
    """
    def scan(array: Column) -> Column:
        return F.aggregate(
            array,
            F.array().cast("array<bigint>"),
            lambda done, v: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + v)),
        )

    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(block)))
    blocks = F.coalesce(
        F.transform(starts, lambda s: scan(F.slice(values, s, block))),
        F.array().cast("array<array<bigint>>"),
    )
    sums = scan(F.transform(blocks, lambda b: F.element_at(b, -1)))
    return F.flatten(
        F.transform(
            blocks,
            lambda b, i: F.transform(
                b, lambda v: v + F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(sums, i - 1))
            ),
        )
    )


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", heavy: int = 1024) -> DataFrame:
    """Join of a stored table with one whose key columns are unique, safe against hot keys.

    Keys that hold more than 1/heavy of the left rows, fewer than ``heavy`` by arithmetic, are joined by
    broadcast; all others meet in a shuffle, where none has more than that share of the rows.
    """
    total = left.count()
    hot = left.groupBy(*on).count().where(F.col("count") * heavy > total).select(*on)
    few = F.broadcast(right.join(F.broadcast(hot), on, "left_semi"))
    return (
        left.join(F.broadcast(hot), on, "left_semi").join(few, on, how)
        .unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right.join(F.broadcast(hot), on, "left_anti"), on, how))
    )
