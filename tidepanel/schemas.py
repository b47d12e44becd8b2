"""Explicit schemas and driver-side column checks (no job is started by these)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

RAW_BAR_COLUMNS = [
    "open_time", "open", "high", "low", "close", "base_volume", "close_time",
    "quote_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume", "ignore",
]

# Raw fields arrive as text: exact-integer and numeric rules are applied afterwards, by expression.
RAW_BAR_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_BAR_COLUMNS])

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("open_time", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("base_volume", T.DoubleType()),
        T.StructField("close_time", T.TimestampType()),
        T.StructField("quote_volume", T.DoubleType()),
        T.StructField("trade_count", T.LongType()),
        T.StructField("taker_buy_base_volume", T.DoubleType()),
        T.StructField("taker_buy_quote_volume", T.DoubleType()),
    ]
)

INTERVAL_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("symbol", T.StringType()),
            T.StructField("lifecycle_episode_id", T.StringType()),
            T.StructField("age_live_anchor_at", T.TimestampType()),
            T.StructField("anchor_basis", T.StringType()),
            T.StructField("eligible_from", T.TimestampType()),
            T.StructField("listing_article_id", T.StringType()),
            T.StructField("delisting_announcement_published_at", T.TimestampType()),
            T.StructField("delisting_article_id", T.StringType()),
            T.StructField("last_trading_at", T.TimestampType()),
            T.StructField("termination_basis", T.StringType()),
            T.StructField("eligibility_end_at", T.TimestampType()),
            T.StructField("interval_evidence_status", T.StringType()),
            T.StructField("conflicts", T.ArrayType(T.StringType())),
        ]
    )
)

SOURCE_RANGE_SCHEMA = T.StructType(
    [
        T.StructField("source_kind", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("source_key", T.StringType()),
        T.StructField("source_period", T.StringType()),
        T.StructField("range_start", T.TimestampType()),
        T.StructField("range_end", T.TimestampType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: Spark orders NaN above all numbers, which would corrupt maxima."""
    replaced = {
        field.name: F.when(~F.isnan(field.name), F.col(field.name))
        for field in df.schema.fields
        if isinstance(field.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(replaced) if replaced else df


def as_timestamp(df: DataFrame, column: str) -> Column:
    """A column as an instant; text is parsed as ISO-8601 and malformed text becomes NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.col(column))
    return F.col(column).cast("timestamp")


def intervals_column(df: DataFrame, column: str = "lifecycle_intervals") -> Column:
    """Lifecycle intervals as array<struct>, whether stored nested or as JSON text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.from_json(F.col(column), INTERVAL_SCHEMA)
    return F.col(column)
