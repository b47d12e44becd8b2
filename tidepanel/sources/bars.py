"""Bar, trade and page sources: saved files in, typed rows out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidepanel.functions.casts import cast_violation, epoch_millis, strict_double, strict_integer
from tidepanel.functions.identity import is_token
from tidepanel.schemas import RAW_BAR_COLUMNS, RAW_BAR_SCHEMA

_DOUBLES = [
    "open", "high", "low", "close", "base_volume", "quote_volume",
    "taker_buy_base_volume", "taker_buy_quote_volume",
]
_MEMBER_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("member_count", T.IntegerType()),
        T.StructField("line", T.StringType()),
    ]
)
# Lines handed over per Arrow batch: a member is streamed, never held whole as rows.
_LINES_PER_BATCH = 50_000


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(path: str, members: int, lines: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"path": path, "member_count": members, "line": lines})

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                if len(names) != 1:
                    yield pd.DataFrame({"path": [path], "member_count": [len(names)], "line": [None]})
                    continue
                with archive.open(names[0]) as member:
                    lines: list[str] = []
                    for line in io.TextIOWrapper(member, encoding="utf-8-sig", newline=None):
                        lines.append(line.rstrip("\n"))
                        if len(lines) == _LINES_PER_BATCH:
                            yield rows(path, 1, lines)
                            lines = []
                    if lines:
                        yield rows(path, 1, lines)


def unzip_lines(files: DataFrame) -> DataFrame:
    """Lines of the only CSV member of each archive; ``files`` has (path, content).

    Archives with none or several CSV members give one row with their member count and no line.
    """
    return files.select("path", "content").mapInPandas(_unzip, _MEMBER_SCHEMA)


def read_bar_archives(spark: SparkSession, path: str) -> DataFrame:
    """Raw bar rows of zipped files below a path; one task handles a batch of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.zip"
    ).load(path)
    return raw_bars_from_lines(unzip_lines(files))


def raw_bars_from_lines(lines: DataFrame) -> DataFrame:
    """12 positional text fields per line; a header line is dropped; wrong widths are marked."""
    fields = F.split("line", ",", -1)
    header = F.lower(F.trim(fields[0])).isin("open_time", "open time")
    split = lines.filter(~F.coalesce(header, F.lit(False))).withColumn("__f", fields)
    return split.select(
        F.col("path").alias("source_path"),
        F.regexp_extract("path", r"([^/]+?)-[^/-]+-[0-9-]+\.[A-Za-z]+$", 1).alias("symbol"),
        (F.coalesce(F.size("__f"), F.lit(0)) == len(RAW_BAR_COLUMNS)).alias("has_12_fields"),
        *[F.get("__f", F.lit(i)).alias(c) for i, c in enumerate(RAW_BAR_COLUMNS)],
    )


def read_bar_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw bar rows of plain CSV files; malformed widths are kept and marked, not dropped."""
    schema = T.StructType([*RAW_BAR_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    rows = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
        .withColumn("source_path", F.col("_metadata.file_path"))
    )
    header = F.lower("open_time").isin("open_time", "open time")
    return rows.filter(~F.coalesce(header, F.lit(False))).select(
        "source_path",
        F.regexp_extract("source_path", r"([^/]+?)-[^/-]+-[0-9-]+\.[A-Za-z]+$", 1).alias("symbol"),
        F.col("_corrupt").isNull().alias("has_12_fields"),
        *RAW_BAR_COLUMNS,
    )


def read_bar_json_pages(pages: DataFrame) -> DataFrame:
    """Saved pages (arrays of arrays) as raw bar rows; ``pages`` has (source_path, symbol, value)."""
    rows = pages.select(
        "source_path",
        "symbol",
        F.explode(F.from_json("value", "array<array<string>>")).alias("__f"),
    )
    return rows.select(
        "source_path",
        "symbol",
        (F.size("__f") == len(RAW_BAR_COLUMNS)).alias("has_12_fields"),
        *[F.get("__f", F.lit(i)).alias(c) for i, c in enumerate(RAW_BAR_COLUMNS)],
    )


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Typed bars from raw text rows with ``cast_errors`` naming every field that failed.

    Fields are cast strictly: what is not exact becomes NULL and is named. Callers filter or raise;
    nothing is repaired.
    """
    typed: dict[str, Column] = {c: strict_double(F.col(c)) for c in _DOUBLES}
    typed["trade_count"] = strict_integer(F.col("trade_count"), minimum=0)
    typed |= {c: epoch_millis(F.col(c)) for c in ("open_time", "close_time")}
    errors = F.array_compact(
        F.array(
            F.when(~F.col("has_12_fields"), F.lit("field_count")),
            F.when(~is_token(F.col("symbol")), F.lit("symbol")),
            *[
                F.when(F.col(c).isNull() | cast_violation(F.col(c), value), F.lit(c))
                for c, value in typed.items()
            ],
        )
    )
    return raw.select(
        "symbol",
        typed["open_time"].alias("open_time"),
        *[typed[c].alias(c) for c in ("open", "high", "low", "close", "base_volume")],
        typed["close_time"].alias("close_time"),
        typed["quote_volume"].alias("quote_volume"),
        typed["trade_count"].alias("trade_count"),
        typed["taker_buy_base_volume"].alias("taker_buy_base_volume"),
        typed["taker_buy_quote_volume"].alias("taker_buy_quote_volume"),
        "source_path",
        errors.alias("cast_errors"),
    )


def with_lineage(bars: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stamp ``source_key`` and ``source_sha256``; ``manifest`` has (source_path, source_key, sha256).

    Unlisted paths keep NULL lineage, which the canonical contract then rejects.
    """
    listed = manifest.select("source_path", "source_key", F.col("sha256").alias("source_sha256"))
    return bars.join(listed, "source_path", "left").drop("source_path")


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    result = first
    for other in others:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trade files as (source_path, traded_at, is_valid); only the time column is parsed.

    The CSV reader prunes the other columns; a header row is recognised by its first field.
    """
    schema = "id string, price string, qty string, quote_qty string, time string, is_buyer_maker string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    at = epoch_millis(F.col("time"))
    return rows.filter(F.lower(F.trim("id")) != "id").select(
        F.col("_metadata.file_path").alias("source_path"),
        at.alias("traded_at"),
        at.isNotNull().alias("is_valid"),
    )
