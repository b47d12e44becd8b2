"""The lifecycle catalog from raw files: sources read once, evidence derived and stored, sides merged.

Sources below one folder: ``listings`` (object listing pages, XML), ``instruments`` (snapshot documents, JSON),
``reviews`` (asset, dimension, value), ``article_index`` and ``article_details`` (JSON), ``trades`` (CSV by symbol),
``scope``, ``episodes``, ``rejected`` and ``cutoffs`` (reviewed registries, JSON lines).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions import text as tx
from tidepanel.functions.keys import parse_object_key
from tidepanel.operators.catalog import CatalogInputs, catalog_merge
from tidepanel.operators.evidence import evidence_rows, mark_ambiguous
from tidepanel.operators.planning import archive_observations
from tidepanel.operators.scope import classify_scope
from tidepanel.plans.graph import TableGraph
from tidepanel.sources import bars as sb, documents as sd

REGISTRIES = {
    "reviews": "asset string, dimension string, value boolean",
    "scope": (
        "contract_identity string, base_asset string, quote_asset string, product_scope string, scope_audit_status string, "
        "is_crypto_underlying boolean, is_stablecoin_underlying boolean, is_leveraged_token boolean, stablecoin_evidence_status string, "
        "leveraged_evidence_status string"
    ),
    "episodes": (
        "symbol string, position int, lifecycle_episode_id string, listing_article_id string, opens_on timestamp, terminated_at timestamp, "
        "termination_basis string"
    ),
    "rejected": "symbol string, position int, article_id string, reason string",
    "cutoffs": (
        "symbol string, lifecycle_episode_id string, review_status string, official_publication_timestamp timestamp, article_code string, "
        "terminal_last_trading_at timestamp"
    ),
}
CATALOGS = {"listing": 48, "delisting": 161}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), "value")


def _read_registry(schema: str):
    return lambda spark, path: spark.read.schema(schema).json(path)


def _read_index(spark: SparkSession, path: str) -> DataFrame:
    return sd.flatten_article_index(_lines(spark, path).withColumn("page", F.lit(None).cast("bigint")))


def _read_details(spark: SparkSession, path: str) -> DataFrame:
    named = F.regexp_extract("value", r'"articleCode":"([^"]+)"', 1)
    return sd.flatten_article_details(_lines(spark, path).withColumn("article_code", named))


def _read_trades(spark: SparkSession, path: str) -> DataFrame:
    trades = sb.read_trades(spark, path).filter("is_valid")
    return trades.select(F.regexp_extract("source_path", "symbol=([^/]+)/", 1).alias("symbol"), "traded_at")


def archive_side(pages: DataFrame) -> DataFrame:
    parsed = sd.listing_keys(pages).select("object_key", parse_object_key(F.col("object_key")).alias("k"))
    return archive_observations(
        parsed.select("object_key", F.col("k.symbol").alias("symbol"), F.col("k.source_kind").alias("source_kind"), F.col("k.period").alias("source_period"))
    )


def evidence_side(index: DataFrame, details: DataFrame, archive: DataFrame) -> DataFrame:
    """Evidence of every listed article about the archived symbols."""
    kind = F.when(F.col("catalog_id") == CATALOGS["delisting"], "delisting").otherwise("listing")
    articles = index.select("article_code", "article_published_at", kind.alias("event_type")).join(details, "article_code").select(
        "event_type", "article_code", "title", tx.article_text(F.col("body")).alias("body_text"), "article_published_at", "raw_snapshot_sha256"
    )
    return mark_ambiguous(evidence_rows(articles, archive))


def episode_trade_side(trades: DataFrame, episodes: DataFrame) -> DataFrame:
    """First trade of every reviewed episode at or after its opening."""
    starts = episodes.select("symbol", "lifecycle_episode_id", "opens_on")
    within = trades.join(starts, "symbol").filter("traded_at >= opens_on")
    return within.groupBy("lifecycle_episode_id").agg(F.min("traded_at").alias("earliest_trade_timestamp"))


def build_catalog(
    spark: SparkSession, sources: str, root: str, acquired_at: str = "2024-02-01 00:00:00", moved: dict[str, str] | None = None
) -> TableGraph:
    """Catalog and all it is made of, stored below ``root``; see ``TableGraph`` for what is reused.

    ``moved`` names sources that lie elsewhere than below ``sources``.
    """
    graph = TableGraph(spark, root)
    readers = {
        "listings": sd.read_listing_lines, "instruments": lambda s, p: sd.flatten_instruments(_lines(s, p)),
        "article_index": _read_index, "article_details": _read_details, "trades": _read_trades,
        **{name: _read_registry(schema) for name, schema in REGISTRIES.items()},
    }
    for name, read in readers.items():
        graph.source(name, (moved or {}).get(name, f"{sources}/{name}"), read)
    graph.derive("archive", ["listings"], archive_side)
    graph.derive(
        "snapshot", ["instruments", "reviews"],
        lambda instruments, reviews: classify_scope(instruments, reviews).withColumn("metadata_acquired_at", F.lit(acquired_at).cast("timestamp")),
    )
    graph.derive("evidence", ["article_index", "article_details", "archive"], evidence_side)
    graph.derive(
        "first_trades", ["trades"],
        lambda trades: trades.groupBy("symbol").agg(F.min("traded_at").alias("earliest_trade_timestamp")).withColumn(
            "evidence_status", F.lit(fv.TRADE_EVIDENCE_STATUS)
        ),
    )
    graph.derive("episode_trades", ["trades", "episodes"], episode_trade_side)
    sides = ["archive", "snapshot", "evidence", "first_trades", "episode_trades", "cutoffs", "episodes", "rejected", "scope"]
    graph.derive("catalog", sides, lambda *tables: catalog_merge(CatalogInputs(*tables)))
    return graph


def primitive_tables(spark: SparkSession, sources: str) -> dict[str, DataFrame]:
    """The five evidence tables as the raw snapshots give them now; all have a ``symbol``.

    Discovery layers (which source knows a symbol), listed objects, article evidence, first trades and
    the boundaries of every symbol's archive.
    """
    pages = sd.read_listing_lines(spark, f"{sources}/listings")
    objects = sd.listing_keys(pages).select("object_key", parse_object_key(F.col("object_key")).alias("k")).select(
        F.col("k.symbol").alias("symbol"), F.col("k.source_kind").alias("source_kind"), F.col("k.period").alias("source_period"), "object_key"
    )
    current = sd.flatten_instruments(_lines(spark, f"{sources}/instruments")).select("symbol", F.lit("current_snapshot").alias("layer"))
    layers = objects.select("symbol", F.concat("source_kind", F.lit("_archive")).alias("layer")).unionByName(current).distinct()
    boundaries = archive_observations(objects)
    index, details = (read(spark, f"{sources}/{n}") for n, read in (("article_index", _read_index), ("article_details", _read_details)))
    first = _read_trades(spark, f"{sources}/trades").groupBy("symbol").agg(F.min("traded_at").alias("earliest_trade_timestamp"))
    return {
        "discovery_layers": layers, "listings": objects, "articles": evidence_side(index, details, boundaries), "first_trades": first,
        "boundary_indexes": boundaries,
    }
