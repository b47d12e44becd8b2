"""Bar panels, contracts and evidence derived from the supplied tables, in Spark and in SQL.

Every view scans whole tables; symbols come from event types and user buckets, bars from events.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.keys import daily_bar_key, monthly_bar_key
from tidepanel.functions.timefn import floor_to, plus_seconds

BENCHMARK = "CLICK0USDT"
TAGGED = "VIEW0USDT"
SPLITS = [
    ("development", "2024-01-01T00:00:00Z", "2024-01-14T23:59:59.999999Z"),
    ("validation", "2024-01-15T00:00:00Z", "2024-01-24T23:59:59.999999Z"),
    ("final_holdout", "2024-01-25T00:00:00Z", None),
]
SPLIT_SQL = (
    "CASE WHEN {t} >= TIMESTAMP '2024-01-25' THEN 'final_holdout' "
    "WHEN {t} >= TIMESTAMP '2024-01-15' THEN 'validation' "
    "WHEN {t} >= TIMESTAMP '2024-01-01' THEN 'development' END"
)
MONTH_START, MONTH_END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def event_bars(events: DataFrame, symbol: Column, seconds: int) -> DataFrame:
    """Bars of an event stream.

    First and last prices are picked by a decimal key of (instant, event_id): it breaks ties and
    keeps the aggregation buffer fixed-size, so Spark uses hash aggregation with map-side partials.
    Volumes are summed as decimals: the result does not depend on the order of rows.
    """
    order = F.unix_micros("ts").cast("decimal(38,0)") * F.lit(10**18).cast(
        "decimal(19,0)"
    ) + F.col("event_id")
    keyed = events.select(
        symbol.alias("symbol"),
        floor_to(F.col("ts"), seconds).alias("open_time"),
        (F.col("value") + 1.0).alias("price"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        order.cast("decimal(38,0)").alias("place"),
    )
    return (
        keyed.groupBy("symbol", "open_time")
        .agg(
            F.min_by("price", "place").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "place").alias("close"),
            F.sum("amount").cast("double").alias("quote_volume"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        .select(
            "symbol", "open_time", "open", "high", "low", "close",
            F.col("trade_count").cast("double").alias("base_volume"),
            F.timestamp_micros(F.unix_micros(plus_seconds(F.col("open_time"), seconds)) - 1000).alias("close_time"),
            "quote_volume", "trade_count",
            (F.col("trade_count") / 2).alias("taker_buy_base_volume"),
            (F.col("quote_volume") / 2).alias("taker_buy_quote_volume"),
        )
    )


def event_symbol(buckets: int) -> Column:
    bucket = (F.col("user_id") % buckets).cast("string")
    return F.concat(F.upper("event_type"), bucket, F.lit(fv.QUOTE_ASSET))


class Views:
    """Lazily built Spark views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        casts = {n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"}
        return df.withColumns(casts) if casts else df

    def bars(self, seconds: int, buckets: int) -> DataFrame:
        return event_bars(self.table("events"), event_symbol(buckets), seconds)

    @cached_property
    def bars_1h(self) -> DataFrame:
        return self.bars(3600, 1)

    @cached_property
    def bars_4h(self) -> DataFrame:
        return self.bars(14_400, 2)

    @cached_property
    def bars_4h_wide(self) -> DataFrame:
        return self.bars(14_400, 10)

    @cached_property
    def panel(self) -> DataFrame:
        """4-hour bars with the flags that ranks and medians need."""
        return self.bars_4h_wide.withColumns(
            {
                "is_benchmark": F.col("symbol") == BENCHMARK,
                "is_eligible": F.col("trade_count") >= 2,
            }
        )

    @cached_property
    def user_hours(self) -> DataFrame:
        """One row per user and hour with activity: a gap-heavy panel."""
        symbol = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(fv.QUOTE_ASSET))
        return (
            self.table("events")
            .select(symbol.alias("symbol"), F.date_trunc("hour", "ts").alias("open_time"))
            .distinct()
        )

    @cached_property
    def presence(self) -> DataFrame:
        symbol = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(fv.QUOTE_ASSET))
        return self.table("events").select(
            symbol.alias("symbol"), "user_id", F.to_date("ts").alias("day")
        ).distinct()

    @cached_property
    def spans(self) -> DataFrame:
        return self.spans_of(10)

    def spans_of(self, buckets: int) -> DataFrame:
        """First and last event of each symbol."""
        bucket = (F.col("user_id") % buckets).cast("int")
        return (
            self.table("events")
            .groupBy(event_symbol(buckets).alias("symbol"), F.upper("event_type").alias("kind"), bucket.alias("bucket"))
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
        )

    @cached_property
    def contracts(self) -> DataFrame:
        return self.contracts_of(10)

    def contracts_of(self, buckets: int) -> DataFrame:
        """Contract rows: the anchor is the first event; every tag and flag follows the bucket."""
        b = F.col("bucket")
        return self.spans_of(buckets).select(
            "symbol",
            F.concat("kind", b.cast("string")).alias("base_asset"),
            F.lit("USDT").alias("quote_asset"),
            F.lit("USDT").alias("margin_asset"),
            F.when(b == 9, "CURRENT").otherwise("PERPETUAL").alias("contract_type"),
            F.lit("USDM").alias("market_family"),
            F.lit("FUTURES").alias("product_family"),
            F.lit("COIN").alias("underlying_type"),
            F.when(b == 8, F.array().cast("array<string>")).otherwise(F.array(F.lit("Layer-1"))).alias("underlying_subtype"),
            F.lit(True).alias("is_crypto_underlying"),
            (b == 7).alias("is_stablecoin_underlying"),
            F.when(b != 6, F.lit(False)).alias("is_leveraged_token"),
            F.when(b == 5, "unresolved").otherwise("resolved").alias("scope_classification_status"),
            F.lit("derived").alias("scope_classification_provenance"),
            F.col("first_ts").alias("eligibility_age_anchor_at"),
            F.lit(fv.ANCHOR_BASIS).alias("eligibility_age_anchor_basis"),
            F.col("first_ts").alias("first_observed_trade_at"),
            F.lit(fv.TRADE_EVIDENCE_STATUS).alias("first_observed_trade_evidence_status"),
            F.when(b == 3, plus_seconds(F.date_trunc("day", "last_ts"), -5 * 86_400)).alias(
                "delisting_announcement_published_at"
            ),
        )

    @cached_property
    def intervals(self) -> DataFrame:
        """Lifecycle intervals: two episodes for odd buckets, one open episode for even ones."""
        day = F.date_trunc("day", "first_ts")

        def interval(position: int, start: Column, end: Column, last: Column) -> Column:
            return F.struct(
                F.col("symbol").alias("symbol"),
                F.concat("symbol", F.lit(f":{position}")).alias("lifecycle_episode_id"),
                start.alias("age_live_anchor_at"),
                F.lit(fv.ANCHOR_BASIS).alias("anchor_basis"),
                end.alias("eligibility_end_at"),
                last.alias("last_trading_at"),
            )

        none = F.lit(None).cast("timestamp")
        pair = F.array(
            interval(1, F.col("first_ts"), plus_seconds(day, 10 * 86_400), plus_seconds(day, 12 * 86_400)),
            interval(2, plus_seconds(day, 14 * 86_400), none, none),
        )
        single = F.array(interval(1, F.col("first_ts"), none, none))
        return self.spans.select(
            "symbol", F.when(F.col("bucket") % 2 == 1, pair).otherwise(single).alias("lifecycle_intervals")
        )

    @cached_property
    def order_keys(self) -> DataFrame:
        """One object key per order: monthly, daily or malformed by order status."""
        symbol = order_symbol()
        month, day = F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy-MM-dd")
        broken = F.concat(monthly_bar_key(symbol, month), F.lit(".part"))
        key = (
            F.when(F.col("o_orderstatus") == "O", monthly_bar_key(symbol, month))
            .when(F.col("o_orderstatus") == "F", daily_bar_key(symbol, day))
            .otherwise(broken)
        )
        return self.table("orders").select("o_orderkey", key.alias("object_key"))

    @cached_property
    def instruments(self) -> DataFrame:
        """One instrument per supplier, tags and malformed fields by its key."""
        k = F.col("s_suppkey")
        base = F.concat(F.lit("S"), k.cast("string"))
        tags = (
            F.when(k % 5 == 1, F.array(F.lit("Stablecoin")))
            .when(k % 5 == 2, F.array(F.lit("Leveraged-3x"), F.lit("Index")))
            .when(k % 5 == 3, F.array().cast("array<string>"))
            .otherwise(F.array(F.lit("Layer-1")))
        )
        return self.table("supplier").select(
            F.concat(base, F.when(k % 11 == 4, F.lit("BUSD")).otherwise("USDT")).alias("symbol"),
            base.alias("base_asset"),
            F.lit("USDT").alias("quote_asset"),
            F.lit("USDT").alias("margin_asset"),
            F.when(k % 7 == 6, "perpetual").otherwise("PERPETUAL").alias("contract_type"),
            F.lit("COIN").alias("underlying_type"),
            tags.alias("underlying_subtype"),
        )

    @cached_property
    def scope_reviews(self) -> DataFrame:
        """Reviews by account balance: stablecoin per base asset, leverage per symbol."""
        k = F.col("s_suppkey")
        base = F.concat(F.lit("S"), k.cast("string"))
        stable = self.table("supplier").filter(F.col("s_acctbal") > 0).select(
            base.alias("asset"), F.lit("stablecoin_underlying").alias("dimension"),
            (F.col("s_acctbal") > 8000).alias("value"),
        )
        lever = self.table("supplier").filter(F.col("s_nationkey") > 3).select(
            F.concat(base, F.lit("USDT")).alias("asset"), F.lit("leveraged_token").alias("dimension"),
            (F.col("s_nationkey") > 20).alias("value"),
        )
        return stable.unionByName(lever)

    @cached_property
    def articles(self) -> DataFrame:
        """One article per document: a title and a first line by document, then the whole text."""
        sym = F.concat(F.lit("D"), (F.col("doc_id") % 97).cast("string"), F.lit("USDT"))
        other = F.concat(F.lit("D"), ((F.col("doc_id") + 1) % 97).cast("string"), F.lit("USDT"))
        day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd")
        k = F.col("doc_id") % 8
        title = (
            F.when(k == 0, F.concat(F.lit("Binance Futures Will Launch "), sym, F.lit(" Perpetual Contract")))
            .when(k == 1, F.concat(F.lit("Binance Futures Will Delist "), sym, F.lit(" Perpetual Contract")))
            .when(k == 2, F.concat(F.lit("Copy Trading adds "), sym))
            .when(k == 3, F.concat(F.lit("Notice of Maintenance for "), sym))
            .when(k == 4, F.concat(F.lit("Binance Futures Will Launch "), sym, F.lit(" and "), other, F.lit(" Perpetual Contracts")))
            .when(k == 5, F.lit("Binance Futures Will Launch Perpetual Contracts"))
            .when(k == 6, F.lit("Weekly notes"))
            .otherwise(F.concat(F.lit("Updates on Tick Size for "), sym))
        )
        lead = (
            F.when(k == 0, F.concat(F.lit("Binance Futures will launch "), sym, F.lit(" at "), day, F.lit(" 11:30 (UTC).")))
            .when(k == 1, F.concat(F.lit("Trading of "), sym, F.lit(" will cease trading at 03:15 PM (UTC) on "), day, F.lit(".")))
            .when(
                k == 4,
                F.concat(
                    F.lit("Binance Futures will launch:\n"), day, F.lit(" 11:30 (UTC): "), sym, F.lit("\n"),
                    day, F.lit(" 11:45 (UTC): "), other,
                ),
            )
            .when(k == 5, F.concat(F.lit("We list "), sym, F.lit(" at "), day, F.lit(" 09:00 (UTC) after "), day, F.lit(" 08:00 (UTC).")))
            .otherwise(F.concat(F.lit("See "), sym, F.lit(".")))
        )
        return self.table("documents").select(
            F.when(k == 1, "delisting").otherwise("listing").alias("event_type"),
            F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("article_code"),
            title.alias("title"),
            F.concat(lead, F.lit("\n"), "text").alias("body_text"),
            F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60).alias("article_published_at"),
        )

    @cached_property
    def known_symbols(self) -> DataFrame:
        return self.table("documents").select(
            F.concat(F.lit("D"), (F.col("doc_id") % 97).cast("string"), F.lit("USDT")).alias("symbol")
        ).distinct()


def order_symbol() -> Column:
    return F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1), F.lit("USDT"))


# --- the same views in SQL -----------------------------------------------------------------------


def _bars_sql(seconds: int, buckets: int) -> str:
    us = seconds * 1_000_000
    return f"""
        SELECT symbol, open_time, open, high, low, close, CAST(trade_count AS DOUBLE) AS base_volume,
            open_time + INTERVAL {seconds} SECOND - INTERVAL 1 MILLISECOND AS close_time,
            quote_volume, trade_count
        FROM (SELECT upper(event_type) || CAST(user_id % {buckets} AS VARCHAR) || 'USDT' AS symbol,
                make_timestamp((epoch_us(ts) // {us}) * {us}) AS open_time,
                first(value + 1.0 ORDER BY ts, event_id) AS open, max(value + 1.0) AS high,
                min(value + 1.0) AS low, last(value + 1.0 ORDER BY ts, event_id) AS close,
                CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS quote_volume,
                count(*) AS trade_count
            FROM events GROUP BY 1, 2)"""


def segmented_sql(source: str) -> str:
    """Bars with segment number and position in the segment."""
    return f"""
        SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY open_time) AS rn
        FROM (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY open_time) AS seg
            FROM (SELECT *, CASE WHEN open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time)
                    = INTERVAL 4 HOUR THEN 0 ELSE 1 END AS brk FROM {source}))"""


def _spans_sql(buckets: int) -> str:
    return f"""
        SELECT upper(event_type) || CAST(user_id % {buckets} AS VARCHAR) || 'USDT' AS symbol,
            upper(event_type) AS kind, CAST(user_id % {buckets} AS INTEGER) AS bucket,
            min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n
        FROM events GROUP BY 1, 2, 3"""


_CONTRACTS = """
    SELECT symbol, bucket, first_ts AS anchor,
        CASE WHEN bucket = 5 THEN 'unresolved' ELSE 'resolved' END AS status,
        CASE WHEN bucket = 3 THEN date_trunc('day', last_ts) - INTERVAL 5 DAY END AS announced,
        bucket NOT IN (5, 6, 7, 8, 9) AS scoped
    FROM {spans}"""

_INTERVALS = """
    SELECT symbol, symbol || ':1' AS episode, first_ts AS start_at,
        CASE WHEN bucket % 2 = 1 THEN date_trunc('day', first_ts) + INTERVAL 10 DAY END AS end_at,
        CASE WHEN bucket % 2 = 1 THEN date_trunc('day', first_ts) + INTERVAL 12 DAY END AS last_at
    FROM spans
    UNION ALL
    SELECT symbol, symbol || ':2', date_trunc('day', first_ts) + INTERVAL 14 DAY, NULL, NULL
    FROM spans WHERE bucket % 2 = 1"""

_ARTICLES = """
    SELECT doc_id, doc_id % 8 AS k, 'a' || CAST(doc_id AS VARCHAR) AS article_code,
        CASE WHEN doc_id % 8 = 1 THEN 'delisting' ELSE 'listing' END AS event_type,
        'D' || CAST(doc_id % 97 AS VARCHAR) || 'USDT' AS sym,
        'D' || CAST((doc_id + 1) % 97 AS VARCHAR) || 'USDT' AS other,
        DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS day, text
    FROM documents"""

_SUPPLIERS = """
    SELECT s_suppkey AS k, 'S' || CAST(s_suppkey AS VARCHAR) AS base,
        CASE WHEN s_suppkey % 11 = 4 THEN 'BUSD' ELSE 'USDT' END AS suffix,
        s_suppkey % 5 = 1 AS stable_tag, s_suppkey % 5 = 2 AS lever_tag,
        s_suppkey % 5 <> 3 AND s_suppkey % 7 <> 6 AND s_suppkey % 11 <> 4 AS ok,
        CASE WHEN s_acctbal > 0 THEN s_acctbal > 8000 END AS stable_review,
        CASE WHEN s_nationkey > 3 AND s_suppkey % 11 <> 4 THEN s_nationkey > 20 END AS lever_review
    FROM supplier"""

# name -> (views it needs, query)
SQL_VIEWS: dict[str, tuple[str, str]] = {
    "bars_1h": ("", _bars_sql(3600, 1)),
    "bars_4h": ("", _bars_sql(14_400, 2)),
    "bars_4h_wide": ("", _bars_sql(14_400, 10)),
    "bars_1d": ("", _bars_sql(86_400, 2)),
    "seg": ("bars_4h", segmented_sql("bars_4h")),
    "panel": (
        "bars_4h_wide",
        f"SELECT *, symbol = '{BENCHMARK}' AS is_benchmark, trade_count >= 2 AS is_eligible FROM bars_4h_wide",
    ),
    "user_hours": (
        "",
        "SELECT DISTINCT 'U' || CAST(user_id AS VARCHAR) || 'USDT' AS symbol, "
        "date_trunc('hour', ts) AS open_time FROM events",
    ),
    "presence": (
        "",
        "SELECT DISTINCT 'U' || CAST(user_id AS VARCHAR) || 'USDT' AS symbol, user_id, "
        "CAST(ts AS DATE) AS day FROM events",
    ),
    "spans": ("", _spans_sql(10)),
    "spans2": ("", _spans_sql(2)),
    "contracts": ("spans", _CONTRACTS.format(spans="spans")),
    "contracts2": ("spans2", _CONTRACTS.format(spans="spans2")),
    "intervals": ("spans", _INTERVALS),
    "articles": ("", _ARTICLES),
    "instruments": ("", _SUPPLIERS),
}
