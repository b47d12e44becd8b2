"""The catalog as one pipeline from stored files, and what a later run of it finds.

The raw files are written from the events of the given tables: every event is a trade, every symbol of the ten
user buckets is listed, and each bucket is one lifecycle situation, as in ``workload/catalog.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.keys import daily_bar_key, monthly_bar_key
from tidepanel.functions.timefn import plus_seconds
from tidepanel.operators.quality import located_differences, located_summary
from tidepanel.plans.catalog_pipeline import CATALOGS, build_catalog, primitive_tables
from tidepanel.session import materialize, scratch_path
from tidepanel.sources.sinks import read_stage, write_stage
from tidepanel.workload.registry import query
from tidepanel.workload.views import BENCHMARK, SQL_VIEWS, Views, event_symbol

_PER_DOCUMENT = 50


def _pages(v: Views) -> DataFrame:
    """Listing pages, many to a file: the first and last monthly key of a symbol, or a daily one (bucket 9)."""
    b, month = F.col("bucket"), lambda t: F.date_format(t, "yyyy-MM")
    keys = F.when(b == 9, F.array(daily_bar_key(F.col("symbol"), F.date_format("last_ts", "yyyy-MM-dd")))).otherwise(
        F.array(monthly_bar_key(F.col("symbol"), month(F.add_months("first_ts", -b))), monthly_bar_key(F.col("symbol"), month(F.col("last_ts"))))
    )
    entries = F.concat_ws("", F.transform(keys, lambda k: F.concat(
        F.lit("<Contents><Key>"), k, F.lit("</Key></Contents><Contents><Key>"), k, F.lit(fv.CHECKSUM_SUFFIX + "</Key></Contents>")
    )))
    return v.spans.select(F.concat(
        F.lit("<ListBucketResult><Prefix>"), "symbol", F.lit("</Prefix><IsTruncated>false</IsTruncated><KeyCount>"),
        (2 * F.size(keys)).cast("string"), F.lit("</KeyCount>"), entries, F.lit("</ListBucketResult>"),
    ).alias("value"))


def _instruments(v: Views) -> DataFrame:
    """Snapshot documents of buckets 0 to 6; the tag of bucket 5 contradicts its review."""
    b = F.col("bucket")
    item = F.struct(
        "symbol", F.concat("kind", b.cast("string")).alias("baseAsset"), F.lit("USDT").alias("quoteAsset"), F.lit("USDT").alias("marginAsset"),
        F.lit("PERPETUAL").alias("contractType"), F.lit("COIN").alias("underlyingType"),
        F.array(F.when(b == 5, "Leveraged").otherwise("Layer-1")).alias("underlyingSubType"), F.unix_millis("first_ts").alias("onboardDate"),
        F.when(b < 4, "TRADING").otherwise("SETTLING").alias("status"),
    )
    document = F.pmod(F.xxhash64("symbol"), F.lit(_PER_DOCUMENT))
    return v.spans.filter(b <= 6).groupBy(document).agg(F.to_json(F.struct(F.collect_list(item).alias("symbols"))).alias("value")).select("value")


def _reviews(v: Views) -> DataFrame:
    b = F.col("bucket")
    votes = F.array(
        F.struct(F.concat("kind", b.cast("string")).alias("asset"), F.lit("stablecoin_underlying").alias("dimension"), (b == 6).alias("value")),
        F.struct(F.col("symbol").alias("asset"), F.lit("leveraged_token").alias("dimension"), F.lit(False).alias("value")),
    )
    return v.spans.filter(b <= 6).select(F.explode(votes).alias("r")).select("r.*")


def _articles(v: Views) -> DataFrame:
    """Articles about the symbols: launches (buckets 0 to 4, twice in 4), delistings (3, 5 and twice in 7)."""
    b, symbol = F.col("bucket"), F.col("symbol")
    minute = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
    start = F.when(b == 0, plus_seconds(F.col("first_ts"), 3600)).when(b == 2, plus_seconds(F.col("first_ts"), -3600))
    ended = plus_seconds(F.col("last_ts"), -4 * 86_400)
    launch = F.concat(F.lit("<p>Binance Futures will launch <b>"), symbol, F.lit("</b>"), F.coalesce(F.concat(F.lit(" at "), minute(start), F.lit(" (UTC)")), F.lit("")), F.lit(".</p>"))
    stop = F.concat(F.lit("<p>Trading of "), symbol, F.lit(" will cease trading"), F.when(b == 3, F.concat(F.lit(" at "), minute(ended), F.lit(" (UTC)"))).otherwise(""), F.lit(".</p>"))

    def article(kind: str, code: Column, body: Column, published: Column) -> Column:
        word = "Launch" if kind == "listing" else "Delist"
        return F.struct(
            F.lit(kind).alias("kind"), code.alias("code"), F.concat(F.lit(f"Binance Futures Will {word} "), symbol, F.lit(" Perpetual Contract")).alias("title"),
            body.alias("body"), F.unix_millis(published).alias("releaseDate"),
        )

    first, late = F.concat(F.lit("l"), symbol), F.concat(F.lit("x"), symbol)
    announced = plus_seconds(F.col("last_ts"), -5 * 86_400)
    return v.spans.select(F.explode(F.array_compact(F.array(
        F.when(b <= 4, article("listing", first, launch, F.col("first_ts"))),
        F.when(b == 4, article("listing", F.concat(first, F.lit("b")), launch, F.col("first_ts"))),
        F.when(b.isin(3, 5, 7), article("delisting", late, stop, announced)),
        F.when(b == 7, article("delisting", F.concat(late, F.lit("b")), stop, announced)),
    ))).alias("a")).select("a.*")


def _index(articles: DataFrame) -> DataFrame:
    catalog = F.when(F.col("kind") == "listing", CATALOGS["listing"]).otherwise(CATALOGS["delisting"])
    pages = articles.groupBy(catalog.alias("catalogId"), F.pmod(F.xxhash64("code"), F.lit(_PER_DOCUMENT))).agg(
        F.collect_list(F.struct("code", "title", "releaseDate")).alias("articles")
    )
    page = F.struct("catalogId", F.size("articles").alias("total"), "articles")
    return pages.select(F.to_json(F.struct(F.lit("000000").alias("code"), F.struct(F.array(page).alias("catalogs")).alias("data"))).alias("value"))


def _details(articles: DataFrame) -> DataFrame:
    return articles.select(
        F.to_json(F.struct(F.lit("000000").alias("code"), F.col("code").alias("articleCode"), F.struct("title", "body").alias("data"))).alias("value")
    )


def _registries(v: Views) -> dict[str, DataFrame]:
    s, b, symbol = v.spans, F.col("bucket"), F.col("symbol")
    none, text = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    day = F.date_trunc("day", "first_ts")
    scope = s.filter(b <= 8).select(
        symbol.alias("contract_identity"), F.when(b != 1, F.concat("kind", b.cast("string"))).alias("base_asset"), F.lit("USDT").alias("quote_asset"),
        F.when(symbol == BENCHMARK, fv.BENCHMARK_ONLY).when(b == 8, "excluded_stablecoin").otherwise(fv.IN_SCOPE).alias("product_scope"),
        F.when(b == 7, "open").otherwise("complete").alias("scope_audit_status"), F.lit(True).alias("is_crypto_underlying"),
        (b == 8).alias("is_stablecoin_underlying"), F.lit(False).alias("is_leveraged_token"),
        F.lit("reviewed").alias("stablecoin_evidence_status"), F.lit("reviewed").alias("leveraged_evidence_status"),
    )
    demoted, listing = F.col("kind") == "ERROR", F.concat(F.lit("l"), symbol)

    def episode(n: int, opens: Column) -> Column:
        return F.struct(
            symbol.alias("symbol"), F.lit(n).alias("position"), F.concat(symbol, F.lit(f":{n}")).alias("lifecycle_episode_id"),
            (F.when(~demoted, listing) if n == 1 else text).alias("listing_article_id"), opens.alias("opens_on"),
            none.alias("terminated_at"), text.alias("termination_basis"),
        )

    def cutoff(n: int, status: Column, published: Column, code: Column, ends: Column) -> Column:
        return F.struct(
            symbol.alias("symbol"), F.concat(symbol, F.lit(f":{n}")).alias("lifecycle_episode_id"), status.alias("review_status"),
            published.alias("official_publication_timestamp"), code.alias("article_code"), ends.alias("terminal_last_trading_at"),
        )

    status = F.when(b == 3, fv.ACCEPTED_CUTOFF).when(b == 1, fv.CONFLICTING_CUTOFF).when(b == 0, fv.CURRENT_EPISODE).otherwise(fv.NO_RELIABLE_CUTOFF)
    ends = F.when(b == 3, plus_seconds(F.col("last_ts"), -4 * 86_400)).when(b == 2, plus_seconds(day, 12 * 86_400))
    published = F.when(b == 3, plus_seconds(F.col("last_ts"), -5 * 86_400))
    code = F.when(b == 3, F.concat(F.lit("x"), symbol))
    return {
        "reviews": _reviews(v), "scope": scope,
        "episodes": s.filter(b == 2).select(F.explode(F.array(episode(1, day), episode(2, plus_seconds(day, 14 * 86_400)))).alias("e")).select("e.*"),
        "rejected": s.filter((b == 2) & demoted).select("symbol", F.lit(1).alias("position"), listing.alias("article_id"), F.lit("scheduled").alias("reason")),
        "cutoffs": s.select(F.explode(F.array_compact(F.array(
            F.when(~b.isin(4, 9), cutoff(1, status, published, code, ends)),
            F.when(b == 2, cutoff(2, F.lit(fv.CURRENT_EPISODE), none, text, none)),
        ))).alias("c")).select("c.*"),
    }


def _trades(v: Views) -> DataFrame:
    """Every event of the symbols that have trades (all but bucket 6)."""
    return v.table("events").filter(F.col("user_id") % 10 != 6).select(
        event_symbol(10).alias("symbol"), "event_id", "value", F.lit(1).alias("qty"), F.col("value").alias("quote"),
        F.unix_millis("ts").alias("time"), F.lit("true").alias("maker"),
    )


def write_sources(v: Views, path: str) -> None:
    # A row a symbol, read for every source: the events are grouped once.
    v.spans = materialize(v.spans, "spans")
    articles = _articles(v)
    texts = {"listings": _pages(v), "instruments": _instruments(v), "article_index": _index(articles), "article_details": _details(articles)}
    for name, lines in texts.items():
        lines.write.text(f"{path}/{name}")
    for name, rows in _registries(v).items():
        rows.write.json(f"{path}/{name}")
    _trades(v).write.partitionBy("symbol").csv(f"{path}/trades")


# Articles give their times by the minute; trades, index and registries by the millisecond.
SQL_VIEWS["merged"] = (
    "cat",
    """SELECT * REPLACE (date_trunc('minute', exact_official_trading_start_at) AS exact_official_trading_start_at,
            CASE WHEN b <> 6 THEN first_ts END AS eligibility_age_anchor_at),
        CASE WHEN b <> 9 THEN strftime(CAST(first_ts AS DATE) - to_months(b), '%Y-%m') END AS first_archive_month,
        CASE WHEN b <> 9 THEN strftime(last_ts, '%Y-%m') END AS last_archive_month,
        CASE WHEN b = 2 THEN (SELECT min(ts) FROM events e WHERE upper(e.event_type) || CAST(e.user_id % 10 AS VARCHAR) || 'USDT' = cat.symbol
            AND e.ts >= cat.d0 + INTERVAL 14 DAY) END AS second_start
    FROM cat""",
)


@query(
    "pipeline_catalog",
    "symbol first_archive_month last_archive_month scope_classification_status scope_disposition scope_classification_complete "
    "present_in_current_exchange_info t:eligibility_age_anchor_at t:exact_official_trading_start_at listing_article_id "
    "listing_evidence_status age_anchor_conflict_status delisting_evidence_state t:delisting_announcement_published_at "
    "t:official_last_trading_at i:lifecycle_episode_count historical_inclusion_readiness current_status_warning t:second_start",
    "SELECT * FROM merged", "merged",
)
def _(v: Views):
    sources = scratch_path(v.spark, "sources")
    write_sources(v, sources)
    graph = build_catalog(v.spark, sources, scratch_path(v.spark, "catalog"))
    second = F.get(F.filter("lifecycle_intervals", lambda i: i["lifecycle_episode_id"].endswith(":2")), F.lit(0))
    return graph.tables["catalog"].withColumn("second_start", second["age_live_anchor_at"])


@query(
    "catalog_provenance", "table_name input i:input_rows input_changed derived_again",
    """WITH span AS (SELECT count(*) AS n, count(*) FILTER (bucket = 9) AS lonely, count(*) FILTER (bucket = 2) AS twice,
            count(*) FILTER (bucket = 2 AND kind = 'ERROR') AS refused, count(*) FILTER (bucket <= 6) AS shown, count(*) FILTER (bucket <= 8) AS scoped,
            count(*) FILTER (bucket <= 4) + count(*) FILTER (bucket IN (3, 4, 5)) + 2 * count(*) FILTER (bucket = 7) AS articles,
            count(*) FILTER (bucket NOT IN (4, 9)) + count(*) FILTER (bucket = 2) AS cutoffs, count(*) FILTER (bucket <> 6) AS traded FROM spans),
        traded AS (SELECT count(*) AS n FROM events WHERE user_id % 10 <> 6),
        later AS (SELECT count(DISTINCT upper(event_type) || CAST(user_id % 10 AS VARCHAR)) AS n FROM events JOIN spans
            ON bucket = user_id % 10 AND kind = upper(event_type) WHERE bucket = 2 AND ts >= date_trunc('day', first_ts) + INTERVAL 14 DAY),
        edges(table_name, input, input_rows) AS (
            SELECT 'archive', 'listings', n FROM span UNION ALL SELECT 'snapshot', 'reviews', 2 * shown FROM span
            UNION ALL SELECT 'evidence', 'article_details', articles FROM span UNION ALL SELECT 'evidence', 'archive', n FROM span
            UNION ALL SELECT 'first_trades', 'trades', n FROM traded UNION ALL SELECT 'episode_trades', 'trades', n FROM traded
            UNION ALL SELECT 'episode_trades', 'episodes', 2 * twice FROM span UNION ALL SELECT 'catalog', 'archive', n FROM span
            UNION ALL SELECT 'catalog', 'snapshot', shown FROM span UNION ALL SELECT 'catalog', 'evidence', articles FROM span
            UNION ALL SELECT 'catalog', 'first_trades', traded FROM span UNION ALL SELECT 'catalog', 'episode_trades', twice + later.n FROM span, later
            UNION ALL SELECT 'catalog', 'cutoffs', cutoffs FROM span UNION ALL SELECT 'catalog', 'episodes', 2 * twice FROM span
            UNION ALL SELECT 'catalog', 'rejected', refused FROM span UNION ALL SELECT 'catalog', 'scope', scoped FROM span)
        SELECT *, input IN ('reviews', 'snapshot') AS input_changed, table_name IN ('snapshot', 'catalog') AS derived_again FROM edges""",
    "spans",
)
def _(v: Views):
    # A second run finds other reviews: the snapshot and the catalog are derived again, the rest is read.
    sources, root = scratch_path(v.spark, "sources"), scratch_path(v.spark, "catalog")
    write_sources(v, sources)
    before = build_catalog(v.spark, sources, root)
    revised = f"{sources}-revised"
    _reviews(v).withColumn("value", ~F.col("value")).write.json(revised)
    after = build_catalog(v.spark, sources, root, moved={"reviews": revised})
    counted_by_file = ["instruments", "article_index"]  # documents hold many instruments or articles
    return before.provenance(after).filter(~F.col("input").isin(counted_by_file))


def _stored_and_replayed(v: Views) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
    """Per evidence table: as stored, as stored by someone else, and derived anew from the raw files.

    The other store lacks bucket 1, gives bucket 3 other words or times, and has bucket 2 under a name more.
    """
    sources, root = scratch_path(v.spark, "sources"), scratch_path(v.spark, "evidence")
    write_sources(v, sources)
    out = {}
    bucket = F.regexp_extract("symbol", "([0-9])USDT$", 1).cast("int")
    other = {
        "discovery_layers": ("layer", F.lit("daily_archive")), "listings": ("object_key", F.concat("object_key", F.lit(".part"))),
        "articles": ("official_event_at", plus_seconds(F.coalesce("official_event_at", "article_published_at"), 60)),
        "first_trades": ("earliest_trade_timestamp", plus_seconds(F.col("earliest_trade_timestamp"), 1)), "boundary_indexes": ("last_archive_month", F.lit("2019-01")),
    }
    # Derived anew once, and kept: two stores are held against it, and reading articles and trades is most of the work.
    anew = {name: materialize(table, f"anew-{name}") for name, table in primitive_tables(v.spark, sources).items()}
    for name, table in primitive_tables(v.spark, sources).items():
        write_stage(table, f"{root}/{name}")
        stored = read_stage(v.spark, f"{root}/{name}")
        column, value = other[name]
        revised = stored.filter(bucket != 1).withColumn(column, F.when(bucket == 3, value).otherwise(F.col(column)))
        more = stored.filter(bucket == 2).withColumn("symbol", F.concat(F.lit("OLD"), "symbol"))
        out[name] = (stored, materialize(revised.unionByName(more), f"other-{name}"), anew[name])
    return out


# Rows of each evidence table by symbol; discovery knows one archive kind and, up to bucket 6, the snapshot.
SQL_VIEWS["primitive"] = (
    "spans",
    """SELECT 'discovery_layers' AS source, symbol, bucket, 1 + CAST(bucket <= 6 AS INTEGER) AS n FROM spans
        UNION ALL SELECT 'listings', symbol, bucket, CASE WHEN bucket = 9 THEN 1 ELSE 2 END FROM spans
        UNION ALL SELECT 'articles', symbol, bucket, CASE WHEN bucket IN (3, 4, 7) THEN 2 ELSE 1 END FROM spans WHERE bucket IN (0, 1, 2, 3, 4, 5, 7)
        UNION ALL SELECT 'first_trades', symbol, bucket, 1 FROM spans WHERE bucket <> 6
        UNION ALL SELECT 'boundary_indexes', symbol, bucket, 1 FROM spans""",
)


@query(
    "evidence_replay", "source i:stored_rows i:replayed_rows is_equal",
    """SELECT source, sum(n) AS stored_rows, sum(n) AS replayed_rows, true AS is_equal FROM primitive GROUP BY source
        UNION ALL SELECT source || ':other', coalesce(sum(CASE bucket WHEN 1 THEN 0 WHEN 2 THEN 2 * n ELSE n END), 0), sum(n), count(*) FILTER (bucket IN (1, 2, 3)) = 0
            FROM primitive GROUP BY source""",
    "primitive",
)
def _(v: Views):
    rows = None
    for name, (stored, other, replayed) in _stored_and_replayed(v).items():
        for label, side in ((name, stored), (f"{name}:other", other)):
            row = located_summary(label, side, replayed, ["symbol"])
            rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    "evidence_replay_findings", "source symbol finding",
    """SELECT source, symbol, CASE bucket WHEN 1 THEN 'only_replayed' ELSE 'changed' END AS finding FROM primitive WHERE bucket IN (1, 3)
        UNION ALL SELECT source, 'OLD' || symbol, 'only_stored' FROM primitive WHERE bucket = 2""",
    "primitive",
)
def _(v: Views):
    rows = None
    for name, (stored, other, replayed) in _stored_and_replayed(v).items():
        row = located_differences(other, replayed, ["symbol"]).unionByName(located_differences(stored, replayed, ["symbol"]))
        rows = row.withColumn("source", F.lit(name)) if rows is None else rows.unionByName(row.withColumn("source", F.lit(name)))
    return rows
