"""Text evidence, casts, file sources and checks over documents, pages, orders and events."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions import text as tx
from tidepanel.functions.casts import epoch_millis, strict_double, strict_integer
from tidepanel.functions.hashing import canonical_json_digest
from tidepanel.functions.keys import parse_checksum_line
from tidepanel.operators import evidence as ev
from tidepanel.operators import quality as ql
from tidepanel.session import materialize, scratch_path
from tidepanel.sources import bars as sb
from tidepanel.sources import documents as sd
from tidepanel.workload.registry import query
from tidepanel.workload.views import SQL_VIEWS, Views, event_symbol

# --- casts -------------------------------------------------------------------------------------------


@query(
    "cast_strict_integer", "i:l_orderkey i:l_linenumber d:from_text d:from_double d:from_sum",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey END AS from_text,
        CASE WHEN l_quantity * l_discount = floor(l_quantity * l_discount) AND l_quantity * l_discount >= 1 THEN l_quantity * l_discount END AS from_double,
        CAST(l_quantity AS BIGINT) AS from_sum FROM lineitem""",
)
def _(v: Views):
    from pyspark.sql import types as T

    k, key = F.col("l_linenumber") % 3, F.col("l_orderkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("+"), key)).when(k == 1, F.concat(key, F.lit(".0"))).otherwise(F.concat(F.lit(" "), key))
    product = F.col("l_quantity") * F.col("l_discount")
    return v.table("lineitem").withColumns(
        {
            "from_text": strict_integer(text),
            "from_double": strict_integer(product, T.DoubleType(), minimum=1),
            "from_sum": strict_integer(F.col("l_quantity"), T.DoubleType()),
        }
    )


@query(
    "cast_epoch_millis", "i:event_id t:parsed",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN make_timestamp((epoch_us(ts) // 1000) * 1000) END AS parsed FROM events""",
)
def _(v: Views):
    k, millis = F.col("event_id") % 4, F.unix_millis("ts").cast("string")
    text = (
        F.when(k == 0, millis).when(k == 1, F.concat(millis, F.lit("999")))
        .when(k == 2, F.concat(F.lit("-"), millis)).otherwise(F.concat(millis, F.lit(".5")))
    )
    return v.table("events").withColumn("parsed", epoch_millis(text))


@query(
    "cast_numeric_strict", "i:event_id d:parsed bad",
    """SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN value END AS parsed, event_id % 3 = 2 AS bad FROM events""",
)
def _(v: Views):
    k, text = F.col("event_id") % 3, F.col("value").cast("string")
    raw = F.when(k == 0, text).when(k == 1, F.concat(text, F.lit("e0"))).otherwise(F.concat(text, F.lit("x")))
    parsed = strict_double(raw)
    return v.table("events").withColumns({"parsed": parsed, "bad": raw.isNotNull() & parsed.isNull()})


@query(
    "json_canonical_digest", "i:n_nationkey digest",
    """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || CAST(n_nationkey AS VARCHAR) || ',"n_regionkey":' || CAST(n_regionkey AS VARCHAR) || '}') AS digest FROM nation""",
)
def _(v: Views):
    return v.table("nation").withColumn("digest", canonical_json_digest(["n_regionkey", "n_nationkey", "n_name"]))


@query(
    "json_array_text", "i:doc_id encoded decoded",
    """SELECT doc_id, CAST(to_json([lang, source]) AS VARCHAR) AS encoded, lang || '|' || source AS decoded FROM documents""",
)
def _(v: Views):
    encoded = F.to_json(F.array("lang", "source"))
    return v.table("documents").withColumns(
        {"encoded": encoded, "decoded": F.concat_ws("|", F.from_json(encoded, "array<string>"))}
    )


# --- articles ----------------------------------------------------------------------------------------

_TITLE = """CASE k WHEN 0 THEN 'Binance Futures Will Launch ' || sym || ' Perpetual Contract'
    WHEN 1 THEN 'Binance Futures Will Delist ' || sym || ' Perpetual Contract' WHEN 2 THEN 'Copy Trading adds ' || sym
    WHEN 3 THEN 'Notice of Maintenance for ' || sym WHEN 4 THEN 'Binance Futures Will Launch ' || sym || ' and ' || other || ' Perpetual Contracts'
    WHEN 5 THEN 'Binance Futures Will Launch Perpetual Contracts' WHEN 6 THEN 'Weekly notes' ELSE 'Updates on Tick Size for ' || sym END"""
SQL_VIEWS["known"] = ("articles", "SELECT DISTINCT sym AS symbol FROM articles")
# Articles planted so that class, symbols and times are known by construction. Documents are
# searched in full; their prose holds none of the four notations for a known symbol.
SQL_VIEWS["planted"] = (
    "articles known",
    """SELECT event_type, article_code, k, sym AS symbol, 0 AS place,
            CASE k WHEN 0 THEN CAST(day AS TIMESTAMP) + INTERVAL 690 MINUTE WHEN 1 THEN CAST(day AS TIMESTAMP) + INTERVAL 915 MINUTE
                WHEN 4 THEN CAST(day AS TIMESTAMP) + INTERVAL 690 MINUTE END AS happened FROM articles
        UNION ALL SELECT event_type, article_code, k, other, 1, CAST(day AS TIMESTAMP) + INTERVAL 705 MINUTE
            FROM articles WHERE k = 4 AND other IN (SELECT symbol FROM known)""",
)
_CLASS = """CASE WHEN k IN (0, 4, 5) THEN 'original_perpetual_launch' WHEN k = 1 THEN 'delisting_or_settlement'
    WHEN k = 2 THEN 'copy_trading_enablement' WHEN k = 3 THEN 'maintenance_or_operational'
    WHEN k = 7 THEN 'contract_parameter_update' ELSE 'irrelevant' END"""


@query(
    "article_class", "article_code article_class",
    f"SELECT article_code, {_CLASS} AS article_class FROM articles", "articles",
)
def _(v: Views):
    return v.articles.withColumn("article_class", tx.article_class(F.col("title"), F.col("body_text")))


@query(
    "article_prefilter", "article_code is_candidate",
    "SELECT article_code, k IN (0, 1, 4, 5) AS is_candidate FROM articles", "articles",
)
def _(v: Views):
    return v.articles.withColumn("is_candidate", tx.is_candidate_title(F.col("event_type"), F.col("title")))


@query(
    "extract_symbols", "article_code symbol i:place",
    "SELECT article_code, symbol, place FROM planted", "planted",
)
def _(v: Views):
    keyed = v.articles.withColumn("article_key", F.col("article_code"))
    return ev.article_symbols(keyed, v.known_symbols).select(
        F.col("article_key").alias("article_code"), "symbol", F.col("position").alias("place")
    )


@query(
    "extract_timestamps", "article_code i:instants t:first_instant t:second_instant",
    """SELECT article_code, CASE WHEN k IN (0, 1) THEN 1 WHEN k IN (4, 5) THEN 2 ELSE 0 END AS instants,
        CASE k WHEN 0 THEN day + INTERVAL 690 MINUTE WHEN 1 THEN day + INTERVAL 915 MINUTE WHEN 4 THEN day + INTERVAL 690 MINUTE WHEN 5 THEN day + INTERVAL 540 MINUTE END AS first_instant,
        CASE k WHEN 4 THEN day + INTERVAL 705 MINUTE WHEN 5 THEN day + INTERVAL 480 MINUTE END AS second_instant FROM articles""",
    "articles",
)
def _(v: Views):
    found = v.articles.withColumn("f", tx.instants_in_order(F.col("body_text")))
    return found.withColumns(
        {"instants": F.size("f"), "first_instant": F.get("f", F.lit(0)), "second_instant": F.get("f", F.lit(1))}
    )


@query(
    "split_segments", "i:doc_id i:segments i:characters",
    """SELECT doc_id, len(s) AS segments, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS characters FROM (
        SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?;])[\\t-\\r ]+', '\\1' || chr(10), 'g'), '[\\n\\x0B\\f\\r]+[ \\t]*'), lambda x: trim(x) <> '') AS s FROM documents)""",
)
def _(v: Views):
    pieces = v.table("documents").withColumn("s", tx.segments(F.col("text")))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x))
    return pieces.withColumns({"segments": F.size("s"), "characters": total})


@query(
    "event_time_anchor", "article_code symbol t:official_event_at",
    "SELECT article_code, symbol, CASE WHEN k IN (0, 1, 4) THEN happened END AS official_event_at FROM planted", "planted",
)
def _(v: Views):
    keyed = v.articles.withColumn("article_key", F.col("article_code"))
    return ev.timed_articles(keyed, v.known_symbols).select("article_code", F.explode_outer("events").alias("e")).select(
        "article_code", "e.symbol", "e.official_event_at"
    )


_EVIDENCE = f"""SELECT event_type, article_code, symbol, CASE WHEN k IN (0, 1, 4, 5) THEN 'accepted' ELSE 'rejected_semantic_class' END AS match_status,
    {_CLASS} AS article_semantic_class, CASE WHEN k IN (0, 1, 4) THEN happened END AS official_event_at,
    CASE WHEN k IN (0, 1, 4) THEN 'action_symbol_time_anchored' ELSE 'unresolved' END AS event_time_evidence_status FROM planted"""


def _evidence(v: Views):
    return ev.evidence_rows(v.articles, v.known_symbols)


@query(
    "evidence_rows",
    "event_type article_code symbol match_status article_semantic_class t:official_event_at event_time_evidence_status",
    _EVIDENCE, "planted",
)
def _(v: Views):
    return _evidence(v)


@query(
    "evidence_ambiguity", "event_type article_code symbol match_status",
    f"""SELECT event_type, article_code, symbol, CASE WHEN match_status = 'accepted' AND sum(CASE WHEN match_status = 'accepted' THEN 1 ELSE 0 END)
        OVER (PARTITION BY event_type, symbol) > 1 THEN 'ambiguous_multiple_applicable_articles' ELSE match_status END AS match_status FROM ({_EVIDENCE})""",
    "planted",
)
def _(v: Views):
    return ev.mark_ambiguous(_evidence(v))


@query(
    "corpus_audit",
    "i:catalog_id event_type i:declared_total i:pages i:article_rows i:candidate_articles i:evidence_rows i:accepted_rows i:ambiguous_rows is_complete",
    f"""SELECT CASE event_type WHEN 'listing' THEN 48 ELSE 161 END AS catalog_id, event_type, n AS declared_total, pages, n AS article_rows, c AS candidate_articles,
        e AS evidence_rows, a AS accepted_rows, 0 AS ambiguous_rows, true AS is_complete
        FROM (SELECT event_type, count(*) AS n, count(DISTINCT doc_id // 50) AS pages, sum(CASE WHEN k IN (0, 1, 4, 5) THEN 1 ELSE 0 END) AS c FROM articles GROUP BY 1)
        JOIN (SELECT event_type, count(*) AS e, sum(CASE WHEN match_status = 'accepted' THEN 1 ELSE 0 END) AS a FROM ({_EVIDENCE}) GROUP BY 1) USING (event_type)""",
    "articles planted",
)
def _(v: Views):
    number = F.expr("CAST(substring(article_code, 2) AS BIGINT)")
    totals = v.articles.groupBy("event_type").agg(F.count(F.lit(1)).alias("declared_total"))
    index = v.articles.join(totals, "event_type").select(
        F.when(F.col("event_type") == "listing", 48).otherwise(161).alias("catalog_id"), "event_type",
        F.floor(number / 50).alias("page"), "declared_total", "article_code",
        tx.is_candidate_title(F.col("event_type"), F.col("title")).alias("is_candidate"),
    )
    return ev.corpus_audit(index, _evidence(v))


# Text nodes by patterns of another kind than the operator's parser: scripts, styles, comments and tags are single
# matches, all else is text. References are resolved twice, as the operator does, ampersands last each time.
_SQL_NODE = r"<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[!/a-zA-Z][^>]*>|[^<]+|<"


def _sql_unescaped(text: str) -> str:
    for name, char in {"quot": '"', "lt": "<", "gt": ">", "copy": "\u00a9", "middot": "\u00b7", "nbsp": "\u00a0", "amp": "&"}.items():
        # These old names need no semicolon.
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return text


@query(
    "article_text", "i:page_id i:lines i:characters text_sha256",
    f"""WITH nodes AS (SELECT page_id, regexp_extract_all(html, '{_SQL_NODE}', 0, 's') AS found FROM pages),
    texts AS (SELECT page_id, list_transform(list_filter(found, lambda x: NOT regexp_matches(x, '^<[!/a-zA-Z]') OR regexp_matches(x, '^<(script|style)')),
        lambda x: regexp_replace(regexp_replace(x, '^<(script|style)[^>]*>', ''), '</(script|style)>$', '')) AS t FROM nodes),
    lines AS (SELECT page_id, list_filter(list_transform(t, lambda x: trim(regexp_replace({_sql_unescaped(_sql_unescaped("x"))}, '[\\s\\x{{a0}}]+', ' ', 'g'))),
        lambda x: x <> '') AS t FROM texts)
    SELECT page_id, greatest(len(t), 1) AS lines, length(array_to_string(t, chr(10))) AS characters, sha256(array_to_string(t, chr(10))) AS text_sha256 FROM lines""",
)
def _(v: Views):
    plain = v.table("pages").select("page_id", tx.article_text(F.col("html")).alias("x"))
    return plain.withColumns({"lines": F.size(F.split("x", "\n")), "characters": F.length("x"), "text_sha256": F.sha2("x", 256)})


@query(
    "article_text_json", "i:doc_id i:characters same",
    """SELECT doc_id, length(t) AS characters, true AS same FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\s]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM documents)""",
)
def _(v: Views):
    # The whole text as one node of a JSON tree comes back squeezed.
    body = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("child")))
    want = F.trim(F.regexp_replace("text", r"\s+", " "))
    got = tx.article_text(body)
    return v.table("documents").select("doc_id", got.alias("g"), want.alias("w")).select(
        "doc_id", F.length("g").alias("characters"), (F.col("g") == F.col("w")).alias("same")
    )


# --- sources -----------------------------------------------------------------------------------------


def _zip_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        contents = []
        for name, text in zip(batch["path"], batch["text"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(name.rsplit("/", 1)[-1].replace(".zip", ".csv"), text)
            contents.append(buffer.getvalue())
        yield pd.DataFrame({"path": batch["path"], "content": contents})


def _raw_lines(v: Views):
    """Bars of one symbol and day as CSV text with a header: at most 24 lines per file."""
    millis = lambda c: F.unix_millis(c).cast("string")
    line = F.concat_ws(
        ",", millis("open_time"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "base_volume")],
        millis("close_time"), *[F.col(c).cast("string") for c in ("quote_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume")],
        F.lit("0"),
    )
    return v.bars_1h.select("symbol", F.to_date("open_time").cast("string").alias("day"), "open_time", line.alias("line"))


def _day_files(v: Views):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("open_time", "line"))), lambda x: x["line"])
    header = F.lit(",".join(["open_time", *(f"c{i}" for i in range(11))]))
    path = F.concat(F.col("symbol"), F.lit("/1h/"), F.col("symbol"), F.lit("-1h-"), F.col("day"), F.lit(".zip"))
    return _raw_lines(v).groupBy("symbol", "day").agg(
        F.concat_ws("\n", F.array(header), lines).alias("text")
    ).select("symbol", "day", path.alias("path"), "text")


_BAR_COLS = "symbol t:open_time d:open d:high d:low d:close d:base_volume t:close_time d:quote_volume i:trade_count i:errors"
_BAR_SQL = "SELECT *, 0 AS errors FROM bars_1h"


@query("src_bar_archive", _BAR_COLS, _BAR_SQL, "bars_1h")
def _(v: Views):
    # Zip bytes as the binaryFile source would deliver them, one file per symbol and day.
    zipped = _day_files(v).select("path", "text").mapInPandas(_zip_bytes, "path string, content binary")
    raw = sb.raw_bars_from_lines(sb.unzip_lines(zipped))
    return sb.normalize_bars(raw).withColumn("errors", F.size("cast_errors"))


@query("src_bar_csv", _BAR_COLS, _BAR_SQL, "bars_1h")
def _(v: Views):
    path = scratch_path(v.spark, "csv")
    # The symbol is the directory name; plain CSV files are read back with their path.
    _raw_lines(v).select("symbol", "line").write.partitionBy("symbol").text(path)
    raw = sb.read_bar_csv(v.spark, path)
    named = raw.withColumn("symbol", F.regexp_extract("source_path", "symbol=([^/]+)/", 1))
    return sb.normalize_bars(named).withColumn("errors", F.size("cast_errors"))


@query("src_bar_json_pages", _BAR_COLS, _BAR_SQL, "bars_1h")
def _(v: Views):
    path = scratch_path(v.spark, "pages")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("open_time", "line"))), lambda x: F.split(x["line"], ","))
    pages = _raw_lines(v).groupBy("symbol", "day").agg(F.to_json(rows).alias("value"))
    pages.select("symbol", "value").write.partitionBy("symbol").text(path)
    stored = v.spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), "symbol", "value")
    return sb.normalize_bars(sb.read_bar_json_pages(stored)).withColumn("errors", F.size("cast_errors"))


@query(
    "src_lineage", "symbol t:open_time source_key source_sha256",
    """SELECT symbol, open_time, CASE WHEN hour(open_time) < 12 THEN 'first/' ELSE 'second/' END || symbol AS source_key,
        sha256(CASE WHEN hour(open_time) < 12 THEN 'first/' ELSE 'second/' END || symbol) AS source_sha256 FROM bars_1h""",
    "bars_1h",
)
def _(v: Views):
    halves = []
    for name, keep in (("first", F.hour("open_time") < 12), ("second", F.hour("open_time") >= 12)):
        rows = v.bars_1h.filter(keep).withColumn("source_path", F.concat(F.lit(f"/{name}/"), "symbol"))
        halves.append(rows)
    bars = sb.union_sources(*halves)
    key = F.expr("substring(source_path, 2)")
    manifest = bars.select("source_path").distinct().select("source_path", key.alias("source_key"), F.sha2(key, 256).alias("sha256"))
    return sb.with_lineage(bars, manifest)


@query(
    "src_trade_csv", "symbol t:earliest_trade_timestamp",
    "SELECT symbol, make_timestamp((epoch_us(first_ts) // 1000) * 1000) AS earliest_trade_timestamp FROM spans", "spans",
)
def _(v: Views):
    path = scratch_path(v.spark, "trades")
    v.table("events").select(
        event_symbol(10).alias("symbol"), "event_id", "value", F.lit(1).alias("qty"), F.col("value").alias("quote"),
        F.unix_millis("ts").alias("time"), F.lit("true").alias("maker"),
    ).write.partitionBy("symbol").csv(path)
    trades = sb.read_trades(v.spark, path).filter("is_valid")
    named = trades.withColumn("symbol", F.regexp_extract("source_path", "symbol=([^/]+)/", 1))
    from tidepanel.operators.planning import first_trades

    return first_trades(named, ["symbol"])


@query(
    "src_listing_xml", "prefix truncated i:declared_count i:entry_count object_key",
    """SELECT 'k/' || symbol || '/' AS prefix, true AS truncated, 2 * n AS declared_count, 2 * n AS entry_count, 'k/' || symbol || '/' || CAST(day AS VARCHAR) || '.zip' AS object_key
        FROM presence JOIN (SELECT symbol, count(*) AS n FROM presence GROUP BY 1) USING (symbol)""",
    "presence",
)
def _(v: Views):
    path = scratch_path(v.spark, "listing")
    name = F.concat(F.lit("k/"), "symbol", F.lit("/"), F.col("day").cast("string"), F.lit(".zip"))
    entry = F.concat(
        F.lit("<Contents><Key>"), name, F.lit("</Key></Contents><Contents><Key>"), name, F.lit(".CHECKSUM</Key></Contents>")
    )
    # One page per user: at most a month of days.
    pages = v.presence.groupBy("symbol").agg(F.concat_ws("", F.collect_list(entry)).alias("entries"), F.count(F.lit(1)).alias("n"))
    # Many pages to a file, one a line: files grow with the input's bytes, not with the number of users.
    pages.select(
        F.concat(
            F.lit('<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Prefix>k/'), "symbol",
            F.lit("/</Prefix><IsTruncated>true</IsTruncated><KeyCount>"), (F.col("n") * 2).cast("string"),
            F.lit("</KeyCount><NextContinuationToken>t</NextContinuationToken>"), "entries", F.lit("</ListBucketResult>"),
        ).alias("value"),
    ).write.text(path)
    return sd.listing_keys(sd.read_listing_lines(v.spark, path), "truncated", "declared_count", "entry_count")


@query(
    "src_instrument_json", "symbol base_asset contract_type i:tags t:exchange_info_onboard_at",
    """SELECT base || suffix AS symbol, base AS base_asset, CASE WHEN k % 7 = 6 THEN 'perpetual' ELSE 'PERPETUAL' END AS contract_type,
        CASE k % 5 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS tags, make_timestamp((1700000000 + k * 60) * 1000000) AS exchange_info_onboard_at FROM instruments""",
    "instruments",
)
def _(v: Views):
    path = scratch_path(v.spark, "instruments")
    k = F.expr("CAST(substring(base_asset, 2) AS BIGINT)")
    item = F.struct(
        "symbol", F.col("base_asset").alias("baseAsset"), F.col("quote_asset").alias("quoteAsset"),
        F.col("margin_asset").alias("marginAsset"), F.col("contract_type").alias("contractType"),
        F.col("underlying_type").alias("underlyingType"), F.col("underlying_subtype").alias("underlyingSubType"),
        F.lit("TRADING").alias("status"), ((k * 60 + 1_700_000_000) * 1000).alias("onboardDate"),
    )
    # Snapshot documents of a bounded size: one per 50 instruments.
    docs = v.instruments.groupBy(F.floor(k / 50).alias("doc")).agg(F.collect_list(item).alias("symbols"))
    docs.select(F.to_json(F.struct("symbols")).alias("value")).write.text(path)
    stored = v.spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), "value")
    return sd.flatten_instruments(stored).withColumn("tags", F.size("underlying_subtype"))


@query(
    "src_article_json", "i:page i:catalog_id article_code title i:characters t:article_published_at",
    f"""SELECT doc_id // 50 AS page, 48 AS catalog_id, article_code, {_TITLE} AS title, length(text) AS characters,
        make_timestamp((1704067200 + doc_id * 60) * 1000000) AS article_published_at FROM articles""",
    "articles",
)
def _(v: Views):
    index_path, detail_path = scratch_path(v.spark, "index"), scratch_path(v.spark, "detail")
    number = F.expr("CAST(substring(article_code, 2) AS BIGINT)")
    listed = F.struct(
        F.col("article_code").alias("code"), "title", F.unix_millis("article_published_at").alias("releaseDate")
    )
    pages = v.articles.groupBy(F.floor(number / 50).alias("page")).agg(F.collect_list(listed).alias("articles"))
    catalog = F.struct(F.lit(48).alias("catalogId"), F.lit(0).alias("total"), "articles")
    payload = F.struct(F.lit("000000").alias("code"), F.struct(F.array(catalog).alias("catalogs")).alias("data"))
    pages.select(F.to_json(payload).alias("value"), "page").write.partitionBy("page").text(index_path)
    detail = F.struct(
        F.lit("000000").alias("code"), F.struct("title", F.col("body_text").alias("body")).alias("data")
    )
    v.articles.select("article_code", F.to_json(detail).alias("value")).write.parquet(detail_path)
    index = sd.flatten_article_index(
        v.spark.read.text(index_path).select(F.col("_metadata.file_path").alias("source_path"), F.col("page").cast("bigint").alias("page"), "value")
    )
    details = sd.flatten_article_details(v.spark.read.parquet(detail_path))
    # The body starts with a planted first line; the document's own part follows it.
    docs = v.table("documents").select(
        F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("article_code"), "text"
    )
    joined = index.join(details, "article_code").join(docs, "article_code")
    tail = F.length("body") - F.length("text")
    return joined.withColumn(
        "characters", F.when(F.expr("substring(body, length(body) - length(text) + 1)") == F.col("text"), F.length("body") - tail)
    )


@query(
    "file_checksum_verify", "path finding",
    """SELECT CAST(doc_id AS VARCHAR) AS path, 'hash_changed' AS finding FROM documents WHERE lang = 'de'
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 'size_changed' FROM documents WHERE strlen(text) <> n_chars
        UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), 'missing_file' FROM benchmark""",
)
def _(v: Views):
    # Stored bytes are the documents; the manifest counts characters and has stale German digests.
    docs = v.table("documents").withColumn("path", F.col("doc_id").cast("string"))
    files = docs.select("path", F.encode("text", "UTF-8").alias("content"))
    digest = F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    manifest = docs.select("path", digest.alias("sha256"), F.col("n_chars").alias("byte_count")).unionByName(
        v.table("benchmark").select(
            F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"),
            F.length("text").cast("bigint").alias("byte_count"),
        )
    )
    return ql.checksum_findings(files, manifest)


@query(
    "file_conflict_class", "i:o_orderkey status",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'local_corruption' WHEN o_totalprice > 400000 THEN 'upstream_source_revision' ELSE 'verified' END AS status FROM orders""",
)
def _(v: Views):
    frozen = F.sha2(F.col("o_orderkey").cast("string"), 256)
    local = F.when(F.col("o_orderstatus") == "P", F.sha2("o_orderpriority", 256)).otherwise(frozen)
    current = F.when(F.col("o_totalprice") > 400_000, F.sha2("o_orderstatus", 256)).otherwise(frozen)
    return v.table("orders").withColumn("status", ql.conflict_class(frozen, current, local))


@query(
    "sidecar_provenance_join", "path status retrieved_at",
    """WITH s AS (SELECT p.url || '#' || CAST(page_id AS VARCHAR) AS path, url, sha256(html) AS h, page_id FROM pages p)
      SELECT path, CASE WHEN page_id % 7 = 0 THEN 'unresolved' WHEN page_id % 7 = 1 THEN 'hash_mismatch' WHEN page_id % 7 = 2 THEN 'url_mismatch'
            WHEN page_id % 7 = 3 THEN 'no_retrieval_time' ELSE 'matched' END AS status, CASE WHEN page_id % 7 > 3 THEN '2026-01-01' END AS retrieved_at FROM s
      UNION ALL SELECT 'extra' || CAST(item_id AS VARCHAR), 'sidecar_without_snapshot', NULL FROM benchmark""",
)
def _(v: Views):
    k = F.col("page_id") % 7
    path = F.concat("url", F.lit("#"), F.col("page_id").cast("string"))
    pages = v.table("pages")
    snapshots = pages.select(path.alias("path"), "url", F.sha2("html", 256).alias("sha256"))
    sidecars = pages.filter(k != 0).select(
        path.alias("path"), F.when(k == 2, "elsewhere").otherwise(F.col("url")).alias("url"),
        F.when(k == 1, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("sha256"),
        F.when(k == 3, "").otherwise("2026-01-01").alias("retrieved_at"),
    ).unionByName(
        v.table("benchmark").select(
            F.concat(F.lit("extra"), F.col("item_id").cast("string")).alias("path"), F.lit("u").alias("url"),
            F.sha2("text", 256).alias("sha256"), F.lit("2026-01-01").alias("retrieved_at"),
        )
    )
    return ql.sidecar_provenance(snapshots, sidecars)


@query(
    "parse_checksum_lines", "i:p_partkey digest",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN sha256(p_name) END AS digest FROM part""",
)
def _(v: Views):
    k, name = F.col("p_partkey") % 4, F.concat(F.col("p_partkey").cast("string"), F.lit(".zip"))
    digest = F.sha2("p_name", 256)
    line = (
        F.when(k == 0, F.concat(F.upper(digest), F.lit("  *"), name))
        .when(k == 1, F.concat(digest, F.lit("\t"), name))
        .when(k == 2, F.concat(digest, F.lit("  x"), name))
        .otherwise(F.concat(F.substring(digest, 1, 63), F.lit("  "), name))
    )
    path = scratch_path(v.spark, "checksums")
    v.table("part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), line).alias("value")).write.text(path)
    stored = sd.read_checksum_lines(v.spark, path).select(F.split("line", r"\|").alias("f"))
    key = F.get("f", F.lit(0))
    return stored.select(
        key.cast("bigint").alias("p_partkey"),
        parse_checksum_line(F.get("f", F.lit(1)), F.concat(key, F.lit(".zip"))).alias("digest"),
    )


@query(
    "evidence_replay_articles", "source i:stored_rows i:replayed_rows is_equal",
    f"""SELECT 'same' AS source, count(*) AS stored_rows, count(*) AS replayed_rows, true AS is_equal FROM ({_EVIDENCE})
        UNION ALL SELECT 'revised', count(*), count(*), count(*) = 0 OR bool_and(match_status <> 'accepted') FROM ({_EVIDENCE})""",
    "planted",
)
def _(v: Views):
    from tidepanel.sources.sinks import read_stage, write_stage

    # Articles are stored as raw JSON, read back and replayed; then replayed with other titles.
    raw, path = scratch_path(v.spark, "raw-articles"), scratch_path(v.spark, "evidence")
    v.articles.write.json(raw)
    write_stage(_evidence(v), path)
    stored = materialize(read_stage(v.spark, path), "stored")
    snapshots = v.spark.read.schema(v.articles.schema).json(raw)
    revised = snapshots.withColumn("title", F.regexp_replace("title", "Will (Launch|Delist)", "Notes on"))
    replays = [
        ql.replay_equal(stored, ev.evidence_rows(articles, v.known_symbols)).withColumn("source", F.lit(name))
        for name, articles in (("same", snapshots), ("revised", revised))
    ]
    return replays[0].unionByName(replays[1])
