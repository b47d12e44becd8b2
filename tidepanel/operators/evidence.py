"""Evidence rows from article tables: which article proves what about which symbol, and when."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions import text as tx
from tidepanel.session import materialize


def symbols_per_article(articles: DataFrame, known: DataFrame) -> DataFrame:
    """Known symbols of every article as an ordered array; title symbols win over body symbols.

    ``articles`` has (article_key, title, body_text), ``known`` has (symbol). Mentions are exploded
    and joined, so the known set is never carried into a task as a whole; what is folded again is
    at most the distinct symbols of one text.
    """

    def mentions(column: str, source: int) -> Column:
        return F.transform(
            tx.symbol_mentions(F.col(column)),
            lambda m: F.struct(
                F.lit(source).alias("source"), m["pos"].alias("pos"), m["value"].alias("symbol")
            ),
        )

    found = articles.select(
        "article_key",
        # The outer form: Spark would guard a plain explode by evaluating the array once more.
        F.explode_outer(F.concat(mentions("title", 0), mentions("body_text", 1))).alias("m"),
    ).select("article_key", "m.source", "m.pos", "m.symbol").filter("symbol IS NOT NULL")
    # Repeats of a symbol in one article collapse on the map side before the join.
    first = found.groupBy("article_key", "symbol").agg(
        F.min(F.when(F.col("source") == 0, F.col("pos"))).alias("titled"),
        F.min(F.when(F.col("source") == 1, F.col("pos"))).alias("in_body"),
    ).join(known.select("symbol").distinct(), "symbol", "left_semi")
    folded = first.groupBy("article_key").agg(
        F.collect_list(F.when(F.col("titled").isNotNull(), F.struct("titled", "symbol"))).alias("t"),
        F.collect_list(F.when(F.col("in_body").isNotNull(), F.struct("in_body", "symbol"))).alias("b"),
    )
    ordered = F.when(
        F.size("t") > 0, F.transform(F.array_sort("t"), lambda x: x["symbol"])
    ).otherwise(F.transform(F.array_sort("b"), lambda x: x["symbol"]))
    return folded.select("article_key", ordered.alias("symbols"))


def article_symbols(articles: DataFrame, known: DataFrame) -> DataFrame:
    """One row per (article, known symbol) with its rank of appearance."""
    return symbols_per_article(articles, known).select(
        "article_key", F.posexplode("symbols").alias("position", "symbol")
    )


def _bare(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, fv.DATE_FIRST, " "), fv.TIME_FIRST, " ")


def _rest(bare: Column, symbols: Column) -> Column:
    """What is left of a segment without its time once symbols and filler are gone."""
    return F.regexp_replace(F.aggregate(symbols, bare, lambda rest, s: F.replace(rest, s, F.lit(" "))), fv.ROW_FILLER, "")


def _by_action(launch: Column, test: Callable[[list[str]], Column]) -> Column:
    """A test with the word stems of the action that is looked for."""
    return F.when(launch, test(fv.LAUNCH_STEMS)).otherwise(test(fv.DELIST_STEMS))


_SILENT = "-"


def _acts(segment: Column, launch: Column) -> Column:
    """Does the segment, of which a stem is known to be part, state the action?"""
    return F.when(launch, segment.rlike(fv.LAUNCH_ACTION)).otherwise(segment.rlike(fv.DELIST_ACTION))


def _read_segments(text: Column, one_line: Column, launch: Column) -> Column:
    """What the segments of a text say, without the text: those with a symbol or an action, by number.

    ``bare`` is set for a segment that is but a time and symbols, and holds no more than those symbols.
    """
    def pieces(of: Column) -> Column:
        """Segments; a sentence that says nothing counts as one of them, since only neighbours matter."""

        def read(s: Column) -> Column:
            may_say = _by_action(launch, lambda stems: tx.holds_any(s, ["usdt", "busd", "usdc", *stems]))
            blank = F.array().cast("array<string>")
            return F.when(may_say, tx.untrimmed_segments(s)).when(s.rlike(r"(?U)\S"), F.array(F.lit(_SILENT))).otherwise(blank)

        return F.flatten(F.transform(tx.sentences(of), read))

    # Most sentences hold neither a symbol nor an action; plain substring tests settle them before all else.
    numbered = F.transform(F.concat(pieces(text), pieces(one_line)), lambda s, i: F.struct(i.alias("number"), s.alias("segment")))
    tested = F.transform(
        F.filter(numbered, lambda p: p["segment"] != _SILENT),
        lambda p: F.struct(
            p["number"].alias("number"), tx.trimmed(p["segment"]).alias("segment"),
            tx.may_name_symbols(p["segment"]).alias("names"), _by_action(launch, lambda stems: tx.holds_any(p["segment"], stems)).alias("stems"),
        ),
    )
    near = F.filter(tested, lambda p: p["names"] | p["stems"])
    said = F.transform(
        near,
        lambda p: F.struct(
            p["number"].alias("number"), p["segment"].alias("segment"),
            F.when(p["names"], tx.symbols_in_order(p["segment"])).otherwise(F.array().cast("array<string>")).alias("found"),
            (p["stems"] & _acts(p["segment"], launch)).alias("acts"),
        ),
    )
    read = F.transform(
        F.filter(said, lambda f: (F.size(f["found"]) > 0) | f["acts"]),
        lambda f: F.struct(
            f["number"].alias("number"), f["segment"].alias("segment"), f["found"].alias("found"), f["acts"].alias("acts"),
            F.when(tx.may_hold_instants(f["segment"]), tx.instants_in_order(f["segment"])).otherwise(F.array().cast("array<timestamp>")).alias("times"),
        ),
    )

    def narrow(f: Column) -> Column:
        mixed = tx.holds_any(f["segment"], fv.MIXED_PURPOSE_MARKERS)
        one_time = (F.size(f["found"]) > 0) & (F.size(f["times"]) == 1)
        by_length = F.transform(
            F.reverse(F.array_sort(F.transform(f["found"], lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))), lambda y: y["x"]
        )
        bare = _bare(f["segment"])
        return F.struct(
            f["number"].alias("number"), f["found"].alias("found"), F.size(f["times"]).alias("times"), F.get(f["times"], F.lit(0)).alias("at"),
            f["acts"].alias("acts"), mixed.alias("mixed"), F.when(one_time & (F.length(_rest(bare, by_length)) == 0), bare).alias("bare"),
        )

    return F.transform(read, narrow)


def _anchored_hits(read: Column, symbols: Column) -> Column:
    """array<struct<symbol, at>>: every (symbol, time) that the segments tie to an action.

    A time counts in a sentence holding the action, the symbol and exactly one time, or in a bare
    symbol/time row below an action header. A header stays in force over bare rows and ends with
    anything else; the fold over the segments of one article carries just that flag.
    """
    known = F.transform(read, lambda f: F.struct(f.alias("f"), F.array_intersect(f["found"], symbols).alias("found")))

    def judge(k: Column) -> Column:
        f, found = k["f"], k["found"]
        one_time = (F.size(found) > 0) & (f["times"] == 1)
        return F.struct(
            f["number"].alias("number"),
            F.transform(found, lambda x: F.struct(x.alias("symbol"), f["at"].alias("at"))).alias("hits"),
            (one_time & F.coalesce(F.length(_rest(f["bare"], found)) == 0, F.lit(False))).alias("bare_row"),
            (f["acts"] & one_time & ~f["mixed"]).alias("stated"),
            (f["acts"] & (F.size(found) == 0) & (f["times"] == 0)).alias("header"),
        )

    start = F.struct(
        F.lit(False).alias("below_header"), F.lit(-1).alias("number"),
        F.array().cast("array<struct<symbol:string,at:timestamp>>").alias("hits"),
    )

    def step(state: Column, f: Column) -> Column:
        below = state["below_header"] & (f["number"] == state["number"] + 1)
        counts = f["stated"] | (f["bare_row"] & below)
        return F.struct(
            F.when(f["bare_row"], below).otherwise(f["header"]).alias("below_header"), f["number"].alias("number"),
            F.when(counts, F.concat(state["hits"], f["hits"])).otherwise(state["hits"]).alias("hits"),
        )

    return F.aggregate(F.transform(known, judge), start, step, lambda state: state["hits"])


def _table_rows(one_line: Column) -> Column:
    """Explicit launch-table rows by increasing precedence; a later one overrides an earlier one."""

    def rows(pattern: str, word: str, part: str, date: int, clock: int, ampm: int, symbol: int) -> Column:
        """``word`` and ``part`` are pieces of the pattern that are found fast; most texts have none."""
        found = F.transform(
            tx.placed_instants(one_line, pattern, date, clock, ampm, symbol),
            lambda t: F.struct(F.upper(t["name"]).alias("symbol"), t["value"].alias("at")),
        )
        return F.when(tx.holds_any(one_line, [word]) & one_line.rlike(part), found).otherwise(F.array().cast("array<struct<symbol:string,at:timestamp>>"))

    return F.concat(
        rows(fv.STRUCTURED_LAUNCH, "perpetual", r"(?iuU)Perpetual\s+Contract", 1, 2, 3, 4), rows(fv.LEGACY_LAUNCH, "launch", r"(?iuU)Launch\s+Time", 2, 3, 4, 1)
    )


def read_articles(articles: DataFrame) -> DataFrame:
    """One pass over the texts: ``body_text`` gives way to what later steps need of it.

    Adds article_class, title_symbols and body_symbols (candidates by first appearance), segments and
    table_rows (of classes that can prove an event). Everything happens inside the article's row, however
    long; no text is carried on, so none is ever shuffled.
    """
    shown = F.col("body_text")
    classed = articles.withColumn("article_class", tx.article_class(F.col("title"), shown))
    launch = F.col("article_class") == fv.LAUNCH_CLASS
    proving = (launch | (F.col("article_class") == fv.DELISTING_CLASS)) & tx.may_hold_instants(shown)
    lined = classed.withColumn("__line", F.when(proving, tx.squeezed(shown)))
    return lined.withColumns(
        {
            "title_symbols": tx.symbols_in_order(F.col("title")),
            "body_symbols": F.when(tx.may_name_symbols(shown), tx.symbols_in_order(shown)).otherwise(F.array().cast("array<string>")),
            "segments": F.when(proving, _read_segments(shown, F.col("__line"), launch)),
            "table_rows": F.when(proving & launch, _table_rows(F.col("__line"))),
        }
    ).drop("body_text", "__line")


def with_known_symbols(read: DataFrame, known: DataFrame) -> DataFrame:
    """Articles that name a known symbol, with ``symbols``: those of the title or else of the body, in order.

    ``read`` comes from ``read_articles`` with an ``article_key`` and should be stored, as it is used twice.
    """
    named = read.select("article_key", F.explode(F.array_union("title_symbols", "body_symbols")).alias("symbol"))
    hits = named.join(known.select("symbol").distinct(), "symbol", "left_semi").groupBy("article_key").agg(F.collect_set("symbol").alias("__known"))

    def of(column: str) -> Column:
        return F.filter(column, lambda s: F.array_contains("__known", s))

    titled, bodied = of("title_symbols"), of("body_symbols")
    return read.join(hits, "article_key").withColumn("symbols", F.when(F.size(titled) > 0, titled).otherwise(bodied)).drop("__known")


def with_event_times(read: DataFrame) -> DataFrame:
    """Add ``events``: array<struct<symbol, official_event_at>>, one item per symbol in order.

    One distinct time per symbol is kept, several leave it unresolved; launch-table rows override for launches.
    """
    none = F.array().cast("array<struct<symbol:string,at:timestamp>>")
    hits = read.withColumns(
        {
            "__hits": F.coalesce(_anchored_hits(F.col("segments"), F.col("symbols")), none),
            "__table": F.coalesce(F.filter("table_rows", lambda r: F.array_contains("symbols", r["symbol"])), none),
        }
    )

    def event(symbol: Column) -> Column:
        def of(column: str) -> Column:
            mine = F.filter(column, lambda h: h["symbol"] == symbol)
            return F.transform(mine, lambda h: h["at"])

        anchored = F.array_distinct(of("__hits"))
        tabled = of("__table")
        at = F.when(F.size(tabled) > 0, F.element_at(tabled, -1)).when(
            F.size(anchored) == 1, F.get(anchored, F.lit(0))
        )
        return F.struct(symbol.alias("symbol"), at.alias("official_event_at"))

    return hits.withColumn("events", F.transform("symbols", event)).drop("__hits", "__table")


def timed_articles(articles: DataFrame, known: DataFrame) -> DataFrame:
    """Articles about known symbols with class, ``symbols`` and ``events``, without their bodies.

    ``articles`` has (article_key, title, body_text). What was read is stored before the known symbols decide.
    """
    # No filter here: Spark would push it below and search the texts a second time for it.
    read = materialize(read_articles(articles), "read-articles")
    return with_event_times(with_known_symbols(read, known))


def evidence_rows(
    articles: DataFrame,
    known: DataFrame,
) -> DataFrame:
    """One row per (article, symbol) with semantic class, status and event time.

    ``articles`` has (event_type, article_code, title, body_text, article_published_at) and may
    carry snapshot columns; they pass through. Every text is read once and stays where it is.
    """
    keyed = articles.withColumn("article_key", F.concat_ws("\u0001", "event_type", "article_code"))
    expected = F.when(F.col("event_type") == "listing", fv.LAUNCH_CLASS).otherwise(fv.DELISTING_CLASS)
    carried = [c for c in articles.columns if c not in ("title", "body_text")]
    timed = timed_articles(keyed, known).select(
        *carried, "title", "article_class", (F.col("article_class") == expected).alias("__accepted"),
        # Never empty here; the outer form keeps Spark from evaluating the array in a guard first.
        F.explode_outer("events").alias("e"),
    )
    accepted = F.col("__accepted")
    event_at = F.when(accepted, F.col("e.official_event_at"))
    return timed.select(
        *carried,
        F.col("e.symbol").alias("symbol"),
        F.col("title").alias("article_title"),
        F.when(accepted, "accepted").otherwise("rejected_semantic_class").alias("match_status"),
        F.col("article_class").alias("article_semantic_class"),
        F.when(accepted, "accepted_positive_semantic_evidence")
        .otherwise("rejected_not_applicable_event_semantics")
        .alias("semantic_evidence_status"),
        event_at.alias("official_event_at"),
        F.when(event_at.isNotNull(), "action_symbol_time_anchored")
        .otherwise("unresolved")
        .alias("event_time_evidence_status"),
    )


def mark_ambiguous(evidence: DataFrame) -> DataFrame:
    """Several accepted articles for one (event, symbol) make all of them ambiguous."""
    accepted = F.col("match_status") == "accepted"
    counts = evidence.filter(accepted).groupBy("event_type", "symbol").agg(
        F.count(F.lit(1)).alias("__accepted")
    )
    status = F.when(
        accepted & (F.col("__accepted") > 1), "ambiguous_multiple_applicable_articles"
    ).otherwise(F.col("match_status"))
    return (
        evidence.join(counts, ["event_type", "symbol"], "left")
        .withColumn("match_status", status)
        .drop("__accepted")
        .select(*evidence.columns)
    )


def corpus_audit(index: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per catalog: declared and actual rows, pages, candidates, and evidence row counts.

    ``index`` has (catalog_id, event_type, page, declared_total, article_code, is_candidate).
    """
    listed = index.groupBy("catalog_id", "event_type").agg(
        F.max("declared_total").alias("declared_total"),
        F.count_distinct("declared_total").alias("__totals"),
        F.count_distinct("page").alias("pages"),
        F.count(F.lit(1)).alias("article_rows"),
        F.count_if("is_candidate").alias("candidate_articles"),
    )
    proven = evidence.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("evidence_rows"),
        F.count_if(F.col("match_status") == "accepted").alias("accepted_rows"),
        F.count_if(F.col("match_status").startswith("ambiguous")).alias("ambiguous_rows"),
    )
    complete = (F.col("declared_total") == F.col("article_rows")) & (F.col("__totals") == 1)
    filled = {
        c: F.coalesce(c, F.lit(0)) for c in ("evidence_rows", "accepted_rows", "ambiguous_rows")
    }
    return (
        listed.join(proven, "event_type", "left")
        .withColumns(filled)
        .withColumn("is_complete", complete)
        .drop("__totals")
    )
