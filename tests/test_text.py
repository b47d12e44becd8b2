"""Article text, classes, symbols and event times on the layouts that matter."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidepanel.functions import text as tx
from tidepanel.operators.evidence import evidence_rows, mark_ambiguous


def evidence(spark, cases: list[tuple], known: list[str]) -> list[dict]:
    """Evidence of (title, lines, event) cases, all in one table."""
    rows = [(event, f"c{i}", title, "\n".join(lines)) for i, (title, lines, event) in enumerate(cases)]
    articles = spark.createDataFrame(rows, "event_type string, article_code string, title string, body_text string")
    symbols = spark.createDataFrame([(s,) for s in known], "symbol string")
    found: list[dict] = [{} for _ in cases]
    for r in evidence_rows(articles, symbols).collect():
        found[int(r.article_code[1:])][r.symbol] = (r.match_status, str(r.official_event_at))
    return found


ONE = "Binance Futures Will List and Launch QQQUSDT Perpetual Contract"
TWO = "Binance Futures Will Launch QQQUSDT and RR9USDT Perpetual Contracts"
KNOWN = ["QQQUSDT", "RR9USDT"]
A, B = "2021-05-17 07:00:00", "2021-05-17 09:15:00"
FILLER = "Trading rules and fees are listed on the product page. " * 200


CASES = [
    # One sentence with action, symbol and time.
    (ONE, ["We will launch the QQQUSDT contract at 2021-05-17 07:00 (UTC).", "Up to 20x leverage."], "listing", {"QQQUSDT": A}),
    # The time stands far behind the start of a long text.
    (ONE, [FILLER, "Binance Futures will launch QQQUSDT at 2021-05-17 07:00 (UTC)."], "listing", {"QQQUSDT": A}),
    # A time without an action beside it proves nothing.
    (ONE, ["A webinar takes place at 2021-05-16 18:00 (UTC).", "Binance Futures will launch QQQUSDT soon."], "listing", {"QQQUSDT": "None"}),
    # A heading opens a list of times.
    (TWO, ["Binance Futures will launch:", "2021-05-17 07:00 (UTC): QQQUSDT", "2021-05-17 09:15 (UTC): RR9USDT"], "listing", {"QQQUSDT": A, "RR9USDT": B}),
    # Two times in one sentence leave the event open.
    (TWO, ["Binance Futures will launch QQQUSDT and RR9USDT at 2021-05-17 07:00 (UTC) or at 2021-05-17 09:15 (UTC)."], "listing", {"QQQUSDT": "None", "RR9USDT": "None"}),
    # Order of date and clock does not matter for a removal.
    ("Binance Futures Will Delist RR9USDT Perpetual Contract", ["Binance Futures will delist RR9USDT at 09:15 (UTC) on 2021-05-17."], "delisting", {"RR9USDT": B}),
]


def test_event_times_need_an_action_anchor(spark):
    got = evidence(spark, [case[:3] for case in CASES], KNOWN)
    for found, (title, lines, _, want) in zip(got, CASES, strict=True):
        assert {s: at for s, (_, at) in found.items()} == want, lines
        assert all(status == "accepted" for status, _ in found.values()), title


TITLES = [
    ("Futures Grid Now Supports 12 More Pairs", "trading_bot_enablement"),
    ("Portfolio Margin: New Collateral Ratios", "portfolio_margin_or_multi_asset_enablement"),
    ("Pre-Market Trading for QQQ Opens", "pre_market_or_other_product_enablement"),
    ("Coin-M Quarterly Contracts: Roll Dates", "irrelevant"),
    ("Binance Futures Will Delist QQQUSDT Perpetual Contract", "delisting_or_settlement"),
    ("Binance Futures Will Launch QQQUSDT Perpetual Contract", "original_perpetual_launch"),
    ("How a perpetual works", "ambiguous"),
    ("New deposit networks", "irrelevant"),
]


def test_class_words_count_wherever_they_stand(spark):
    body = FILLER + "Binance Futures will launch this perpetual contract."
    row = spark.createDataFrame([("Product news", body)], "t string, b string")
    assert row.select(tx.article_class(F.col("t"), F.col("b"))).first()[0] == "original_perpetual_launch"


def test_title_classes(spark):
    rows = spark.createDataFrame(TITLES, "t string, want string")
    for r in rows.select("t", "want", tx.article_class(F.col("t"), F.lit("")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_other_products_are_rejected(spark):
    cases = [("Margin Pairs of QQQ Will Be Removed", ["QQQUSDT perpetual positions stay open."], "delisting")]
    (found,) = evidence(spark, cases, KNOWN)
    assert found["QQQUSDT"][0] == "rejected_semantic_class"


def test_symbols_stand_alone(spark):
    texts = [("QQQUSDT, then xRR9USDT and RR9USDTs, RR9USDT", ["QQQUSDT", "RR9USDT"]), ("no pair here", [])]
    frame = spark.createDataFrame(texts, "x string, want array<string>")
    for row in frame.select(tx.symbols_in_order(F.col("x")).alias("got"), "x", "want").collect():
        assert row.got == row.want, row.x


def test_instants_in_order(spark):
    text = "2024/01/02 at 3:04 PM (UTC), 05:06:07 (utc) on 2024-01-01, 2024-01-02 15:04 (UTC), 2024-13-01 10:00 (UTC)"
    got = spark.createDataFrame([(text,)], "x string").select(tx.instants_in_order(F.col("x"))).first()[0]
    assert [str(t) for t in got] == ["2024-01-02 15:04:00", "2024-01-01 05:06:07"]


def test_article_text_of_json_and_html(spark):
    tree = json.dumps({"node": "root", "child": [{"text": " Hello &amp;  bye "}, {"child": [{"text": "deep"}]}, {"text": " "}]})
    page = "<p>One <b>two</b></p><div>three&nbsp;&lt;four&gt;</div>"
    got = spark.createDataFrame([(tree,), (page,), (None,)], "x string").select(tx.article_text(F.col("x"))).collect()
    assert [r[0] for r in got] == ["Hello & bye\ndeep", "One\ntwo\nthree <four>", None]


def test_several_accepted_articles_are_ambiguous(spark):
    rows = [("listing", "A", "accepted"), ("listing", "A", "accepted"), ("listing", "B", "accepted"), ("listing", "A", "rejected")]
    got = mark_ambiguous(spark.createDataFrame(rows, "event_type string, symbol string, match_status string")).collect()
    assert sorted(r.match_status for r in got) == ["accepted", "ambiguous_multiple_applicable_articles", "ambiguous_multiple_applicable_articles", "rejected"]


def test_segments_keep_their_neighbours_and_texts_stay_in_their_case(spark):
    """Silent sentences between a header and a row end the header; rows of white space do not."""
    title, row = ONE, "2021-05-17 07:00 (UTC): QQQUSDT"
    cases = [
        (title, ["Binance Futures WILL LAUNCH:", " \t", "", row], "listing"),
        (title, ["Binance Futures will launch:", "Note. More.", row], "listing"),
        (title, ["Ünïcode. Binance Futures will Launch QQQUSDT at 2021-05-17 07:00 (utc).  Ende; nichts\x1cmehr."], "listing"),
        (title, ["Binance Futures will launch QQQUSDT at 2021-05-17 07:00 (UTC) after System Upgrade."], "listing"),
    ]
    got = [found["QQQUSDT"][1] for found in evidence(spark, cases, KNOWN)]
    assert got == [A, "None", A, "None"]
    text = "One.  Two!\n\n  \nThree  four; five\x1e.\r\nsix? \t\n seven "
    frame = spark.createDataFrame([(text,)], "x string")
    assert frame.select(tx.segments(F.col("x"))).first()[0] == ["One.", "Two!", "Three", "four;", "five", ".", "six?", "seven"]
    assert frame.select(tx.squeezed(F.lit("a  b\tc d e\n f"))).first()[0] == "a b c d e f"


def test_texts_are_not_put_in_another_case_as_a_whole(spark):
    """Case mapping of texts with other letters took most of the scan (0.61 against 0.2 microseconds a character)."""
    from tidepanel.operators.evidence import read_articles

    articles = spark.createDataFrame([("t", "b")], "title string, body_text string")
    plan = read_articles(articles)._jdf.queryExecution().optimizedPlan().toString()
    assert "upper(body_text" not in plan and "lower(body_text" not in plan
    assert plan.count("lower(concat(title") == 1


def test_lists_are_judged_as_one_text(spark):
    """Rules of lists agree with the rule of an item on every item, without a pattern run for each of them."""
    from tidepanel.functions import identity as idn

    items = ["A1", "B" * 64, "C" * 65, "", " a", "a ", "a b", "a\nb", "A\nB", "~!", "\u00e9", "a\x00", None, "Z9"]
    lists = [[], None, ["A1"], ["A1", "Z9"], ["A1", "A1"], [None, "A\nB"], *[[x] for x in items], *[["A1", x, "Z9"] for x in items], *[[x, "Z9"] for x in items]]
    frame = spark.createDataFrame([(x,) for x in lists], "x array<string>")
    x = F.col("x")
    got = frame.select("x", idn.is_tag_list(x).alias("tags"), idn.is_distinct_token_list(x).alias("tokens"))
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    for row in got.collect():
        texts = row.x or []
        canonical = [t is not None and t != "" and t == t.strip(" ") and all(" " <= c <= "~" for c in t) for t in texts]
        tokens = [t is not None and 0 < len(t) <= 64 and all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" for c in t) for t in texts]
        assert row.tags == (bool(texts) and all(canonical)), row.x
        assert row.tokens == (bool(texts) and all(tokens) and len(set(texts)) == len(texts)), row.x


def test_batches_for_python_are_bounded_by_bytes(spark):
    """Batches of 10,000 whole texts made a worker's memory grow with the length of the texts."""
    from pyspark.sql import types as T

    from tidepanel.session import apply_runtime_conf

    @F.pandas_udf(T.LongType())
    def batch_bytes(texts):
        return texts.map(len) * 0 + int(texts.map(len).sum())

    big = apply_runtime_conf(spark).range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    assert big.select(F.max(batch_bytes("t"))).first()[0] <= 10_000_000
