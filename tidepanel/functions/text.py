"""Text extraction over article columns, in JVM expressions.

Every match keeps its position, so "in order of appearance" survives the distributed plan.
"""

from __future__ import annotations

from html.parser import HTMLParser

import html
import json
import re
import string

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tidepanel import fixed_values as fv



def char_class(chars: str, other: bool = False) -> str:
    """A class of single ASCII characters, or of all others: Java looks these up in one table, ranges one by one."""
    return f"[{'^' if other else ''}{''.join(f'\\x{ord(c):02x}' for c in chars)}]"


_CAPITALS = char_class(string.ascii_uppercase + string.digits)
_ELEMENT = "struct<pos:int,value:string>"


def _placed(text: Column, pattern: str, groups: dict[str, int], build, element: str) -> Column:
    """Array of one struct per match, built from its offset and its capture groups.

    The text is split and matched once per needed group; a single fold then walks gaps and matches
    together. The offset of a match is the length of everything before it.
    """

    def all_of(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        all_of(0).alias("whole"),
        *[all_of(g).alias(name) for name, g in groups.items()],
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{element}>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        at = state["at"] + F.length(part["gap"])
        grown = F.struct(
            (at + F.length(part["whole"])).alias("at"),
            F.array_append(state["found"], build(at, part)).alias("found"),
        )
        # The piece after the last match has no match of its own.
        return F.when(part["whole"].isNull(), state).otherwise(grown)

    return F.aggregate(parts, start, step, lambda state: state["found"])


def placed_matches(text: Column, pattern: str, group: int = 1, present: Column | None = None, first: str = "") -> Column:
    """array<struct<pos, value>> of one capture group, in order.

    ``present`` is a cheap test without which no match is possible; most texts stop there. ``first`` is a class
    of characters one of which begins every match: prose is passed over by it, not by the longer pattern.
    """
    found = _placed(
        text, f"(?={first}){pattern}" if first else pattern, {"value": group},
        lambda at, part: F.struct(at.alias("pos"), part["value"].alias("value")),
        _ELEMENT,
    )
    if present is None:
        return found
    return F.when(present, found).otherwise(F.array().cast(f"array<{_ELEMENT}>"))


def holds_any(text: Column, words: list[str]) -> Column:
    """One of some ASCII words in either case. Putting a text with other letters in lower case costs many times this."""
    first = "".join(sorted({word[0] for word in words}))
    return text.rlike(f"(?i)(?=[{first}])(?:{'|'.join(words)})")


def may_name_symbols(text: Column) -> Column:
    """Cheap necessary condition: every notation names a quote asset."""
    return (
        text.contains(fv.QUOTE_ASSET) | text.contains("BUSD") | text.contains("USDC") | _names_margined(text)
    )


def _names_margined(text: Column) -> Column:
    return (text.contains("-m") | text.contains("-M")) & holds_any(text, ["usdt-margined"])


def may_hold_instants(text: Column) -> Column:
    """Cheap necessary condition: every notation ends its clock with the zone in brackets."""
    return text.contains("(UTC)") | text.rlike(r"(?i)\(utc\)")


def _named_directly(text: Column) -> Column:
    """Matches of the one notation without white space: only lines that hold a quote asset are searched."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_ELEMENT}>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        here = F.transform(
            placed_matches(line, fv.DIRECT_SYMBOL, first=_CAPITALS),
            lambda m: F.struct((state["at"] + m["pos"]).alias("pos"), m["value"].alias("value")),
        )
        quoted = line.contains(fv.QUOTE_ASSET) | line.contains("BUSD") | line.contains("USDC")
        return F.struct(
            (state["at"] + F.length(line) + 1).alias("at"), F.when(quoted, F.concat(state["found"], here)).otherwise(state["found"]).alias("found")
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda state: state["found"])


def symbol_mentions(text: Column) -> Column:
    """All symbol candidates of the four notations with their positions (not yet distinct)."""
    quote = F.lit(fv.QUOTE_ASSET)

    def suffixed(matches: Column, upper: bool = False) -> Column:
        return F.transform(
            matches,
            lambda m: F.struct(
                m["pos"].alias("pos"),
                F.concat(F.upper(m["value"]) if upper else m["value"], quote).alias("value"),
            ),
        )

    quoted = text.contains(fv.QUOTE_ASSET)
    margined = _names_margined(text)
    shared = F.flatten(
        F.transform(
            placed_matches(text, fv.SHARED_SYMBOLS, present=margined),
            lambda outer: F.transform(
                placed_matches(outer["value"], fv.SHARED_BASE),
                lambda inner: F.struct(
                    (outer["pos"] + inner["pos"]).alias("pos"),
                    F.concat(inner["value"], quote).alias("value"),
                ),
            ),
        )
    )
    return F.concat(
        _named_directly(text),
        suffixed(placed_matches(text, fv.SLASH_SYMBOL, present=quoted & text.contains("/") & text.rlike(r"(?U)/\s*USDT"), first=_CAPITALS)),
        suffixed(placed_matches(text, fv.MARGINED_SYMBOL, present=margined), upper=True),
        shared,
    )


def symbols_in_order(text: Column) -> Column:
    """Distinct symbol candidates by first appearance."""
    ordered = F.array_sort(symbol_mentions(text))
    return F.array_distinct(F.transform(ordered, lambda m: m["value"]))


def _instant(date: Column, clock: Column, ampm: Column) -> Column:
    stamp = F.concat_ws(" ", F.replace(date, F.lit("/"), F.lit("-")), clock)
    seconds = F.size(F.split(clock, ":")) == 3
    half_day = F.concat_ws(" ", stamp, F.upper(ampm))
    return (
        F.when(
            F.length(ampm) > 0,
            F.when(seconds, F.try_to_timestamp(half_day, F.lit("yyyy-MM-dd h:mm:ss a")))
            .otherwise(F.try_to_timestamp(half_day, F.lit("yyyy-MM-dd h:mm a"))),
        )
        .when(seconds, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd H:mm:ss")))
        .otherwise(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd H:mm")))
    )


def placed_instants(
    text: Column, pattern: str, date: int, clock: int, ampm: int, symbol: int | None = None
) -> Column:
    """array<struct<pos, value, name>>: instants of a pattern with date, clock and AM/PM groups.

    ``symbol`` names a further group returned as ``name``. Impossible dates give a NULL value.
    """
    groups = {"d": date, "c": clock, "m": ampm, "n": symbol or 0}
    element = "struct<pos:int,value:timestamp,name:string>"
    found = _placed(
        text, pattern, groups,
        lambda at, p: F.struct(
            at.alias("pos"), _instant(p["d"], p["c"], p["m"]).alias("value"), p["n"].alias("name")
        ),
        element,
    )
    return F.when(may_hold_instants(text), found).otherwise(F.array().cast(f"array<{element}>"))


def instants_in_order(text: Column) -> Column:
    """Distinct UTC instants of both notations by first appearance."""
    both = F.concat(
        placed_instants(text, fv.DATE_FIRST, 1, 2, 3), placed_instants(text, fv.TIME_FIRST, 3, 1, 2)
    )
    ordered = F.array_sort(F.filter(both, lambda m: m["value"].isNotNull()))
    return F.array_distinct(F.transform(ordered, lambda m: m["value"]))


def squeezed(text: Column) -> Column:
    # A single plain space stays as it is, so most words need no replacement.
    return F.regexp_replace(text, r"(?U)[^\S ]\s*| \s+", " ")


# A line ends, or white space follows the end of a sentence; the first class is tested before all else.
_SEGMENT_END = (
    r"(?U)(?=[\s\x1C-\x1E])(?:[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]|(?<=[.!?;])\s+)"
)


def untrimmed_segments(text: Column) -> Column:
    """Lines, then sentences, with the white space around them; pieces of white space alone are dropped."""
    return F.filter(F.split(text, _SEGMENT_END), lambda p: p.rlike(r"(?U)\S"))


def sentences(text: Column) -> Column:
    """Pieces that are made of whole segments, cut by plain replacements: few hold more than one."""
    for end in ".!?;":
        text = F.replace(text, F.lit(f"{end} "), F.lit(f"{end}\n"))
    return F.split(text, "\n")


def trimmed(segment: Column) -> Column:
    return F.regexp_replace(segment, r"(?U)^\s+|(?<!\s)\s+\z", "")


def segments(text: Column) -> Column:
    """Lines, then sentences; empty pieces are dropped."""
    return F.transform(untrimmed_segments(text), trimmed)


def _mentions(text: Column, terms: list[str]) -> Column:
    any_term = F.lit(False)
    for term in terms:
        any_term = any_term | text.contains(term)
    return any_term


def _may_act(lowered: Column, stems: list[str]) -> Column:
    """Cheap necessary condition of an action pattern over lower-case text.

    A dotless i and a long s count as i and s there, so texts with them always go on to the pattern.
    """
    return _mentions(lowered, [*stems, "\u0131", "\u017f"])


def article_class(title: Column, body: Column) -> Column:
    """Product intent by ordered keyword rules; the first rule that holds decides."""
    t = F.lower(title)
    venue = _mentions(t, [fv.VENUE_TERM, fv.MARGINED_MARKET_TERM])
    perpetual = t.contains("contract") & _mentions(
        t, ["perpetual", "usdt-margined", fv.MARGINED_MARKET_TERM]
    )
    titled = venue & perpetual

    def by_body(both: Column) -> Column:
        futures = _mentions(both, [fv.VENUE_TERM, fv.MARGINED_MARKET_TERM + " futures"])
        perpetual = both.contains("perpetual") & both.contains("contract")
        return (
            F.when(both.contains("copy trading"), "copy_trading_enablement")
            .when(_mentions(both, ["trading bot", "futures grid"]), "trading_bot_enablement")
            .when(_may_act(both, fv.DELIST_STEMS) & both.rlike(fv.DELIST_ACTION), "irrelevant")
            .when(futures & perpetual & _may_act(both, fv.LAUNCH_STEMS) & both.rlike(fv.LAUNCH_ACTION), fv.LAUNCH_CLASS)
            .when(_mentions(both, ["futures", "perpetual", "contract"]), "ambiguous")
            .otherwise("irrelevant")
        )

    # An array of one, so that the text is put in lower case once for all rules and only where the title decides nothing.
    both = F.array(F.lower(F.concat(title, F.lit("\n"), F.coalesce(body, F.lit("")))))
    return (
        F.when(t.contains("copy trading"), "copy_trading_enablement")
        .when(_mentions(t, ["trading bot", "futures grid"]), "trading_bot_enablement")
        .when(_mentions(t, fv.MULTI_ASSET_TERMS), "portfolio_margin_or_multi_asset_enablement")
        .when(_mentions(t, ["pre-market", "pre market"]), "pre_market_or_other_product_enablement")
        .when(_mentions(t, ["coin-margined", "coin-m"]), "irrelevant")
        .when(titled & t.rlike(fv.DELIST_ACTION), fv.DELISTING_CLASS)
        .when(_mentions(t, fv.PARAMETER_TERMS), "contract_parameter_update")
        .when(_mentions(t, fv.OPERATIONAL_TERMS), "maintenance_or_operational")
        .when(titled & t.rlike(fv.LAUNCH_ACTION), fv.LAUNCH_CLASS)
        .otherwise(F.get(F.transform(both, by_body), F.lit(0)))
    )


def is_candidate_title(event_type: Column, title: Column) -> Column:
    """Title filter applied before article details are read."""
    t = F.lower(title)
    product = _mentions(t, ["perpetual", "contract"])
    listing = ~_mentions(t, ["delivery", "quarterly"]) & _mentions(t, ["launch", "adds"]) & product
    wanted = F.when(event_type == "listing", listing).otherwise(t.contains("delist") & product)
    return F.coalesce(t.contains(fv.VENUE_TERM) & wanted, F.lit(False))


class _VisibleText(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)


def _json_texts(root: object) -> list[str]:
    found: list[str] = []
    pending = [root]
    while pending:
        node = pending.pop()
        if isinstance(node, list):
            pending.extend(reversed(node))
        elif isinstance(node, dict):
            if isinstance(node.get("text"), str):
                found.append(node["text"])
            children = node.get("child")
            if isinstance(children, list):
                pending.extend(reversed(children))
    return found


def _plain_text(body: str | None) -> str | None:
    if body is None:
        return None
    try:
        pieces = _json_texts(json.loads(body))
    except ValueError:
        parser = _VisibleText()
        parser.feed(body)
        pieces = parser.pieces
    lines = (re.sub(r"\s+", " ", html.unescape(piece)).strip() for piece in pieces)
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def article_text(bodies: pd.Series) -> pd.Series:
    """Visible text of a JSON tree or HTML body, one line per text node.

    Exact HTML parsing has no built-in counterpart, so whole bodies go through Arrow batches here
    and nowhere else; everything after it stays in the JVM.
    """
    return bodies.map(_plain_text)
