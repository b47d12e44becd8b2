"""Object keys, checksum lines and request URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.identity import is_symbol_identity

_KINDS = [
    ("monthly", fv.MONTHLY_BAR_KEY),
    ("daily", fv.DAILY_BAR_KEY),
    ("daily_trade", fv.DAILY_TRADE_KEY),
]


def parse_object_key(key: Column) -> Column:
    """struct<source_kind, symbol, interval, period, filename>, NULL for keys outside the grammar.

    The symbol must repeat in directory and file name and the period must be a real date.
    """
    result = F.lit(None).cast(
        "struct<source_kind:string,symbol:string,interval:string,period:string,filename:string>"
    )
    for kind, pattern in reversed(_KINDS):
        symbol = F.regexp_extract(key, pattern, 1)
        interval = F.regexp_extract(key, pattern, 2)
        period = F.regexp_extract(key, pattern, 3)
        dated = F.concat(period, F.lit("-01")) if kind == "monthly" else period
        valid = (
            key.rlike(pattern)
            & is_symbol_identity(symbol)
            & F.try_to_date(dated, "yyyy-MM-dd").isNotNull()
        )
        fields = F.struct(
            F.lit(kind).alias("source_kind"),
            symbol.alias("symbol"),
            F.nullif(interval, F.lit("")).alias("interval"),
            period.alias("period"),
            F.element_at(F.split(key, "/"), -1).alias("filename"),
        )
        result = F.when(valid, fields).otherwise(result)
    return result


def monthly_bar_key(symbol: Column, period: Column) -> Column:
    return F.format_string(f"{fv.MONTHLY_BAR_ROOT}%s/1h/%s-1h-%s.zip", symbol, symbol, period)


def daily_bar_key(symbol: Column, period: Column) -> Column:
    return F.format_string(f"{fv.DAILY_BAR_ROOT}%s/1h/%s-1h-%s.zip", symbol, symbol, period)


def parse_checksum_line(line: Column, filename: Column) -> Column:
    """Lower-case digest of a ``<64 hex> [*]filename`` line that names exactly this file."""
    pattern = r"^\s*([0-9a-fA-F]{64})[ \t]+\*?([^\r\n]+?)\s*\z"
    named = F.regexp_extract(line, pattern, 2) == filename
    return F.when(named, F.lower(F.regexp_extract(line, pattern, 1)))


def url_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
