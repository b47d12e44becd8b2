"""Identity rules as predicates over columns."""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tidepanel.functions.text import char_class

# Faults of the lines of a text: no printable ASCII, empty or padded; no capitals and digits, empty or too long.
_CAPITALS = string.ascii_uppercase + string.digits
_NOT_CANONICAL = char_class("".join(map(chr, range(0x20, 0x7F))) + "\n", other=True) + r"|\n(?:[ \n]|\z)|\A(?:[ \n]|\z)| (?:\n|\z)"
_NOT_TOKEN = char_class(_CAPITALS + "\n", other=True) + rf"|\n(?:\n|\z|{char_class(_CAPITALS)}{{65}})|\A(?:\n|\z|{char_class(_CAPITALS)}{{65}})"
TOKEN = r"^[A-Z0-9]{1,64}\z"


def is_token(col: Column) -> Column:
    """Upper-case ASCII letters and digits, 1 to 64 of them. NULL is not a token."""
    return F.coalesce(col.rlike(TOKEN), F.lit(False))


def is_canonical_text(col: Column) -> Column:
    """Non-empty, unpadded, printable ASCII."""
    return F.coalesce(col.rlike(r"^[\x21-\x7E](?:[\x20-\x7E]*[\x21-\x7E])?\z"), F.lit(False))


def is_semantic_identity(col: Column) -> Column:
    """1-128 characters, unpadded, no control or unassigned characters, no path separators."""
    clean = col.rlike(r"(?U)^(?!\s)[^\p{C}/\\:]{1,128}(?<!\s)\z")
    return F.coalesce(clean, F.lit(False))


def is_symbol_identity(col: Column) -> Column:
    """ASCII symbols follow the token rule; others may hold letters and digits only."""
    ascii_only = col.rlike(r"^[\x00-\x7F]*\z")
    letters = col.rlike(r"^[\p{L}\p{N}]+\z")
    return is_semantic_identity(col) & F.when(ascii_only, is_token(col)).otherwise(
        F.coalesce(letters, F.lit(False))
    )


@F.pandas_udf(T.BooleanType())
def is_composed(values: pd.Series) -> pd.Series:
    """Unicode NFC test (Spark has no built-in); only needed for non-ASCII identities."""
    return values.map(lambda v: None if v is None else unicodedata.is_normalized("NFC", v))


def identity_path(col: Column) -> Column:
    """A collision-resistant ASCII path component for an identity."""
    return F.when(is_semantic_identity(col), F.concat(F.lit("identity_"), F.sha2(col, 256)))


def _no_item(col: Column, fault: str) -> Column:
    """No item holds a fault. All items are searched as the lines of one text, and an item has no line end itself."""
    lines = F.array_join(col, "\n", "\x00")
    ends = F.length(lines) - F.length(F.replace(lines, F.lit("\n"), F.lit("")))
    return ~lines.rlike(fault) & (ends == F.size(col) - 1)


def is_tag_list(col: Column) -> Column:
    """A non-empty list whose every item is canonical text."""
    canonical = _no_item(col, _NOT_CANONICAL)
    return F.coalesce((F.size(col) > 0) & canonical, F.lit(False))


def is_distinct_token_list(col: Column) -> Column:
    """A non-empty list of distinct tokens (configured exclusion lists)."""
    tokens = _no_item(col, _NOT_TOKEN)
    distinct = F.size(F.array_distinct(col)) == F.size(col)
    return F.coalesce((F.size(col) > 0) & tokens & distinct, F.lit(False))
