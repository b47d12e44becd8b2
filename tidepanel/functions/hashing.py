"""Content hashes of rows and of canonical JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def row_hash(columns: Sequence[Column | str]) -> Column:
    """64-bit hash of a row; NULL positions are marked so that (NULL, x) differs from (x, NULL)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    marked = [part for c in cols for part in (c.isNull(), c)]
    return F.xxhash64(*marked)


def canonical_json_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the compact JSON of the named columns in key order."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)
