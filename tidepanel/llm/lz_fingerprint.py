"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each phrase is the shortest prefix of what is left that
was not a phrase before), the phrases are hashed, and the smallest hashes are the fingerprint.
Texts that compress well together share phrases, so the likeness of two fingerprints (the Jaccard
estimate of their phrase sets) stands in for compression distance. Up to ``MINIMA`` phrases the
estimate is exact.

Null and empty texts have no phrases: their fingerprint is the empty string, which is like another
empty one (1.0) and unlike all others (0.0). Equal texts have equal fingerprints. Memory per task is
one text with its phrases; texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

MINIMA = 128
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the longest text so far."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(14, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _parse(text: str, seen: set[str], at: int, size: int, stop: int, ends: list[int]) -> tuple[int, int]:
    """Go on with the phrases from ``at`` while they end by ``stop``; the place and length to go on from.

    The dictionary holds every prefix of its phrases, so the length of the next phrase is found by
    stepping from the length of the last one.
    """
    n = len(text)
    while at < stop:
        if text[at : at + size] in seen:
            size += 1
            while text[at : at + size] in seen and at + size <= n:
                size += 1
        else:
            while size > 1 and text[at : at + size - 1] not in seen:
                size -= 1
        if at + size > stop:
            break
        seen.add(text[at : at + size])
        at += size
        ends.append(at)
    return at, size


def phrase_ends(text: str) -> list[int]:
    """End offsets of the phrases; a tail that is already a phrase adds none."""
    ends: list[int] = []
    _parse(text, set(), 0, 1, len(text), ends)
    return ends


def ends_of_both(text: str, edited: str, common: int) -> tuple[list[int], list[int]]:
    """Phrase ends of two texts that agree up to ``common``; what they share is parsed once."""
    seen: set[str] = set()
    ends: list[int] = []
    at, size = _parse(text, seen, 0, 1, common, ends)
    own = ends.copy()
    _parse(text, seen, at, size, len(text), own)
    starts = [at, *own[len(ends) :]]
    seen.difference_update([text[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
    _parse(edited, seen, at, size, len(edited), ends)
    return own, ends


def minima(text: str | None, k: int = MINIMA) -> np.ndarray:
    """The k smallest distinct 32-bit phrase hashes, ascending."""
    return minima_of(text, phrase_ends(text), k) if text else np.empty(0, np.uint32)


def minima_of(text: str, phrases: list[int], k: int = MINIMA) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.array(phrases, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    up, down = _tables(len(points) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * up[: len(points)], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:k]


def pack(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def unpack(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), "<u4")


def likeness_of(a: np.ndarray, b: np.ndarray, k: int = MINIMA) -> float:
    """Share of the k smallest hashes of both texts together that belong to both."""
    both = np.concatenate((a, b))
    both.sort()
    twice = both[:-1][both[1:] == both[:-1]]
    least = np.unique(both)[:k]
    return float(np.count_nonzero(twice <= least[-1]) / len(least)) if len(least) else 1.0


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(minima(t)) for t in texts], dtype="object")

    return F.pandas_udf(run, StringType())(text)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns, 0 to 1."""
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness_of(unpack(p), unpack(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, DoubleType())(a, b)


SUCCESSOR_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def in_id_order(docs: DataFrame, block_rows: int = 4096, most_blocks: int = 10_000) -> DataFrame:
    """Rows (block, peek, doc_id, text) sorted by id inside one partition per block of ids.

    The row that follows a block is repeated at its end (``peek``), and the very first one at the end
    of the last block, so every row meets its successor inside one partition; texts are shuffled
    once. Only the ids at the cuts, at most ``most_blocks``, reach the driver. Rows without an id come
    first; rows of one id are ordered by text.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))
    n = ids.count()
    blocks = max(1, min(most_blocks, -(-n // block_rows)))
    cuts: list[int] = []
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        cuts = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * blocks))).first()[0]
    first = ids.agg(F.min("doc_id")).first()[0]
    cuts = sorted(set(cuts or []) - {first})
    edges = np.array(cuts, np.int64)

    def places(ids: pd.Series) -> pd.Series:
        """The block of an id and, if it opens a block, minus one minus the block before."""
        block = np.searchsorted(edges, ids.to_numpy(), side="right")
        opens = (block > 0) & (edges[np.maximum(block - 1, 0)] == ids.to_numpy()) if len(edges) else np.zeros(len(ids), bool)
        wraps = ids.to_numpy() == first
        return pd.Series([
            [b, *([-b] if o else []), *([-1 - len(edges)] if w else [])]
            for b, o, w in zip(block.tolist(), opens.tolist(), wraps.tolist(), strict=True)
        ])

    placed = docs.select(
        F.explode(F.pandas_udf(places, ArrayType(IntegerType()))(F.coalesce("doc_id", F.lit(-(1 << 63))))).alias("_place"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    ).select(
        F.when(F.col("_place") < 0, -1 - F.col("_place")).otherwise(F.col("_place")).alias("block"),
        (F.col("_place") < 0).alias("peek"), "doc_id", "text",
    )
    return placed.repartitionById(len(cuts) + 1, F.col("block")).sortWithinPartitions("block", "peek", "doc_id", "text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last floor(n/2) code points replaced by as many (or all) of the first
    ones of the next document by ascending id; after the last comes the first. A single document
    follows itself. Streams one sorted partition at a time; holds two texts.
    """
    def pairs(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, done = None, False
        for row in rows:
            if last is not None and not done:
                yield last, row
            done = done or row[0]
            last = row

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(batch["peek"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)

        out: list[tuple] = []
        held, after = None, None
        for (_, doc_id, text), (_, _, after) in pairs(rows()):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            phrases, changed = ends_of_both(text, edited, len(text) - half)
            own, changed = minima_of(text, phrases), minima_of(edited, changed)
            if held is not None:
                out.append((*held[:-1], likeness_of(held[-1], own)))
            held = (
                doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(own),
                pack(changed), likeness_of(own, changed), own,
            )
            if len(out) == 2000:
                yield _batch(out)
                out = []
        if held is not None:
            out.append((*held[:-1], likeness_of(held[-1], minima(after))))
            yield _batch(out)

    return in_id_order(docs).select("peek", "doc_id", "text").mapInArrow(walk, SUCCESSOR_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [part.split()[0] for part in SUCCESSOR_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
    )


def like_documents(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """General form: any table with its fingerprint column added."""
    return df.withColumn(name, fingerprint(F.col(text)))


def near(a: Column, b: Column, least: float = 0.8) -> Column:
    return likeness(a, b) >= least
