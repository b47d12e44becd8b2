"""MinHash near-duplicates: many universal hash minima, banding, verification, components.

A document's set is its distinct shingles of five words (64-bit hashes). Documents with equal sets form
a class first, so exact copies cost nothing further. Each class gets minima under multiply-add hashes; a
band of some of them is a bucket key. The threshold (0.85 unless given) sets both numbers, see ``shape``:
a pair right at it shares no band with a chance of 1 in a million, more similar pairs far less often.

Links are searched without listing all pairs of a bucket:

1. Every member of a bucket is paired with the bucket's least member. Pairs are first compared by
   the low bytes of their minima, then confirmed on full sets; components follow from the links.
2. A pair inside one component needs no test. Buckets that still hold several components (many documents
   around one common passage, say) are open, and their members are joined exactly by their rarest shingles:
   two linked sets must share one of the rarest of each, at places that leave room for the rest.
3. Components are taken again over all links.

Sets are recomputed for documents in a candidate pair only. Null, empty and wordless texts have empty
sets and are linked with nothing; rows without doc_id too. Rows that share a doc_id are one document
with several texts. ``keep_one`` passes all other columns on.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import materialize
from tidepanel.llm.components import components

SHINGLE = 5
LEAST = Fraction(85, 100)
SLACK = 0.15  # over five standard errors of the signature's estimate
BATCH_CHARS = 1_000_000
MISSED = 1e-6


def shape(least: Fraction) -> tuple[int, int]:
    """Bands and rows for a threshold: 36 and 7 at 0.85, 46 and 6 at 0.8.

    A band of a pair at the threshold agrees with a chance under 0.325, and ``MISSED`` is the chance that none does.
    """
    if not 0 < least < 1:
        raise ValueError(f"the threshold must lie between 0 and 1: {least}")
    rows = ceil(log(0.325) / log(least))
    return ceil(log(MISSED) / log1p(-(float(least) ** rows))), rows


@lru_cache(maxsize=4)
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(85))
    odd = (rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    return odd, rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    ASCII white space splits words and only A-Z are lower-cased, as bytes.split and bytes.lower do.
    """
    listed = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = pa.array(list(itertools.chain.from_iterable(listed)), pa.binary()).dictionary_encode()
    known = flat.dictionary.to_pylist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[flat.indices.to_numpy(zero_copy_only=False)]
    if len(h) >= SHINGLE:
        rolled = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            rolled = _mix(rolled ^ h[k : k + len(rolled)])
    out, at = [], 0
    for ws in listed:
        n = len(ws)
        if n >= SHINGLE:
            out.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            short = np.uint64(n)
            for x in h[at : at + n]:
                short = _mix(np.array([short ^ x]))[0]
            out.append(np.array([short]))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """Least value of each of ``n`` hashes over a set."""
    a, b = _hashes(n)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (a[:, None] * x[None, at : at + 1024] + b[:, None]).min(axis=1), out=least)
    return least


def _by_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.array([len(t or "") for t in batch["text"].to_pylist()])
        cells = np.cumsum(sizes) // BATCH_CHARS
        for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(batch)]):
            if b > a:
                yield batch.slice(a, b - a)


def signatures(docs: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """doc_id, n_shingles, digest of the set (two longs), band keys and low bytes of the minima."""
    n_bands, n_rows = shape(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_chars(batches):
            sets = shingle_sets(batch["text"].to_pylist())
            digests = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2)
            lows = np.stack([minima(s, n_bands * n_rows) for s in sets])
            keys = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), (len(sets), n_bands)).copy()
            for r in range(n_rows):
                keys = _mix(keys ^ lows[:, r::n_rows].astype(np.uint64) + np.uint64(r + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].view(np.int64)),
                    pa.array(digests[:, 1].view(np.int64)), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    pa.array([row.tobytes() for row in (lows & 0xFF).astype(np.uint8)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "low"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, low binary"
    )


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_chars(batches):
            sets = shingle_sets(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "s"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, s array<bigint>")


def _resembling(pairs: DataFrame, low: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (u, v) whose signatures agree well enough; agreement by chance is one byte in 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("low_u", "low_v")
            ]
            same = (sides[0] == sides[1]).mean(axis=1)
            likely = (same - 1 / 256) / (1 - 1 / 256) >= float(least) - SLACK
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(likely))

    joined = pairs.join(low.select(F.col("doc_id").alias("u"), F.col("low").alias("low_u")), "u").join(
        low.select(F.col("doc_id").alias("v"), F.col("low").alias("low_v")), "v"
    )
    return joined.select("u", "v", "low_u", "low_v").mapInArrow(run, "u bigint, v bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """Pairs (u, v) whose full sets are at least ``least`` alike, in whole numbers."""
    joined = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("s").alias("su")), "u").join(
        sets.select(F.col("doc_id").alias("v"), F.col("s").alias("sv")), "v"
    )
    shared = F.size(F.array_intersect("su", "sv")).cast("bigint")
    return joined.select("u", "v", shared.alias("i"), (F.size("su") + F.size("sv")).alias("n")).where(
        least.denominator * F.col("i") >= least.numerator * (F.col("n") - F.col("i"))
    ).select("u", "v")


def _rare_shingle_pairs(members: DataFrame, sets: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """Pairs (u, v) across components among ``members`` whose rarest shingles allow a link.

    Sets of x <= y shingles linked at t share o = ceil(t / (1 + t) * (x + y)) or more, and x >= t y. Put
    every set in the common order of rarity. The first shared shingle is then among the first x - o' + 1
    of the smaller set (o' for y = x, the least o can be) and the first y - ceil(t y) + 1 of the larger,
    and from its places i and j on, both must still hold o shingles.
    """
    own = sets.join(members, "doc_id").select("doc_id", "c", F.size("s").alias("n"), F.explode("s").alias("x"))
    often = own.groupBy("x").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # Shingles of one member only link nothing; they come first in the order and take up places.
    ranked = own.join(often, "x", "left").groupBy("doc_id", "c", "n").agg(
        F.count_if(F.col("f").isNull()).alias("single"),
        F.sort_array(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "x")))).alias("xs"),
    )
    p, q = least.numerator, least.denominator
    most = F.col("n") - F.ceil(F.col("n") * p / q) + 1
    rarest = materialize(
        ranked.select(
            "doc_id", "c", "n", "single",
            F.posexplode(F.slice("xs", 1, F.greatest((most - F.col("single")).cast("int"), F.lit(0)))).alias("at", "r"),
        ).select("doc_id", "c", F.col("n").cast("bigint").alias("n"), (F.col("single") + F.col("at") + 1).alias("i"), F.col("r.x").alias("x")),
        "rarest",
    )
    small = rarest.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * (2 * p) / (p + q)) + 1)
    a = small.select("x", F.col("doc_id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"))
    b = rarest.select("x", F.col("doc_id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    rest = f"1 + least(na - ia, nb - ib) >= ceil((na + nb) * {p} / {p + q})"
    ordered = "(na < nb OR (na = nb AND a < b))"
    found = a.join(b, "x").where(f"ca != cb AND {ordered} AND {q} * na >= {p} * nb AND {rest}")
    return found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def links(docs: DataFrame, classes: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """Edges (u, v) whose components are those of all links between class representatives.

    ``classes``: doc_id, n_shingles, bands, low of one document for each distinct set, signed for ``least``.
    """
    buckets = classes.select("doc_id", F.explode("bands").alias("key"))
    heads = materialize(
        buckets.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head != last").drop("last"), "buckets"
    )
    members = materialize(buckets.join(heads, "key"), "members")
    low = classes.select("doc_id", "low")
    stars = members.where("head != doc_id").select(F.col("head").alias("u"), F.col("doc_id").alias("v")).distinct()
    stars = materialize(_resembling(stars, low, least), "stars")

    def sets_of(ids: DataFrame) -> DataFrame:
        return materialize(full_sets(docs.select("doc_id", "text").join(ids.distinct(), "doc_id", "left_semi")), "sets")

    sets = sets_of(stars.select(F.explode(F.array("u", "v")).alias("doc_id")))
    first = materialize(confirmed(stars, sets, least), "links")
    found = components(first)
    labelled = members.join(found, members["doc_id"] == found["node"], "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("c")
    )
    several = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    open_ = materialize(labelled.join(several, "key", "left_semi").select("doc_id", "c").distinct(), "open")
    more_sets = sets_of(open_.select("doc_id"))
    untried = _rare_shingle_pairs(open_, more_sets, least).join(stars, ["u", "v"], "left_anti")
    rare = materialize(_resembling(untried, low, least), "rare")
    second = confirmed(rare, more_sets, least)
    return materialize(first.unionByName(second), "links")


def near_duplicates(docs: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``; sets at least ``least`` alike are linked."""
    signed = materialize(signatures(docs, least), "signatures")
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    firsts = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"))
    classes = materialize(
        usable.join(firsts, ["d1", "d2"]).where("doc_id = class_id").dropDuplicates(["d1", "d2"])
        .select("doc_id", "n_shingles", "bands", "low", "d1", "d2"), "classes",
    )
    found = components(links(docs, classes, least))
    labelled = classes.join(found, classes["doc_id"] == found["node"], "left").select(
        "d1", "d2", F.coalesce("component", "doc_id").alias("component_id")
    )
    by_row = signed.select("doc_id", "n_shingles", "d1", "d2").join(labelled, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return by_row.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller doc_id.

    Rows without doc_id stay. A document listed twice stays as often as its id is kept.
    """
    dropped = near_duplicates(docs, least).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
