"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters, of digits or of other signs. Their 1- and 2-grams, and the 1- to 3-grams of
their classes (case, digit, the sign itself, or a repeat of one of the words just before), are hashed
into ``2**BITS`` weights. A text is the mean of its n-grams' weights of each kind, that is a sparse
dot product with n-gram frequencies; n-grams never cross texts and every whole text is scored.

Training takes at most ``TRAIN_ROWS`` labelled documents (those with the least hash of their id), split
over ``SHARDS`` tasks; each runs FTRL over its rows for ``EPOCHS`` passes and the weights are averaged.
Only weights, at most ``2**BITS`` numbers, reach the driver. Empty and null texts score by the bias.
Without any labelled row nothing speaks against a text: every score is 1.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

BITS = 18
TRAIN_ROWS = 8192
SHARDS = 8
EPOCHS = 3
BATCH_WORDS = 500_000
THRESHOLD = 0.7
LAGS = (1, 2, 3, 4, 6)
WORDS = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
KINDS = 5  # n-gram kinds: two of words, three of classes


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def _class(word: str) -> str:
    if word[0].isalpha():
        return "U" if word.isupper() and len(word) > 1 else "u" if word.isupper() else "l" if word.islower() else "t" if word[1:].islower() else "m"
    return "0" if word[0].isnumeric() else word[:4]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x1851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: its slots and the row of each, over a column of word lists."""
    flat = lists.flatten().dictionary_encode()
    known = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy()
    surface = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))[codes]
    classes = np.fromiter((xxhash.xxh3_64_intdigest(_class(w)) for w in known), np.uint64, len(known))[codes]
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    repeats = np.zeros(len(codes), bool)
    for lag in LAGS:
        repeats[lag:] |= (codes[lag:] == codes[:-lag]) & (row[lag:] == row[:-lag]) & (classes[lag:] != _COMMA) & (classes[lag:] != _STOP)
    classes = np.where(repeats, np.uint64(0x3D), classes)
    same1, same2 = row[1:] == row[:-1], row[2:] == row[:-2]
    pairs = _mix(classes[:-1], classes[1:])
    return [
        (_slots(surface, 1), row),
        (_slots(_mix(surface[:-1], surface[1:])[same1], 2), row[1:][same1]),
        (_slots(classes, 3), row),
        (_slots(pairs[same1], 4), row[1:][same1]),
        (_slots(_mix(pairs[:-1], classes[2:])[same2], 5), row[2:][same2]),
    ]


_COMMA, _STOP = (np.uint64(xxhash.xxh3_64_intdigest(c)) for c in ",.")


def margins(lists: pa.ListArray, weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(lists), bias)
    for slots, row in features(lists):
        n = np.bincount(row, minlength=len(lists))
        total += np.bincount(row, weights[slots], len(lists)) / np.maximum(n, 1)
    return total


class Ftrl:
    """Follow-the-regularised-leader with one learning rate per weight."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 0.01, l1: float = 1e-4, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: the last slot is the bias."""
    model, rows = Ftrl((1 << BITS) + 1), []
    for batch in batches:
        lists = batch["words"]
        split = [(slots, np.searchsorted(row, np.arange(len(lists) + 1))) for slots, row in features(lists)]
        for i, label in enumerate(batch["quality"].to_pylist()):
            own, x = [np.array([1 << BITS])], [np.ones(1)]
            for slots, bounds in split:
                part, counts = np.unique(slots[bounds[i] : bounds[i + 1]], return_counts=True)
                own.append(part)
                x.append(counts / max(1, counts.sum()))
            at, where = np.unique(np.concatenate(own), return_inverse=True)
            rows.append((at, np.bincount(where, np.concatenate(x)), label))
    for _ in range(EPOCHS):
        for at, x, label in rows:
            model.learn(at, x, label)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["slot", "w"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, shards: int = SHARDS, seed: int = 7) -> np.ndarray | None:
    """Averaged weights with the bias last; None without labelled rows.

    Learns only from labelled documents outside the held-out quarter. An id labelled both ways counts
    as 0. ``rows`` bounds the sample.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    sample = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(order, "doc_id").limit(rows)
    )
    learned = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` narrow rows
        .select(F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("o"), "doc_id", "quality", words(F.col("text")).alias("words"))
        .repartitionById(shards, F.col("shard")).sortWithinPartitions("o", "doc_id", F.xxhash64("words"))
        .select("quality", "words").mapInArrow(_train, "slot bigint, w double")
        .groupBy("slot").agg((F.sum("w") / shards).alias("w"))
    )
    weights = np.zeros((1 << BITS) + 1)
    found = learned.toPandas()  # at most 2**BITS + 1 rows
    if found.empty:
        return None
    weights[found["slot"].to_numpy()] = np.round(found["w"].to_numpy(), 9)
    return weights


def score(docs: DataFrame, weights: np.ndarray | None, name: str = "score") -> DataFrame:
    """Add the score (0 to 1, higher: label 1 likelier); all other columns stay."""
    if weights is None:
        return docs.withColumn(name, F.lit(1.0))
    table, bias = weights[:-1], float(weights[-1])

    def run(lists: pa.Array) -> pa.Array:
        parts = [margins(part, table, bias) for part in _parts(lists)]
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(parts or [np.empty(0)]), -35, 35))))

    return docs.withColumn(name, F.arrow_udf(run, DoubleType())(words(F.col("text"))))


def _parts(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Cut a column where its words pass ``BATCH_WORDS``, so that memory follows one text at most."""
    cells = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy()) // BATCH_WORDS
    for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(lists)]):
        yield lists.slice(a, b - a)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` plus held_out, score and predicted (1 from ``threshold`` on)."""
    scored = score(docs.drop("held_out", "score", "predicted"), train(docs, labels))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
