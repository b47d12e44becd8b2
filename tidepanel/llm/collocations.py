"""Phrase collocations: frequent word sequences from mergeable Misra-Gries summaries, then counted exactly.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and those at blanks and tabs into
words. Everything is counted per language (null: ``und``).

1. A task hashes the 1- to 5-word sequences of its texts, adds up equal hashes of some millions at a time and
   sends them, sorted and compressed, to partitions of the hash range.
2. A hash partition of mass m merges what it gets into a Misra-Gries summary of m / threshold + 1 counters:
   counts of equal hashes are added and, where there are too many, the largest count that has no room is taken from
   all. All that is ever taken from one counter is d < threshold, so every frequent sequence is left with
   threshold - d or more. Those hashes set bits in a filter of fixed size, the only thing the driver gets.
3. The second pass reads the texts again, keeps the sequences whose bit is set and counts them exactly, by their
   words. A bit set by accident costs a count and nothing else.

Scores and the choice of phrases are joins and aggregates over the frequent sequences only. Memory per task: a
few million hashes, or 1/threshold of a partition's mass; the largest single text at some twenty times its size.
Null texts are empty; rows count each for itself, whatever their doc_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepanel.llm.common import many_to_one, materialize
from tidepanel.llm.suffix_dedup import Strings

LONGEST = 5
THRESHOLD = 100
CHUNK_BYTES = 2 << 20
FLUSH_ENTRIES = 4_000_000
FLUSH_PHRASES = 250_000
PARTITION_BYTES = 8 << 20
HASH_BITS, FILTER_BITS = 48, 26
NO_LANGUAGE = "und"

# What ends a piece and what ends a word.
_PIECE_ENDS, _WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_WORD_ENDS)] = 1
_KIND[list(_PIECE_ENDS)] = 2
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Block:
    """Words of some texts: bounds, piece, language and hash of each."""

    def __init__(self, texts: list[bytes], languages: list[int]):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        self.data = _LOWER[raw]
        kind = np.empty(len(raw) + 2, np.uint8)
        kind[0] = kind[-1] = 2
        kind[1:-1] = _KIND[self.data]
        word = kind == 0
        self.start = np.flatnonzero(word[1:] & ~word[:-1])
        self.end = np.flatnonzero(word[:-1] & ~word[1:])
        self.piece = np.cumsum(kind[1:-1] == 2, dtype=np.int32)[self.start] if len(raw) else np.empty(0, np.int32)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        self.language = np.array(languages, np.int32)[np.searchsorted(begins, self.start, side="right") - 1]
        self.hash = Strings(self.data).hash(self.start, self.end) if len(raw) else np.empty(0, np.uint64)

    def sequences(self, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, index of the first word, hash) of all sequences within pieces."""
        so_far = _mix(self.hash ^ seeds[self.language])
        at = np.arange(len(so_far))
        for n in range(1, LONGEST + 1):
            if n > 1:
                stays = np.flatnonzero(at + n <= len(self.start))
                at, so_far = at[stays], so_far[stays]
                stays = np.flatnonzero(self.piece[at] == self.piece[at + n - 1])
                at = at[stays]
                so_far = _mix(so_far[stays] * _M2 + self.hash[at + n - 1])
            yield n, at, so_far

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[at] : self.end[at + n - 1]].tobytes().split())


class Languages(dict):
    """Numbers of the languages met by a task, and what each adds to a hash."""

    def __init__(self):
        super().__init__()
        self.seeds = np.empty(0, np.uint64)

    def __missing__(self, name: str) -> int:
        number = self[name] = len(self)
        own = Strings(np.frombuffer(name.encode("utf-8", "surrogatepass") + b"\0", np.uint8)).hash(np.array([0]), np.array([len(name.encode("utf-8", "surrogatepass")) + 1]))
        self.seeds = np.append(self.seeds, own)
        return number


def _blocks(batches: Iterator[pa.RecordBatch], languages: Languages) -> Iterator[Block]:
    texts, numbers, held = [], [], 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
            numbers.append(languages[lang.as_py()])
            held += len(texts[-1])
            if held >= CHUNK_BYTES:
                yield Block(texts, numbers)
                texts, numbers, held = [], [], 0
    if texts:
        yield Block(texts, numbers)


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(4, "little") + zstandard.compress(_planes(steps) + _planes(counts.astype(np.uint32)), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, raw = int.from_bytes(blob[:4], "little"), zstandard.decompress(blob[4:])
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).reshape(-1)
    counts = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8 * n).reshape(4, n).T).view(np.uint32).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _summaries(parts: int):
    """First pass: exact counts of some millions of sequences, by partition of the hash range."""
    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
        part = (keys * np.uint64(parts)) >> np.uint64(HASH_BITS)
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(keys)).tolist()
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([int(counts[a:b].sum()) for a, b in spans], pa.int64()),
                pa.array([_pack(keys[a:b], counts[a:b]) for a, b in spans], pa.binary()),
            ],
            names=["part", "mass", "blob"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, held, size = Languages(), [], 0
        for block in _blocks(batches, languages):
            for _, _, hashes in block.sequences(languages.seeds):
                held.append(hashes >> np.uint64(64 - HASH_BITS))
                size += len(hashes)
            if size >= FLUSH_ENTRIES:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    return run


class MisraGries:
    """Mergeable summary: at most ``capacity`` counters; ``taken`` bounds what any count may lack."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys, counts = _add_up(np.concatenate([self.keys, *(p[0] for p in parts)]), np.concatenate([self.counts, *(p[1] for p in parts)]))
        if (over := len(keys) - self.capacity) > 0:
            cut = int(np.partition(counts, over - 1)[over - 1])
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
            self.taken += cut
        self.keys, self.counts = keys, counts

    def at_least(self, threshold: int) -> np.ndarray:
        """Keys whose true count may reach the threshold; all that do are among them."""
        return self.keys[self.counts + self.taken >= threshold]


def _survivors(threshold: int):
    """Partitions of the hash range, one after the other: the bytes of the filter that each sets."""
    def bits(summary: MisraGries) -> tuple[int, bytes]:
        spots = (summary.at_least(threshold) >> np.uint64(HASH_BITS - FILTER_BITS)).astype(np.int64)
        if not len(spots):
            return 0, b""
        low = int(spots[0]) >> 3
        out = np.zeros((int(spots[-1]) >> 3) - low + 1, np.uint8)
        np.bitwise_or.at(out, (spots >> 3) - low, (1 << (spots & 7)).astype(np.uint8))
        return low, zstandard.compress(out.tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary, waiting, size = None, None, [], 0
        for batch in batches:
            done = []
            for p, total, blob in zip(batch["part"].to_pylist(), batch["total"].to_pylist(), batch["blob"], strict=True):
                if p != part:
                    if summary is not None:
                        summary.merge(waiting)
                        done.append(bits(summary))
                    part, summary, waiting, size = p, MisraGries(total // threshold + 1), [], 0
                waiting.append(_unpack(blob.as_py()))
                size += len(waiting[-1][0])
                if size > 4 * summary.capacity:
                    summary.merge(waiting)
                    waiting, size = [], 0
            yield _segments(done)
        if summary is not None:
            summary.merge(waiting)
            yield _segments([bits(summary)])

    return run


def _segments(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["at", "bits"]
    )


def frequent_filter(texts: DataFrame, threshold: int, parts: int) -> np.ndarray:
    """Bits of all sequences that may occur ``threshold`` times; 2**FILTER_BITS bits, whatever the input."""
    sent = texts.mapInArrow(_summaries(parts), "part int, mass bigint, blob binary")
    weighed = sent.select("part", "blob", F.sum("mass").over(Window.partitionBy("part")).alias("total"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in weighed.mapInArrow(_survivors(threshold), "at bigint, bits binary").toLocalIterator():
        if row["bits"]:
            found = np.frombuffer(zstandard.decompress(row["bits"]), np.uint8)
            bits[row["at"] : row["at"] + len(found)] |= found
    return bits


_COUNTS = "part int, lang array<string>, phrase array<string>, words array<int>, f array<bigint>"
_COUNTED = "lang string, phrase string, words int, f bigint"


def _count(shared, parts: int):
    """Second pass: exact counts of the sequences whose bit is set, by partition of the hash range.

    A sequence without words and phrase counts all words of its language.
    """
    def send(counts: dict[tuple[int, int, int, bytes], int], names: list[str]) -> pa.RecordBatch:
        keys = sorted(counts)
        heads = [i for i, k in enumerate(keys) if not i or k[0] != keys[i - 1][0]]
        ends = pa.array([*heads, len(keys)], pa.int32())
        columns = [
            pa.array([names[k[1]] for k in keys], pa.string()), pa.array([k[3].decode("utf-8", "surrogatepass") if k[2] else None for k in keys], pa.string()),
            pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[i][0] for i in heads], pa.int32()), *(pa.ListArray.from_arrays(ends, c) for c in columns)],
            names=["part", "lang", "phrase", "words", "f"],
        )

    def place(hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, languages, counts = shared.value, Languages(), {}
        for block in _blocks(batches, languages):
            for number, n in zip(*np.unique(block.language, return_counts=True), strict=True):
                key = (int(place(languages.seeds[number : number + 1])[0]), int(number), 0, b"")
                counts[key] = counts.get(key, 0) + int(n)
            for n, at, hashes in block.sequences(languages.seeds):
                spot = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                keep = np.flatnonzero((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
                found, first, times = np.unique(hashes[keep], return_index=True, return_counts=True)
                for part, i, f in zip(place(found).tolist(), at[keep[first]].tolist(), times.tolist(), strict=True):
                    key = (part, int(block.language[i]), n, block.phrase(i, n))
                    counts[key] = counts.get(key, 0) + f
            if len(counts) >= FLUSH_PHRASES:
                yield send(counts, list(languages))
                counts = {}
        if counts:
            yield send(counts, list(languages))

    return run


def _add_counts(threshold: int):
    """Partitions of the hash range, one after the other: sequences with their whole counts."""
    def done(counts: dict[tuple, int]) -> pa.RecordBatch:
        kept = [(*k, f) for k, f in counts.items() if k[1] is None or f >= threshold]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], k) for i, k in enumerate(kinds)], names=["lang", "phrase", "words", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, {}
        for batch in batches:
            for row in range(len(batch)):
                if (p := batch["part"][row].as_py()) != part:
                    if counts:
                        yield done(counts)
                    part, counts = p, {}
                columns = (batch[c][row].as_py() for c in ("lang", "phrase", "words", "f"))
                for lang, phrase, words, f in zip(*columns, strict=True):
                    counts[lang, phrase, words] = counts.get((lang, phrase, words), 0) + f
        if counts:
            yield done(counts)

    return run


def frequent_sequences(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all sequences of 1 to 5 words with f >= threshold, and (lang, n) of all words."""
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(1 << (64 - HASH_BITS - 1), max(1, -(-int(size) // PARTITION_BYTES)))
    shared = spark.sparkContext.broadcast(frequent_filter(texts, threshold, parts))
    sent = texts.mapInArrow(_count(shared, parts), _COUNTS)
    whole = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_add_counts(threshold), _COUNTED)
    stored = materialize(whole, "sequences")
    return stored.where("phrase is not null"), stored.where("phrase is null").select("lang", F.col("f").alias("n"))


def _slices(least: int, whole: bool = False):
    """Contiguous parts of ``least`` words or more, shorter than the phrase."""
    words = F.split("phrase", " ")
    spans = [(i, n) for n in range(least, LONGEST) for i in range(1, LONGEST - n + 2)]
    return F.array_compact(F.array(*(
        F.when((F.col("words") > n) & (F.lit(i + n - 1) <= F.col("words")), F.array_join(F.slice(words, i, n), " ")) for i, n in spans
    )))


def collocations(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, most: int = 2000, covered: int = 100) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of the two sides of its weakest cut, score floor(1000 a n / (l r)). A phrase
    goes if a longer one that contains it has ``covered`` percent of its count or more.
    """
    frequent, totals = frequent_sequences(spark, docs, threshold)
    candidates = frequent.where("words > 1").withColumnRenamed("f", "a")
    within = candidates.where("words > 2").select("lang", F.explode(_slices(2)).alias("phrase"), F.col("a").alias("longer"))
    free = (
        candidates.select("lang", "phrase", "words", "a", F.lit(None).cast("bigint").alias("longer"))
        .unionByName(within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), allowMissingColumns=True)
        .groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.max("a").alias("a"), F.max("longer").alias("longer"))
        .where(f"longer is null or 100 * longer < {covered} * a")
    )
    words = F.split("phrase", " ")
    sides = F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(True).alias("left"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("part")),
            F.struct(k.alias("k"), F.lit(False).alias("left"), F.array_join(F.slice(words, k + 1, F.col("words")), " ").alias("part")),
        ),
    ))
    cuts = materialize(free.select("lang", F.col("phrase").alias("whole"), "a", F.explode(sides).alias("s")).select("lang", "whole", "a", "s.*"), "cuts")
    counted = many_to_one(cuts.withColumnRenamed("part", "phrase"), frequent.select("lang", "phrase", "f"), ["lang", "phrase"])
    side = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    sized = counted.groupBy("lang", "whole").agg(
        F.max("a").alias("a"), *(side(k, left).alias(f"{name}{k}") for k in range(1, LONGEST) for name, left in (("l", True), ("r", False)))
    )
    weighed = many_to_one(materialize(sized, "weighed"), totals, ["lang"])
    exact = "decimal(15,0)"  # counts below 10**15, so products stay below 38 digits
    scores = F.array_compact(F.array(*(
        F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(
                F.expr(f"(cast(a as {exact}) * cast(n as {exact}) * cast(1000 as decimal(4,0))) div (cast(l{k} as {exact}) * cast(r{k} as {exact}))").alias("score"),
                F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
            ),
        )
        for k in range(1, LONGEST)
    )))
    scored = weighed.select("lang", F.col("whole").alias("phrase"), "a", "n", F.array_min(scores).alias("c"))
    best = [F.col("c.score").desc(), F.col("a").desc(), F.col("phrase")]
    # Each of many hash groups gives at most ``most`` rows, so no task sorts a whole language.
    few = scored.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*best))
    ).where(F.col("place") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
