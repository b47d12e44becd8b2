"""Byte-level BPE with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a token takes one
probe. Tier two merges the bytes of any other pre-token through a heap of candidate pairs over a
doubly linked list, lowest rank first and leftmost among equals, in O(n log n).

Each task keeps a bounded memo of pre-tokens it has met. Texts are encoded whole; null and empty texts
have no ids. Decoding the ids gives back the bytes of the text. The vocabulary (a rank file) is
read on the driver from a path that is a parameter and travels with the task, so executors need no
copy of the file.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

MEMO_ENTRIES = 1_000_000
BATCH_PIECES = 1_000_000
_MASK = (1 << 64) - 1


def _spread(h: int, seed: int) -> int:
    h = (h ^ (seed * 0x9E3779B97F4A7C15)) & _MASK
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return h ^ (h >> 32)


@dataclass
class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one displacement for each bucket."""

    shifts: list[int]
    keys: list[bytes]
    values: list[int]

    @classmethod
    def build(cls, items: dict[bytes, int]) -> PerfectHash:
        n, width = len(items), max(1, len(items) // 2)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(width)]
        for key in items:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % width].append((h, key))
        shifts, slots = [0] * width, [b""] * n
        free = bytearray(b"\x01") * n
        order = sorted(range(width), key=lambda b: -len(buckets[b]))
        for b in order:
            members = buckets[b]
            if len(members) < 2:
                break
            seed = 1
            while True:
                places = [_spread(h, seed) % n for h, _ in members]
                if len(set(places)) == len(places) and all(free[p] for p in places):
                    break
                seed += 1
            shifts[b] = seed
            for place, (_, key) in zip(places, members, strict=True):
                free[place], slots[place] = 0, key
        # Buckets of one key take the slots that are left; a negative shift names the slot.
        spare = iter([p for p in range(n) if free[p]])
        for b in order:
            if len(buckets[b]) == 1:
                place = next(spare)
                shifts[b], slots[place] = -place - 1, buckets[b][0][1]
        return cls(shifts, slots, [items[k] for k in slots])

    def get(self, key: bytes) -> int | None:
        if not self.keys:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shifts[h % len(self.shifts)]
        place = -shift - 1 if shift < 0 else _spread(h, shift) % len(self.keys)
        return self.values[place] if self.keys[place] == key else None


@dataclass
class Tokenizer:
    """Encoder and decoder for one rank table and split pattern."""

    ranks: dict[bytes, int]
    pattern: str
    whole: PerfectHash = field(init=False)

    def __post_init__(self) -> None:
        self.whole = PerfectHash.build(self.ranks)
        self._ready()

    @classmethod
    def from_rank_file(cls, path: str, pattern: str) -> Tokenizer:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def _ready(self) -> None:
        self._find = regex.compile(self.pattern).findall
        self._memo: dict[bytes, bytes] = {}
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        ends = np.cumsum([0, *map(len, tokens)])
        self._table = np.frombuffer(b"".join(tokens), np.uint8), ends

    def __getstate__(self) -> tuple:
        return self.ranks, self.pattern, self.whole

    def __setstate__(self, state: tuple) -> None:
        self.ranks, self.pattern, self.whole = state
        self._ready()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece by heap merges over linked bytes."""
        n, rank_of, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        # after[i] is where the part that starts at i ends; 0 marks a part that is no longer a start.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # One integer for (rank, start, size of the pair) keeps the heap's order and is cheap.
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [
            ((rank << bits | i) << bits) | 2
            for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i = (entry >> bits) & mask
            j = after[i]
            # Stale unless the pair at this start still has the size it was offered with.
            if not 0 < j < n or after[j] - i != entry & mask:
                continue
            end = after[j]
            after[i], after[j] = end, 0
            if end < n:
                before[end] = i
                if (rank := rank_of(piece[i : after[end]])) is not None:
                    push(heap, ((rank << bits | i) << bits) | (after[end] - i))
            if (h := before[i]) >= 0 and (rank := rank_of(piece[h:end])) is not None:
                push(heap, ((rank << bits | h) << bits) | (end - h))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def piece(self, raw: bytes) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        found = self.whole.get(raw)
        ids = (found,) if found is not None else self.merge(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, raws: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens through the memo; long ones are rare and not kept."""
        memo = self._memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        out = []
        for raw in raws:
            ids = memo.get(raw)
            if ids is None:
                ids = self.piece(raw)
                if len(raw) <= 64:
                    memo[raw] = ids
            out.append(ids)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; for columns, see ``encode_batch``."""
        return b"".join(self.pieces([p.encode("utf-8", "surrogatepass") for p in self._find(text or "")]))

    def decode(self, ids: bytes) -> bytes:
        return _gather(*self._table, np.frombuffer(ids, "<u4"))[0].tobytes()

    def encode_batch(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of pre-token lists and the bounds of each row in them."""
        flat = pieces.flatten().cast(pa.binary()).dictionary_encode()
        known = self.pieces(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        ids, bounds = _gather(np.frombuffer(b"".join(known), "<u4"), starts, flat.indices.to_numpy())
        return ids, bounds[_row_bounds(pieces)]

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a column of ids and the bounds of each row in them."""
        data, places = _gather(*self._table, ids)
        return data, places[bounds]


def _gather(values: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate values[starts[p]:starts[p + 1]] for all picks; also where each begins, and the end."""
    sizes = (starts[1:] - starts[:-1])[picks]
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    index = np.repeat(starts[:-1][picks] - bounds[:-1], sizes) + np.arange(bounds[-1])
    return values[index], bounds


def _row_bounds(lists: pa.ListArray) -> np.ndarray:
    """Bounds of each row in lists.flatten(); null rows are empty."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64))))


def _pre_tokens(docs: DataFrame, tokenizer: Tokenizer, text: str) -> Column:
    """Matches of the split pattern; (?U) gives its classes their Unicode meaning."""
    return F.regexp_extract_all(F.col(text), F.lit("(?U)" + tokenizer.pattern), F.lit(0))


def _small(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its pre-tokens pass BATCH_PIECES, so that memory follows one text at most."""
    lengths = pc.list_value_length(batch[column]).fill_null(0).to_numpy()
    cells = np.cumsum(lengths) // BATCH_PIECES
    cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(batch)]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            yield batch.slice(a, b - a)


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", name: str = "ids") -> DataFrame:
    """Add the ids of a text column as an array of ints; other columns stay as they are."""
    docs = docs.drop(name)
    schema = StructType(list(docs.schema.fields)).add(name, ArrayType(IntegerType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole, "_pieces"):
                ids, bounds = tokenizer.encode_batch(batch["_pieces"])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                kept = [n for n in batch.schema.names if n != "_pieces"]
                yield pa.RecordBatch.from_arrays([batch[n] for n in kept] + [lists], names=[*kept, name])

    return docs.withColumn("_pieces", _pre_tokens(docs, tokenizer, text)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Per document: number of ids, digest of the ids and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole, "_pieces"):
                ids, bounds = tokenizer.encode_batch(batch["_pieces"])
                data, places = tokenizer.decode_batch(ids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(np.diff(bounds)), _digests(ids.astype("<u4"), bounds), _digests(data, places)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", _pre_tokens(docs, tokenizer, "text").alias("_pieces")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _digests(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in itertools.pairwise(bounds.tolist())], pa.string())
