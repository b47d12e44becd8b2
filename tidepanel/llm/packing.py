"""Packing by power-of-two decomposition: no sequence crosses documents, no sequence is padded.

The ids of a document (its tokens and an end id) are cut into full sequences of ``most`` ids and, for
the rest, into pieces whose lengths are the binary digits of what is left, longest first. Every
piece is a sequence of its own and its length is a power of two, so sequences of equal length are
bucketed together and a batch of any bucket is a full rectangle: ``batch`` numbers groups of at most
``most`` ids of one bucket and task.

Null texts are empty (one piece with the end id). Rows are packed each for itself, so null, repeated or
hot ids need no care, and columns other than doc_id and text are ignored. Nothing is shuffled: the ids are
stored once in the shared folder, and the numbers given there hold from then on, whichever task is
run again. A task holds one text with its ids, an Arrow batch of output and a bounded word cache.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidepanel.session import scratch_path

SEQUENCE = 4096
END_ID = 2
CACHE_WORDS = 600_000
CACHED_LENGTH = 48
OUT_BYTES = 8 << 20


def _bytes(ids: list[int]) -> bytes:
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


class WordIds(dict):
    """Token ids of white-space separated words, as little-endian 32-bit bytes.

    The tokenizer's normaliser and splitter look at no more than a word at a time where words are
    separated by a blank or a line feed, so a text's ids are those of its words in a row. Words of plain
    letters, digits and marks are split here and looked up in the model; all others are left to the
    tokenizer as they are.
    """

    # Contractions and classes of the vocabulary's own splitting pattern, within Latin-1.
    _PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [c for c in map(chr, range(256)) if self._PLAIN.fullmatch(c)]
        self._spelled = {ord(c): to_bytes.pre_tokenize_str(c)[0][0] for c in plain}
        self._own_split = self._agrees(plain)
        self._parts: dict[str, bytes] = {}

    def _agrees(self, plain: list[str]) -> bool:
        """Whether the split of plain words above is the one of this tokenizer."""
        samples = ["".join(plain), "It'sÀ9z..'S'llx'tom'dé''re9'VE", *(f"a{c}B{c}{c}1'{c}s" for c in plain)]
        return all(self._split(s) == self._whole(s) for s in samples)

    def _whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.translate(self._spelled)
        return _bytes([t.id for t in self.tokenizer.model.tokenize(spelled)])

    def _split(self, word: str) -> bytes:
        return b"".join(map(self._model, self._PARTS.findall(word.lower())))

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHED_LENGTH or not self._own_split or "<|" in word or not self._PLAIN.fullmatch(word):
            ids = self._whole(word) if word else b""
        else:
            found = []
            for part in self._PARTS.findall(word.lower()):
                known = self._parts.get(part)
                if known is None:
                    if len(self._parts) >= CACHE_WORDS:
                        self._parts.clear()
                    known = self._parts[part] = self._model(part)
                found.append(known)
            ids = b"".join(found)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table of words for each worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def cuts(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full sequences, then the binary digits of the rest."""
    pieces = [(at, most) for at in range(0, n - most + 1, most)]
    at = n - n % most
    while at < n:
        length = 1 << ((n - at).bit_length() - 1)
        pieces.append((at, length))
        at += length
    return pieces


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()),
    ("slot", pa.int64()), ("ids", pa.binary()),
])
_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, part int, slot bigint, ids binary"


def pieces(docs: DataFrame, vocabulary: str, most: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces with their ids; ``part`` is the task and ``slot`` numbers its pieces of equal length from 0."""
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = _bytes([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, slots, rows, held = word_ids(vocabulary), TaskContext.get().partitionId(), {}, [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = words.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for start, length in cuts(n, most):
                    slot = slots[length] = slots.get(length, -1) + 1
                    rows.append((doc_id.as_py(), start, length, n, part, slot, ids[4 * start : 4 * (start + length)]))
                    held += 4 * length + 48
                    if held >= OUT_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES
    )


def pack(docs: DataFrame, vocabulary: str, most: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Sequences: doc_id, start, length, doc_tokens, bucket, batch, sequence_id, offset, ids (32-bit, little-endian).

    ``bucket`` is the binary logarithm of the length. A sequence holds one piece, at offset 0.
    """
    path = scratch_path(docs.sparkSession, "packing")
    pieces(docs, vocabulary, most, end_id).write.option("compression", "zstd").parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    bucket = F.log2(F.col("length")).cast("int")
    place = F.col("slot").bitwiseOR(F.shiftleft(F.col("part").cast("bigint"), 34))
    return stored.select(
        "doc_id", "start", "length", "doc_tokens", bucket.alias("bucket"),
        F.concat_ws("-", F.col("part").cast("string"), F.floor(F.col("slot") * F.col("length") / most).cast("string")).alias("batch"),
        F.shiftleft(place, 5).bitwiseOR(bucket.cast("bigint")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), "ids",
    )


def write_buckets(sequences: DataFrame, path: str) -> None:
    """One folder for each length; a reader takes batches of one bucket as rectangles."""
    sequences.write.partitionBy("bucket").parquet(path)
