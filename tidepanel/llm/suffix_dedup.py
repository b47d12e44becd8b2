"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a ``MATCH``-byte string that also starts in a document with a smaller id.
Indexing every suffix would multiply the input many times over, so the arrays hold the suffixes at anchors
only: the anchor of a 50-byte window is the 16-byte gram in it with the least hash (the leftmost of
equals). Equal windows have equal anchors, so nothing is missed; about one suffix in 18 is an anchor.
Neighbouring windows with one anchor form its span of at most 84 bytes.

1. Documents are dealt to blocks by id and text. A shared window shares 17 bytes right before or right after
   its gram, so each block sends a hash of gram and side for both sides of its anchors, each once, as sorted
   differences. Hashes sent by two blocks come back as one bit each. Their length grows with the input, and a
   collision only lets an entry pass that nothing matches.
2. Entries of anchors with a repeated side are made anew from the texts. Spans that repeat inside the block are
   settled there; only the smallest document's entry goes on, so a passage in a third of all documents
   costs one entry per block. Entries are packed, sorted and compressed, by index blocks of the anchor's hash.
3. Each index block takes its entries in batches of rising doc_id. A batch gets a suffix array (ordered by the
   first eight bytes, then by fingerprints of the rest of the span), is merge-scanned against the
   existing levels for equal spans, and what is new becomes a level; levels of like size merge, so
   sizes grow geometrically.
4. A span that is new as a whole may still share windows with another at the same anchor, at the edge of a
   copy. Where a side is shared, the span's windows that reach over that side are looked up in the texts and go
   through the index blocks one by one.
5. Removed spans meet the texts again, by blocks of the documents, and are cut out.

All steps are one plan, and the texts are shuffled once: steps 1, 2, 4 and 5 share that exchange. Entries carry 64
bits of the suffix itself, 64 bits of fingerprint over the whole span (all that tells spans apart which differ in
their outer bytes only) and 64 bits over the rest of the gram and its two sides. Null texts are empty; rows without
doc_id are kept whole, match nothing and are not shuffled; rows of one doc_id are one document for comparison, and
each of its texts is cut by its own spans. Long texts are read in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

MATCH, GRAM, SIDE = 50, 16, 17
PIECE = 1 << 20
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
BATCH_ENTRIES = 1 << 17
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
_INVERSE = np.uint64(pow(int(_C1), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C2
    h = (h ^ (h >> np.uint64(29))) * _C3
    return h ^ (h >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _C1), ("down", _INVERSE)):
            steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Strings:
    """Hashes of any substring of a buffer, from running sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts as they do."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


@dataclass
class Entries:
    """Columns of equal length. k1, gram2, id2, id3 identify a span; doc, start, size, text say where it is.

    k1 and gram2 are of the gram, id2 is the fingerprint of the span, id3 holds those of the two sides. text is the
    block of the document and, below 32 bits, the place of the text among those of its id there; lead is the place of
    the gram in the span.
    """

    k1: np.ndarray
    gram2: np.ndarray
    id2: np.ndarray
    id3: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    lead: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.k1)

    def take(self, at: np.ndarray | slice) -> Entries:
        return Entries(*(getattr(self, f.name)[at] for f in fields(self)))

    @staticmethod
    def join(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Entries)))

    def ordered(self) -> Entries:
        return self.take(np.lexsort((self.doc, self.id3, self.id2, self.gram2, self.k1)))

    def firsts(self) -> np.ndarray:
        """True at the first entry of each identity; the entries must be ordered."""
        new = np.zeros(len(self), bool)
        new[:1] = True
        for x in (self.k1, self.gram2, self.id2, self.id3):
            new[1:] |= x[1:] != x[:-1]
        return new

    def pack(self) -> bytes:
        """Compressed columns, bytes of equal weight together; ids as differences."""
        order = np.lexsort((self.text, self.doc))
        doc, text = self.doc[order], self.text[order]
        new = np.ones(len(order), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        ids = doc[new]
        columns = [
            self.k1, self.gram2.astype(np.uint32), self.id2, self.id3.astype(np.uint32), place.astype(np.uint32), self.start.astype(np.uint64),
            self.size.astype(np.uint16), self.lead.astype(np.uint8), np.diff(ids, prepend=np.int64(0)), text[new],
        ]
        raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)
        return struct.pack("<II", len(self), len(ids)) + zstandard.compress(raw, 1)

    @staticmethod
    def unpack(blob: bytes) -> Entries:
        n, m = struct.unpack_from("<II", blob)
        raw, at, out = zstandard.decompress(blob[8:]), 0, []
        for kind, size in (("u8", n), ("u4", n), ("u8", n), ("u4", n), ("u4", n), ("u8", n), ("u2", n), ("u1", n), ("i8", m), ("i8", m)):
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
            out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
            at += width * size
        ids = np.cumsum(out[8])
        return Entries(*out[:4], ids[out[4]], out[5].astype(np.int64), out[6], out[7], out[9][out[4]])


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(ends) else ends


def anchors(pieces: list[tuple[int, int, int, int, bytes]], texts: list[int] | None = None) -> Entries:
    """Entries of the anchors of pieces (doc, offset in the document, first window, last window + 1, bytes).

    ``texts`` has the tag of each piece's text.
    """
    data = np.frombuffer(b"".join(p[4] for p in pieces), np.uint8)
    sizes = np.array([len(p[4]) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    words = _words8(data)
    grams = _mix(words[:-8] * _C1 ^ (words[8:] + _C3) * _C2)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 3):  # windows of 2, 4, 8, 16, 32 and then 35 grams
        least = np.minimum(least[:-step], least[step:])
    whole = np.zeros(len(data) + 1, np.int32)
    lo, hi = (np.array([p[i] - p[1] for p in pieces]) + begins for i in (2, 3))
    np.add.at(whole, lo, 1)
    np.add.at(whole, hi, -1)
    windows = np.flatnonzero(np.cumsum(whole[: len(least)]))
    at = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    p, s1, s2 = at[first], windows[first], windows[np.append(first[1:], len(at)) - 1] + MATCH
    piece = np.searchsorted(begins, s1, side="right") - 1
    strings = Strings(data)
    has_left, has_right = p - SIDE >= begins[piece], p + GRAM + SIDE <= (begins + sizes)[piece]
    left = np.where(has_left, strings.hash(np.maximum(p - SIDE, 0), p) >> np.uint64(48) | np.uint64(1), np.uint64(0))
    tail = np.minimum(p + GRAM + SIDE, len(data))
    right = np.where(has_right, strings.hash(p + GRAM, tail) >> np.uint64(48) | np.uint64(1), np.uint64(0))
    gram2 = (_mix(words[p + 8]) >> np.uint64(32) | np.uint64(1)).astype(np.uint32)
    docs, offsets = np.array([x[0] for x in pieces], np.int64), np.array([x[1] for x in pieces])
    return Entries(
        words[p], gram2, strings.hash(s1, s2), (left << np.uint64(16) | right).astype(np.uint32), docs[piece],
        s1 - begins[piece] + offsets[piece], (s2 - s1).astype(np.uint16), (p - s1).astype(np.uint8),
        np.array(texts or [0] * len(pieces), np.int64)[piece],
    )


def _pieces(doc: int, raw: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """A document in pieces that together hold each window once, with bytes around them."""
    for lo in range(0, len(raw) - MATCH + 1, PIECE):
        hi = min(lo + PIECE, len(raw) - MATCH + 1)
        base = max(0, lo - 32)
        yield doc, base, lo, hi, raw[base : hi + MATCH + 31]


def _grouped(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    bounds = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, bounds):
        if len(part):
            yield int(key[part[0]]), part


_SPAN, _INDEX, _ASK = 0, 1, 2
_OUT = "kind int, part int, blob binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "part", "blob"]
    )


def _spans(found: Entries, kind: int = _SPAN) -> list[tuple[int, int, bytes]]:
    """Places packed by block of the document; only doc, start and size matter."""
    bare = Entries(
        *(np.zeros_like(x) for x in (found.k1, found.gram2, found.id2, found.id3)), found.doc, found.start, found.size,
        np.zeros_like(found.lead), found.text,
    )
    return [(kind, b, bare.take(at).pack()) for b, at in _grouped(found.text >> 32)] if len(found) else []


def _settle(found: Entries, blocks: int) -> list[tuple[int, int, bytes]]:
    """Pack entries for their blocks; those repeated from a smaller document of this group become spans.

    Entries of one gram share a block; single windows, which have no gram, go by their fingerprint.
    """
    found = found.ordered()
    first = np.flatnonzero(found.firsts())
    owner = np.repeat(found.doc[first], np.diff(np.append(first, len(found))))
    sent = found.take(found.doc == owner)
    gram = np.where(sent.gram2 > 0, sent.k1 + sent.gram2.astype(np.uint64) * _C3, sent.id2)
    place = (_mix(gram) % np.uint64(blocks)).astype(np.int64)
    return [(_INDEX, b, sent.take(at).pack()) for b, at in _grouped(place)] + _spans(found.take(found.doc > owner))


def _earlier(level: Entries, batch: Entries) -> np.ndarray:
    """Merge-scan: the level's doc for each entry of an ordered batch, or the largest number."""
    both = Entries.join([level, batch])
    of_batch = np.repeat([0, 1], [len(level), len(batch)])
    order = np.lexsort((of_batch, both.id3, both.id2, both.gram2, both.k1))
    both = both.take(order)
    first = np.flatnonzero(both.firsts())
    head = np.where(order[first] < len(level), both.doc[first], np.iinfo(np.int64).max)
    out = np.empty(len(batch), np.int64)
    spread = np.repeat(head, np.diff(np.append(first, len(both))))
    mine = order >= len(level)
    out[order[mine] - len(level)] = spread[mine]
    return out


def index_family(found: Entries) -> tuple[Entries, Entries]:
    """(entries whose span is in a smaller document, those of each span's smallest document)."""
    found = found.take(np.argsort(found.doc, kind="stable"))
    ends = np.append(np.flatnonzero(np.diff(found.doc)) + 1, len(found))
    size = max(BATCH_ENTRIES, len(found) // 8)
    cuts = [0]
    for end in ends:
        if end - cuts[-1] >= size or end == len(found):
            cuts.append(int(end))
    levels: list[Entries] = []
    removed = []
    for a, b in itertools.pairwise(cuts):
        batch = found.take(slice(a, b)).ordered()
        at = np.flatnonzero(batch.firsts())
        least = np.repeat(batch.doc[at], np.diff(np.append(at, len(batch))))
        new = batch.doc == least
        for level in levels:
            known = _earlier(level, batch)
            new &= known == np.iinfo(np.int64).max
            least = np.minimum(least, known)
        removed.append(batch.take(least < batch.doc))
        levels.append(batch.take(new))
        while len(levels) > 1 and len(levels[-2]) < 2 * len(levels[-1]):
            levels[-2:] = [Entries.join(levels[-2:]).ordered()]
    return Entries.join(removed), Entries.join(levels).ordered()


def _edges(known: Entries) -> Entries:
    """Windows that may be another document's: same gram, and they reach over a side that is the same too."""
    ask = []
    for side in (known.id3 >> np.uint32(16), known.id3 & np.uint32(0xFFFF)):
        order = np.lexsort((known.doc, side, known.gram2, known.k1))
        k1, k2, x, doc = known.k1[order], known.gram2[order], side[order], known.doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (x[1:] != x[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(order)) - 1
        shared = (doc[first] != doc[last]) & (x[first] != 0)
        ask.append(np.zeros(len(known), bool))
        ask[-1][order[np.repeat(shared, last - first + 1)]] = True
    # Windows up to 17 bytes before the gram hold the left side, those from there on the right one.
    left, right = ask
    turn = known.lead.astype(np.int64) - SIDE
    end = known.size.astype(np.int64) - MATCH
    first = np.where(left, 0, np.maximum(turn, 0))
    last = np.where(right, end, np.minimum(turn, end))
    asked = Entries(*(getattr(known, f.name) for f in fields(Entries)))
    asked.start, asked.size = known.start + first, np.maximum(last - first + MATCH, 0).astype(np.uint16)
    return asked.take((left | right) & (last >= first))


def _texts(docs: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """Rows of a block as doc_id, text tag (see ``Entries``) and bytes."""
    keys = list(zip(docs["doc_id"].to_pylist(), docs["th"].to_pylist(), strict=True))
    tags, last, rank = {}, None, 0
    for doc, th in sorted(set(keys)):
        rank = rank + 1 if doc == last else 0
        tags[doc, th], last = docs["part"][0].as_py() << 32 | rank, doc
    for key, text in zip(keys, docs["text"].to_pylist(), strict=True):
        yield key[0], tags[key], (text or "").encode("utf-8", "surrogatepass")


def _anchors_of(docs: pa.Table) -> Entries | None:
    """Entries of all texts of a block, some pieces at a time."""
    pieces, texts, held, done = [], [], 0, []
    for doc, tag, raw in _texts(docs):
        for piece in _pieces(doc, raw):
            pieces.append(piece)
            texts.append(tag)
            held += len(piece[4])
            if held >= CHUNK_BYTES:
                done.append(anchors(pieces, texts))
                pieces, texts, held = [], [], 0
    if pieces:
        done.append(anchors(pieces, texts))
    return Entries.join(done) if done else None


def _sides(found: Entries, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of gram and side, each once; the place among them of every entry's left and right (-1: none)."""
    gram = _mix(found.k1 * _C1 ^ (found.gram2.astype(np.uint64) + _C3) * _C2)
    side = np.concatenate([found.id3 >> np.uint32(16), found.id3 & np.uint32(0xFFFF)]).astype(np.uint64)
    which = np.repeat(np.array([0, 1], np.uint64), len(found))
    h = _mix(np.concatenate([gram, gram]) + (side << np.uint64(1) | which) * _C3) & np.uint64((1 << bits) - 1)
    has = side != 0
    once, place, count = np.unique(h[has], return_inverse=True, return_counts=True)
    at = np.full(len(h), -1)
    at[has] = place
    return once, count, at.reshape(2, -1)


_SIDES = "src int, part int, blob binary"


def _side_batch(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["src", "part", "blob"])


def _ask_sides(blocks: int, bits: int):
    """Each block's hashes to the parts they fall in, as differences."""
    width = np.uint64((1 << bits) // blocks + 1)

    def run(docs: pa.Table) -> pa.Table:
        found = _anchors_of(docs)
        if found is None:
            return _side_batch([])
        once, _, _ = _sides(found, bits)
        src = docs["part"][0].as_py()
        rows = []
        for part, at in _grouped((once // width).astype(np.int64)):
            steps = np.diff(once[at], prepend=np.uint64(part) * width)
            planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
            rows.append((src, part, zstandard.compress(planes.tobytes(), 1)))
        return _side_batch(rows)

    return run


def _answer_sides(table: pa.Table) -> pa.Table:
    """For every block's hashes one bit each: sent by another block too."""
    sent = []
    for blob in table["blob"].to_pylist():
        planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
        sent.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)))
    every = np.sort(np.concatenate(sent))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for src, part, mine in zip(table["src"].to_pylist(), table["part"].to_pylist(), sent, strict=True):
        at = np.searchsorted(twice, mine)
        known = (at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == mine) if len(twice) else np.zeros(len(mine), bool)
        rows.append((part, src, zstandard.compress(np.packbits(known).tobytes(), 1)))
    return _side_batch(rows)


def _index(blocks: int, bits: int):
    """Entries of anchors with a side that is found elsewhere too, for their index blocks."""
    width = np.uint64((1 << bits) // blocks + 1)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = _anchors_of(docs)
        if found is None:
            return pa.Table.from_batches([_batch([])])
        once, count, at = _sides(found, bits)
        answer = dict(zip(answers["src"].to_pylist(), answers["blob"].to_pylist(), strict=True))
        repeated = count > 1
        for part, mine in _grouped((once // width).astype(np.int64)):
            known = np.unpackbits(np.frombuffer(zstandard.decompress(answer[part]), np.uint8), count=len(mine))
            repeated[mine] |= known.astype(bool)
        repeated = np.append(repeated, False)  # where the place is -1
        return pa.Table.from_batches([_batch(_settle(found.take(repeated[at].any(axis=0)), blocks))])

    return run


def _reduce(edges: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("kind", "part", "blob")), strict=True))
        out = [r for r in rows if r[0] == _SPAN]
        if index := [Entries.unpack(blob) for kind, _, blob in rows if kind == _INDEX]:
            removed, known = index_family(Entries.join(index))
            out += _spans(removed)
            if edges:
                out += _spans(_edges(known), _ASK)
        return pa.Table.from_batches([_batch(out)])

    return run


def _gather(table: pa.Table, kind: int) -> Entries | None:
    parts = [Entries.unpack(b) for k, b in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == kind]
    return Entries.join(parts) if parts else None


def _windows(blocks: int):
    """Single windows of the spans asked for, as entries of their own; removed spans go on as they are."""
    def run(docs: pa.Table, settled: pa.Table) -> pa.Table:
        out = [r for r in zip(*(settled[c].to_pylist() for c in ("kind", "part", "blob")), strict=True) if r[0] == _SPAN]
        spans = _gather(settled, _ASK)
        if spans is None:
            return pa.Table.from_batches([_batch(out)])
        raw = {(doc, tag): text for doc, tag, text in _texts(docs)}
        places = zip(spans.doc.tolist(), spans.text.tolist(), spans.start.tolist(), spans.size.tolist(), strict=True)
        data = np.frombuffer(b"".join(raw[doc, tag][start : start + size] for doc, tag, start, size in places), np.uint8)
        sizes = spans.size.astype(np.int64)
        begins, n = np.cumsum(sizes) - sizes, sizes - MATCH + 1
        at = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
        zero = np.zeros(len(at), np.uint32)
        found = Entries(
            _words8(data)[at], zero, Strings(data).hash(at, at + MATCH), zero, np.repeat(spans.doc, n),
            np.repeat(spans.start, n) + at - np.repeat(begins, n), np.full(len(at), MATCH, np.uint16), zero.astype(np.uint8),
            np.repeat(spans.text, n),
        )
        return pa.Table.from_batches([_batch(out + _settle(found, blocks))])

    return run


_CUT = "doc_id bigint, text_bytes binary, n_bytes bigint, n_removed bigint, n_spans bigint"


def _cut_rows(rows: list[tuple[int | None, bytes, int, int, int]], whole: bool) -> pa.Table:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    columns = [[r[i] for r in rows] for i in range(5)]
    if not whole:
        columns[1] = [hashlib.sha256(b).hexdigest().encode() for b in columns[1]]
    names = [part.split()[0] for part in _CUT.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _cut(whole: bool):
    def run(docs: pa.Table, removed: pa.Table) -> pa.Table:
        spans = _gather(removed, _SPAN)
        of_text = {}
        if spans is not None:
            for _, at in _grouped(spans.doc):
                for _, mine in _grouped(spans.text[at]):
                    of_text[int(spans.doc[at[0]]), int(spans.text[at[mine[0]]])] = at[mine]
        rows = []
        for doc, tag, raw in _texts(docs):
            at = of_text.get((doc, tag))
            if at is None:
                rows.append((doc, raw, len(raw), 0, 0))
                continue
            starts, ends = _runs(spans.start[at], spans.start[at] + spans.size[at])
            kept = [raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)], strict=True)]
            rows.append((doc, b"".join(kept), len(raw), int((ends - starts).sum()), len(starts)))
        return _cut_rows(rows, whole)

    return run


def _untouched(whole: bool):
    """Rows without id, as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
            yield from _cut_rows([(None, raw, len(raw), 0, 0) for raw in raws], whole).to_batches()

    return run


def remove_repeats(docs: DataFrame, digest_only: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_bytes (what is left, or its SHA-256), n_bytes, n_removed, n_spans of every row."""
    docs = docs.select("doc_id", "text")
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    blocks = max(1, -(-total // block_bytes))
    bits = min(56, (total // 9 + 1).bit_length() + 8)  # about total / 18 anchors of two sides each
    dealt = (
        docs.where(F.col("doc_id").isNotNull()).withColumn("th", F.xxhash64("text"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "th"), F.lit(blocks)).cast("int")).select("part", "doc_id", "th", "text")
    )
    by_block = dealt.groupBy("part")
    answers = (
        by_block.applyInArrow(_ask_sides(blocks, bits), _SIDES).groupBy("part").applyInArrow(_answer_sides, _SIDES)
    )
    settled = (
        by_block.cogroup(answers.groupBy("part")).applyInArrow(_index(blocks, bits), _OUT)
        .groupBy("part").applyInArrow(_reduce(True), _OUT)
    )
    removed = (
        by_block.cogroup(settled.groupBy("part")).applyInArrow(_windows(blocks), _OUT)
        .groupBy("part").applyInArrow(_reduce(False), _OUT)
    )
    cut = by_block.cogroup(removed.groupBy("part")).applyInArrow(_cut(not digest_only), _CUT)
    return cut.unionByName(docs.where(F.col("doc_id").isNull()).mapInArrow(_untouched(not digest_only), _CUT))
