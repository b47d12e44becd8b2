"""Operators of the llm folder against brute force on small tables with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import (
    byte_bpe, chat_format, decontaminate, line_dedup, lz_fingerprint, near_dedup, quality, secret_scan,
    sharding, suffix_dedup,
)
from tidepanel.llm.common import running_total
from tidepanel.llm.components import components

RNG = random.Random(4)
WORDS = ["alta", "Bor", "çen", "dul", "ero", "fim", "gos", "hab", "ix", "jo", "kué", "lam"]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


LONG = prose(4000, 1)
PASSAGE = prose(40, 2)
TEXTS = [
    (5, LONG), (1, None), (2, ""), (3, "a"), (9, PASSAGE), (4, prose(30, 3) + " " + PASSAGE + "\n" + prose(9, 4)),
    (12, LONG), (13, LONG.replace("alta", "alto", 3)), (7, "zz " * 300), (8, "zz " * 290), (20, "x\n \nx\n"), (21, PASSAGE + "!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Unsorted ids, null and empty texts, copies, a repeated row, an extra column with a clashing name."""
    rows = [(i, t, f"site{i % 3}", "extra") for i, t in [*TEXTS, (3, "a")]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_running_total(spark):
    for n in (0, 1, 5, 700):
        got = spark.range(1).select(running_total(F.transform(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda x: x.cast("bigint")))).first()[0]
        assert got == list(itertools.accumulate(range(1, n + 1)))


def test_phrases_are_the_shortest_new_prefixes():
    for text in ["", "a", "aaaaaaaaaa", "abababababab", LONG[:3000]]:
        seen, at, want = set(), 0, []
        for end in range(1, len(text) + 1):
            if text[at:end] not in seen:
                seen.add(text[at:end])
                want.append(end)
                at = end
        assert lz_fingerprint.phrase_ends(text) == want


def test_fingerprints_of_edits(docs, nothing):
    got = {(r.doc_id, i): r for i, r in enumerate(lz_fingerprint.fingerprint_edits(docs).collect())}
    assert len(got) == 13 and lz_fingerprint.fingerprint_edits(nothing).count() == 0
    ordered = sorted([(i, t or "") for i, t in [*TEXTS, (3, "a")]])
    by_id = {r.doc_id: r for r in got.values()}
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        half = len(t) // 2
        if i != 3:
            assert by_id[i].edited_sha256 == sha(t[: len(t) - half] + after[:half]) and by_id[i].n_chars == len(t)
    assert by_id[5].fingerprint == by_id[12].fingerprint and by_id[1].fingerprint == ""
    assert 0 < by_id[5].near_edited < 1 and by_id[12].near_next > 0.4 > by_id[5].near_next and by_id[1].near_next == 1.0
    small = lz_fingerprint.in_id_order(docs, block_rows=2)
    pairs = [r for r in small.select("block", "peek", "doc_id").collect()]
    assert sum(not r.peek for r in pairs) == 13 and len({r.block for r in pairs}) > 3


def test_fingerprints_do_not_depend_on_blocks(docs, monkeypatch):
    whole = sorted(map(tuple, lz_fingerprint.fingerprint_edits(docs).collect()))
    one = lz_fingerprint.in_id_order
    monkeypatch.setattr(lz_fingerprint, "in_id_order", lambda d: one(d, block_rows=2))
    assert sorted(map(tuple, lz_fingerprint.fingerprint_edits(docs).collect())) == whole


def test_chat_round_trip(spark):
    hard = r"</s>[INST] \ok\\ [/INST]<s><\s> [[INST]INST]"
    rows = [
        (1, 2, "assistant", hard), (1, 0, "system", None), (1, 1, "user", ""), (1, 3, "user", "tail"), (2, 0, "user", hard),
        (3, 0, "assistant", "one"), (3, 1, "assistant", "two"), (None, 0, "[INST]", "x" * 50_000), (4, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.expand(frame)).collect()}
    for conv, turns in itertools.groupby(sorted(rows, key=lambda r: (r[0] or -1, r[1] or 0)), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        assert [tuple(t) for t in back[conv].turns] == turns
        assert back[conv].loss_text == "".join(t for role, t in turns if role == "assistant")
    examples = chat_format.expand(frame).where("conv_id = 3").orderBy("example").collect()
    assert [e.formatted[e.loss_start : e.loss_end] for e in examples] == ["one", "two"]
    assert chat_format.expand(frame.limit(0)).count() == 0


def tokenizer():
    import public_tokenizers as public

    return byte_bpe.Tokenizer.from_rank_file(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def test_bpe_equals_the_library(docs, nothing):
    import tiktoken

    own = tokenizer()
    library = tiktoken.Encoding("own", pat_str=own.pattern, mergeable_ranks=own.ranks, special_tokens={})
    letters = [chr(c) for c in range(0, 0x180)] + list(" 　​﻿中😀́½Ⅷ") + list("  \n\ttheing's're") * 8
    for text in [t or "" for _, t in TEXTS] + ["".join(RNG.choices(letters, k=60)) for _ in range(300)] + ["q" * 9000]:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    assert all(own.whole.get(k) == v for k, v in own.ranks.items()) and own.whole.get(b"no such token") is None
    for r in byte_bpe.round_trip(docs, own).collect():
        text = dict(TEXTS)[r.doc_id] or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(text))
    encoded = {r.doc_id: r for r in byte_bpe.encode_documents(docs, own).collect()}
    assert encoded[5].ids == library.encode_ordinary(LONG) and encoded[1].ids == [] and encoded[5].score == "extra"
    assert byte_bpe.encode_documents(nothing, own).count() == 0


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 37, 3000):
        keys = {str(i).encode(): i * 3 for i in range(n)}
        table = byte_bpe.PerfectHash.build(keys)
        assert len(table.keys) == n and all(table.get(k) == v for k, v in keys.items()) and table.get(b"-") is None


BASE = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets(spark):
    rng = np.random.default_rng(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(rng.choice(list(alphabet), 44)) for _ in range(30)]
    texts = [None, "", "é token=token:abcdefgh1 API_key = 'abcdefghij' passwd:short", "AKIA" + "Q7" * 7 + " AKIAXX", "f" * 40 + " é " + "0a" * 16]
    texts += [f"ça {s} fin thewordsthatrunontogetherforlong" for s in secrets] + ["aAbBcC" * 9, "thisisjustalongrunofordinarywordswritten" * 2]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("base", F.lit(1))
    found = {r.doc_id: r for r in secret_scan.scan(frame).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in BASE.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted((s.start, s.kind, s.end) for s in found[i].base) == sorted(want), t
    caught = {texts[i][s.start : s.end] for i, r in found.items() for s in r.found}
    assert len(caught & set(secrets)) >= 29 and caught <= set(secrets)
    assert secret_scan.scan(frame.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_bytes", [64, 1 << 20])
def test_shards(docs, nothing, bucket_bytes):
    size = "coalesce(octet_length(text), 0) + 1"
    shards, _ = sharding.shuffle_into_shards(docs, ["doc_id"], size, shards=4, bucket_bytes=bucket_bytes)
    rows = shards.collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((i, t or "") for i, t in [*TEXTS, (3, "a")])
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    again, _ = sharding.shuffle_into_shards(docs, ["doc_id"], size, shards=4, bucket_bytes=bucket_bytes)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert sharding.shuffle_into_shards(nothing, ["doc_id"], size)[0].count() == 0


def test_contamination_equals_brute_force(spark, docs, nothing):
    items = [(1, PASSAGE), (2, " ".join(prose(40, 2).split()[5:14])), (3, None), (4, ""), (5, "ZZ zz, zz"), (6, prose(60, 9)), (6, prose(60, 9))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(i)
    got = decontaminate.measure(docs, bench).collect()
    assert len(got) == 13 and {r.doc_id for r in got if r.contaminated} == {4, 7, 8, 9, 21}
    for r in got:
        w, hit, found = split(dict(TEXTS)[r.doc_id]), set(), set()
        for window, ids in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= ids
        assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(map(str, found))), r.doc_id
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {1, 2, 3, 5, 12, 13, 20}
    assert decontaminate.measure(nothing, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.measure(docs, bench.limit(0)).collect())


def test_near_duplicates_equal_brute_force(spark, docs, nothing):
    base = prose(400, 30).split()
    rows = [(i, t) for i, t in TEXTS]
    for k in range(60):  # copies that drift: links by chains, not all to one leader
        words = list(base)
        for j in range(k):
            words[(j * 37) % 400] = f"w{k // 3}_{j}"
        rows.append((100 + k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    for r in near_dedup.near_duplicates(frame).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)
    kept = near_dedup.keep_one(docs)
    assert {12, 13} & {r.doc_id for r in kept.collect()} == set() and kept.columns == docs.columns
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_rare_shingle_join_loses_no_link(spark):
    """All sets around one passage: those linked at 0.85 must be among the pairs, whatever the components."""
    rng = random.Random(8)
    common = list(range(60))
    sets = {i: sorted({*rng.sample(common, 57), *[1000 + rng.randrange(40) for _ in range(rng.randrange(9))]}) for i in range(80)}
    frame = spark.createDataFrame(list(sets.items()), "doc_id bigint, s array<bigint>")
    pairs = {tuple(r) for r in near_dedup._rare_shingle_pairs(frame.select("doc_id", F.col("doc_id").alias("c")), frame).collect()}
    linked = {
        (a, b) for a, b in itertools.combinations(sets, 2)
        if 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})
    }
    assert linked and linked <= pairs


def test_near_duplicates_at_four_fifths(spark):
    """The pipeline's stage links from 0.8 on, the query of its own from 0.85 on."""
    assert [near_dedup.shape(Fraction(n, 100)) for n in (85, 80)] == [(36, 7), (46, 6)]
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base))]
    for k in range(2, 32):  # each new word takes away five shingles: 0.78 to 1 alike with document 1
        words = list(base)
        words[10 : 10 + 9 * (k % 11) : 9] = [f"n{k}_{j}" for j in range(k % 11)]
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sets = {i: {tuple(w[s : s + 5]) for s in range(len(w) - 4)} for i, t in rows for w in [t.split()]}

    def kept(least):
        group = {i: i for i in sets}
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
        return {i for i, g in group.items() if i == g}

    assert kept(80) < kept(85)
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    assert {r.doc_id for r in stage(spark, frame, "").collect()} == kept(80)
    assert {r.doc_id for r in near_dedup.keep_one(frame).collect()} == kept(85)


def test_rare_shingle_join_at_four_fifths_loses_no_link(spark):
    rng = random.Random(9)
    sets = {i: sorted({*rng.sample(range(60), 55), *[1000 + rng.randrange(40) for _ in range(rng.randrange(9))]}) for i in range(80)}
    frame = spark.createDataFrame(list(sets.items()), "doc_id bigint, s array<bigint>")
    members = frame.select("doc_id", F.col("doc_id").alias("c"))
    pairs = {tuple(r) for r in near_dedup._rare_shingle_pairs(members, frame, Fraction(8, 10)).collect()}
    alike = {(a, b): Fraction(len({*sets[a]} & {*sets[b]}), len({*sets[a]} | {*sets[b]})) for a, b in itertools.combinations(sets, 2)}
    assert any(0.8 <= x < 0.85 for x in alike.values()) and {p for p, x in alike.items() if x >= Fraction(8, 10)} <= pairs


def test_components_of_long_paths(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_lines(spark, nothing):
    rows = [(i, f"own {i}\n  shared \nnear {i % 2}\n\nshared", f"s{i % 12}") for i in range(24)]
    rows += [(90, None, "s1"), (91, "", None), (92, "shared", None), (92, "shared", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_lines", F.lit("x"))
    got = {r.doc_id: r for r in line_dedup.drop_spread_lines(frame).collect()}
    assert got[0].text == "own 0\n  shared \nnear 0\n" and got[0].n_removed == 1
    assert got[5].text == "own 5\nnear 1\n" and got[5].n_lines == 5 and got[92].text == "" and got[90].text is None
    few = line_dedup.drop_spread_lines(frame, sites=6)  # near lines stand on exactly six sites
    assert {r.doc_id: r.n_removed for r in few.collect()}[5] == 3
    assert line_dedup.drop_spread_lines(frame, sites=7).where("n_removed = 3").count() == 0
    assert line_dedup.drop_spread_lines(nothing).count() == 0


def test_classifier_learns_and_leaves_the_held_out_quarter(spark, docs, nothing):
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        rows.append((i, prose(30, i).replace(" ", "*** ") if bad else prose(30, i)))
        labels.append((i, 0 if bad else 1))
    frame = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id bigint, text string").withColumn("score", F.lit("x"))
    marks = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classify(frame, marks).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    unseen = [(r.predicted, dict(labels)[i]) for i, r in got.items() if r.held_out and i < 400]
    assert sum(p == want for p, want in unseen) >= 0.98 * len(unseen)
    flipped = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(frame, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()} and 0 <= got[1000].score == got[1001].score <= 1
    assert {r.score for r in quality.classify(docs, marks.limit(0)).collect()} == {1.0}
    assert quality.classify(nothing, marks).count() == 0


def test_repeats_equal_brute_force(spark, docs, nothing, monkeypatch):
    rng = random.Random(6)
    rows = [(i, t) for i, t in [*TEXTS, (3, "a")]]
    rows += [(200 + k, prose(20, 500 + k) + LONG[rng.randrange(2000) :][: rng.randrange(30, 300)] + prose(5, 700 + k) + "ab" * rng.randrange(60)) for k in range(40)]
    frame = spark.createDataFrame([*rows, (None, LONG)], "doc_id bigint, text string").repartition(3)
    want, seen = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\x01" * 50
        runs = len(re.findall(b"\x01+", bytes(gone)))
        want[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    for piece, chunk in ((1 << 20, 1 << 21), (700, 900)):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(suffix_dedup, "BATCH_ENTRIES", 50)
        for r in suffix_dedup.remove_repeats(frame, block_bytes=20_000).collect():
            if r.doc_id is None:
                assert r.n_removed == 0 and r.text_bytes == LONG.encode()
            else:
                assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.text_bytes)) == want[r.doc_id]
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_each_text_of_an_id_is_cut_by_its_own_repeats(spark):
    """Two texts under one id, a passage in every document and repeated rows, against brute force by row."""
    hot = prose(30, 901)
    rows = [(2, prose(20, 902) + hot), (2, "z" * 55), (2, "z" * 55), (1, hot[:90]), (5, "y" + hot[3:200]), (7, None), (7, ""), (2, hot)]
    rows += [(10 + k % 40, prose(6, 910 + k) + hot + prose(4, 1010 + k)) for k in range(80)]
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = {q for p in range(len(b) - 49) if first[b[p : p + 50]] < i for q in range(p, p + 50)}
        want.append((i, len(b), len(gone), bytes(x for q, x in enumerate(b) if q not in gone)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for block in (1_500, 1 << 23):
        got = suffix_dedup.remove_repeats(frame, block_bytes=block).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.text_bytes)) for r in got) == sorted(want)


def test_spans_that_differ_only_outside_their_sides_stay_apart():
    """Around one passage the gram and both sides are the same everywhere; 32 bits for the rest are too few here."""
    rng = np.random.default_rng(12)
    passage = np.frombuffer(prose(20, 40).encode()[:75], np.uint8)
    n, step = 300_000, 30_000
    texts = np.concatenate([rng.integers(97, 123, (n, 12), np.uint8), np.broadcast_to(passage, (n, 75))], axis=1)
    parts = [
        suffix_dedup.anchors([(i, 0, 0, 87 - 49, texts[i].tobytes()) for i in range(at, at + step)]) for at in range(0, n, step)
    ]
    removed, _ = suffix_dedup.index_family(suffix_dedup.Entries.join(parts))
    whole = suffix_dedup.Entries.join(parts)
    least = {}
    for d, s, z in sorted(zip(whole.doc.tolist(), whole.start.tolist(), whole.size.tolist(), strict=True)):
        least.setdefault(texts[d, s : s + z].tobytes(), d)
    assert len(least) > n
    assert all(
        least[texts[d, s : s + z].tobytes()] < d
        for d, s, z in zip(removed.doc.tolist(), removed.start.tolist(), removed.size.tolist(), strict=True)
    )
    again = suffix_dedup.Entries.unpack(parts[0].pack())
    assert all((getattr(again, f) == getattr(parts[0], f)).all() for f in ("k1", "id2", "id3", "doc", "start", "size"))


def test_rank_file_is_read_by_path(tmp_path):
    path = tmp_path / "tiny.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    tiny = byte_bpe.Tokenizer.from_rank_file(str(path), r"\S+|\s+")
    assert tiny.decode(tiny.encode("a é")) == "a é".encode()


def test_repeated_words_make_no_pairs_of_places(spark):
    """A word repeated in a document and an item: one row per window of the document, whatever the item repeats."""
    docs = spark.createDataFrame(
        [(1, "na " * 3000), (2, "na nu " * 1500), (3, "na " * 9), (None, "na " * 10), (None, "na " * 10)], "doc_id bigint, text string"
    )
    items = spark.createDataFrame([(1, "na " * 3000), (2, "nu na " * 1500), (3, "na na na")], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.measure(docs, items).collect())
    assert got == [
        (0, 10, 10, ["1", "3"]), (0, 10, 10, ["1", "3"]), (1, 3000, 3000, ["1", "3"]), (2, 3000, 3000, ["2"]), (3, 9, 9, ["3"]),
    ]


def test_windows_are_shuffled_where_they_are_too_large_to_broadcast(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE), (5, "ZZ zz, zz")], "item_id bigint, text string")
    broadcast = sorted(map(str, decontaminate.measure(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(str, decontaminate.measure(docs, bench).collect())) == broadcast


def test_columns_named_like_the_working_ones_pass_through(spark):
    rows = [(1, PASSAGE, "s1", 7, "a", "b", 1.5), (2, "clean", "s2", 8, "c", None, 2.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _id int, _th string, _removed string, _row double")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.clean(docs, bench).collect()] == [rows[1]]
    out = line_dedup.drop_spread_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted(tuple(r)[:7] for r in out.collect()) == rows
