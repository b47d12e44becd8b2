"""Pipeline stages on planted documents, each on what its predecessor kept."""

from __future__ import annotations

import random

import pytest
import tiktoken

from tidepanel.llm.queries import public_tokenizer
from tidepanel.session import materialize

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

LINE = "Subscribe to our letter now"
SYLLABLES = ["ba", "do", "ki", "lu", "mé", "na", "po", "ri", "su", "ta"]


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(SYLLABLES, k=3)) for _ in range(n)]


def planted() -> dict[int, str | None]:
    texts: dict[int, str | None] = {i: f"{' '.join(prose(i, 60))}\n{LINE}" for i in range(12)}
    texts[50] = LINE
    near = prose(60, 100)
    texts[60] = " ".join(near)
    texts[61] = " ".join([*near[:50], "changed", *near[51:]])  # 91 of 101 shingles
    texts[70] = " ".join([*prose(70, 20), *prose(900, 12), *prose(71, 20)])
    texts[71] = " ".join([*prose(72, 20), *prose(900, 9), *prose(73, 20)])  # one word short of a window
    texts[80] = None
    texts[81] = ""
    return texts


def frame(spark, texts: dict[int, str | None]):
    rows = [(i, t, None if i == 5 else "en", f"site{i}", len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("sf"))
    items = [(1, " ".join(prose(900, 12))), (2, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    # Long words are good, single letters bad; equal numbers of both.
    texts = {100 + i: " ".join(prose(100 + i, 40)) if i % 2 else " ".join("xqz"[(i + j) % 3] for j in range(40)) for i in range(200)}
    frame(spark, {**texts, **planted()}).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 2), 0) for i in texts]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rest(spark, folder, docs):
    """The stages after the classifier, stored between each as run() does."""
    kept = []
    for name, stage in pipeline.STAGES[1:]:
        docs = materialize(stage(spark, docs, folder), name)
        kept.append({r.doc_id: r for r in docs.collect()})
    return kept


def test_stages_after_the_classifier(spark, folder):
    texts = planted()
    lines, near, clean, encoded = rest(spark, folder, frame(spark, texts))
    # The spread line stays at its first place; the document that held nothing else goes.
    assert set(lines) == set(texts) - {50}
    want = {i: t.split("\n")[0] if 0 < i < 12 else t for i, t in texts.items() if i != 50}
    assert {i: r.text for i, r in lines.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in lines.values())
    assert set(near) == set(lines) - {61}
    assert set(clean) == set(near) - {70}
    assert {i: r.text for i, r in clean.items()} == {i: want[i] for i in clean}
    own = public_tokenizer()
    library = tiktoken.Encoding("own", pat_str=own.pattern, mergeable_ranks=own.ranks, special_tokens={})
    assert {i: list(r.ids) for i, r in encoded.items()} == {i: library.encode_ordinary(want[i] or "") for i in clean}


def test_run_rejects_what_the_labels_call_bad(spark, folder):
    got = {r.doc_id for r in pipeline.run(spark, folder).select("doc_id").collect()}
    learned = range(100, 300)
    assert {i for i in learned if i in got} == {i for i in learned if i % 2}
    assert not got & {50, 61, 70}


def test_empty_documents(spark, folder):
    assert rest(spark, folder, frame(spark, planted()).limit(0)) == [{}, {}, {}, {}]
