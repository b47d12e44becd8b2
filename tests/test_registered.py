"""Registered queries against DuckDB; ``tools/check_oracles.py`` runs all of them."""

from __future__ import annotations

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare, duck  # noqa: E402

DATA = "/root/testdata/sf0.001"
SAMPLE = [
    "rollup_strict", "wilder_atr", "decile", "episodes", "barrier_label", "eligibility_pit", "gap_classify",
    "plan_source_tiers", "page_chain_check", "object_key_parse", "article_text", "validate_bars", "catalog_merge", "extract_symbols", "src_bar_archive",
]

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not present")


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, duck(DATA), name, DATA).startswith("ok")


@needs_data
def test_planned_period_keys_has_the_rows_of_its_sql(spark):
    assert re.fullmatch(r"ok \(\d+ rows\)", compare(spark, duck(DATA), "planned_period_keys", DATA))


@needs_data
def test_entry_has_rows(spark):
    result = entry.entry(spark)
    assert result.count() > 0 and "hot_score" in result.columns


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # The text queries come and go with their folder, one by operator and the pipeline.
    named = {n for n in entry.queries() if re.match(r"op\d+_", n) or n == "pipeline"}
    home = os.path.dirname(entry.__file__)
    if os.path.isdir(os.path.join(home, "tidepanel", "llm")) and os.path.isfile(os.path.join(home, "corpus_pipeline.py")):
        assert {int(re.match(r"op(\d+)_", n)[1]) for n in named - {"pipeline"}} == set(range(1, 14)) and "pipeline" in named
    else:
        assert not named
