"""Corpus pipeline: documents in, encoded training documents out, in five stored stages.

Every stage takes all rows its predecessor kept and rewrites or drops them; all but the last return the
columns of ``documents``. Labels, benchmark items and the tokenizer are read as given.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from tidepanel.llm.common import materialize, table
from tidepanel.llm.queries import public_tokenizer

NEAR = Fraction(8, 10)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as 0 go."""
    judged = quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("predicted = 1").select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites stay at their first place only; documents left without any go."""
    cleaned = line_dedup.drop_spread_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) == "")
    changed = cleaned.where(~emptied).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    )
    return changed.select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (0.8 or more alike) the document with the smallest id stays."""
    return near_dedup.keep_one(docs.select(*COLUMNS), NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text."""
    encoded = byte_bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizer())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

# The classifier is learned by gradient steps, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
