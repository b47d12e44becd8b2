"""Benchmark decontamination by winnowing, in built-in functions only.

Each window of ``WINDOW`` words keeps the least hash of its grams of ``GRAM`` words. Equal windows keep equal
hashes, so every document that shares a window with an item shares a kept hash: documents are joined with the
items on kept hashes, and a hit is extended from its gram to the window that kept it, word for word; windows that
overlap make up the longer shared spans. An item of fewer words is one window: its whole word sequence is its
gram, and documents keep all grams of the lengths such items have.

The documents are read twice: once for their kept hashes, which leave the scan as narrow rows, and once for
the documents with a hit. What is broadcast is measured in bytes first and shuffled beyond ``BROADCAST_BYTES``. A
window costs one row whatever its words, so a word repeated thousands of times in a document and an item makes no
pairs of places. Rows that share id and text get the same answer, each its own row. Texts are read
whole; null or wordless ones have no hits; null or wordless items none either. Items that share an id
count once. Extra columns of any name pass through ``clean`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.common import lower_ascii, materialize, packed, row_key

WINDOW = 10
GRAM = 5
BROADCAST_BYTES = 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(ws: Column, k: int) -> Column:
    return F.when(
        F.size(ws) >= k, F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k)))
    ).otherwise(F.array().cast("array<bigint>"))


def _kept(grams: Column, width: int) -> Column:
    """Least hash of every ``width`` neighbouring grams, each once."""
    return F.when(
        F.size(grams) >= width,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - (width - 1)), lambda i: F.array_min(F.slice(grams, i, width)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _windows(ws: Column, window: int, gram: int, lengths: list[int]) -> Column:
    """(p, h, need, span) of every window: its first place, kept hash, number of words and words."""

    def listed(hashes: Column, need: int) -> Column:
        return F.transform(hashes, lambda h, i: F.struct(
            i.alias("p"), h.alias("h"), F.lit(need).alias("need"), F.array_join(F.slice(ws, i + 1, need), " ").alias("span")
        ))

    grams = F.col("g")
    least = F.when(
        F.size(grams) > window - gram,
        F.transform(F.sequence(F.lit(1), F.size(grams) - (window - gram)), lambda i: F.array_min(F.slice(grams, i, window - gram + 1))),
    ).otherwise(F.array().cast("array<bigint>"))
    return F.concat(listed(least, window), *[listed(_grams(ws, m), m) for m in lengths])


def item_index(items: DataFrame, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """Windows of the items, each once (h, span, item_id), and the lengths of short items."""
    listed = materialize(items.select("item_id", words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct(), "items")
    lengths = [r["n"] for r in listed.select(F.size("iw").alias("n")).where(F.col("n") < window).distinct().collect()]  # < window numbers
    with_grams = listed.withColumn("g", _grams(F.col("iw"), gram))
    # A short item has one window, that of its own length; a longer one only windows of full length.
    spans = with_grams.select("item_id", F.size("iw").alias("n"), F.explode(_windows(F.col("iw"), window, gram, lengths)).alias("w"))
    index = spans.where(F.least("n", F.lit(window)) == F.col("w.need")).select("w.h", "w.span", "item_id").distinct()
    return materialize(index, "index"), sorted(lengths)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(every row: _id, _th, n_words; rows of hit documents: _id, _th, n_hit, n_items, item_ids).

    The keys are those of ``common.row_key``; the first table has one row per document row.
    """
    index, lengths = item_index(items, window, gram)
    hashes = index.select("h").distinct().withColumn("hit", F.lit(True))
    size = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("span") + F.octet_length(F.col("item_id").cast("string"))), F.lit(0)).alias("b")).first()
    if size["n"] * 24 <= BROADCAST_BYTES:  # a hash and its mark
        hashes = F.broadcast(hashes)
    if size["n"] * 64 + size["b"] <= BROADCAST_BYTES:
        index = F.broadcast(index)
    keyed = docs.select(*row_key(F.col("doc_id"), F.col("text")), words(F.col("text")).alias("dw"))
    with_grams = keyed.withColumn("g", _grams(F.col("dw"), gram))
    kept = F.concat(_kept(F.col("g"), window - gram + 1), *[F.array_distinct(_grams(F.col("dw"), m)) for m in lengths])
    seen = materialize(
        with_grams.select("_id", "_th", F.size("dw").alias("n_words"), F.posexplode_outer(kept).alias("at", "h"))
        .join(hashes, "h", "left")
        .groupBy("_id", "_th")
        .agg(
            F.max("n_words").alias("n_words"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"),
            F.count_if(F.col("at").isNull() | (F.col("at") == 0)).alias("copies"),
        ), "seen",
    )
    suspects = seen.where("hit").select(F.col("_id").alias("_sid"), F.col("_th").alias("_sth"))
    texts = (
        docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")
        .join(suspects, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_th") == F.col("_sth")))
        .dropDuplicates(["_id", "_th"]).select("_id", "_th", words(F.col("text")).alias("dw"))
        .withColumn("g", _grams(F.col("dw"), gram))
    )
    spots = texts.select("_id", "_th", F.explode(_windows(F.col("dw"), window, gram, lengths)).alias("w")).select("_id", "_th", "w.*")
    found = (
        spots.join(index, ["h", "span"])
        .groupBy("_id", "_th")
        .agg(
            F.collect_set(F.struct("p", "need")).alias("at"),
            F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
        )
        .select(
            "_id", "_th",
            F.size(F.array_distinct(F.flatten(F.transform("at", lambda w: F.sequence(w["p"], w["p"] + w["need"] - 1))))).alias("n_hit"),
            F.size("item_ids").alias("n_items"), "item_ids",
        )
    )
    rows = seen.select("_id", "_th", "n_words", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
    return rows, found


def measure(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated: one row per document row."""
    rows, found = contamination(docs, items, window, gram)
    found = found.withColumnsRenamed({"_id": "_sid", "_th": "_sth"})
    return rows.join(
        found, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_th") == F.col("_sth")), "left"
    ).select(
        F.col("_id").alias("doc_id"), F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, all columns, without the contaminated documents."""
    _, found = contamination(docs, items, window, gram)
    found = found.select(F.col("_id").alias("_sid"), F.col("_th").alias("_sth"))
    keyed = docs.select(packed(docs), *row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(
        found, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_th") == F.col("_sth")), "left_anti"
    ).select("_row.*")
