"""Cross-site boilerplate: lines spread over many sites are kept once and removed elsewhere.

Built-in functions only. Each line (trimmed of spaces, empty ones ignored) gets a HyperLogLog sketch
of the sites that show it; sketches merge as partial aggregates, so a line that stands in a third
of all documents costs one sketch per task. A line clearly above or below ``sites`` distinct sites
is decided by its sketch; one within ``margin`` of it gets an exact distinct count. Spread lines stay
at their first place (smallest doc_id, then position) so that what a copied text says is kept once.

Lines are compared by two independent 64-bit hashes. Rows that share id and text are treated alike. A
null text has no lines and stays null, a null site counts as the empty site, a null doc_id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.common import materialize, packed, row_key

SITES = 10
MARGIN = 0.25


def _lines(text: Column) -> Column:
    return F.split(text, F.lit("\n"), -1)


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """One narrow row per non-empty line: hashes, site and place; no text."""
    rows = docs.select(
        *row_key(F.col("doc_id"), F.col("text")), F.coalesce(F.col(site), F.lit("")).alias("site"),
        F.posexplode(_lines(F.col("text"))).alias("pos", "raw"),
    ).withColumn("line", F.trim("raw"))
    return rows.where("line != ''").select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "site", "_id", "_th", "pos"
    )


def spread_lines(lines: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """Hashes of the lines on ``sites`` or more distinct sites, with their first place."""
    sketched = (
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site")).alias("spread"),
            F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_th", "pos")).alias("first"),
        )
        .where((F.col("n") >= sites) & (F.col("spread") >= sites * (1 - margin)))
    )
    sketched = materialize(sketched, "spread")
    clear = F.col("spread") > sites * (1 + margin)
    near = sketched.where(~clear)
    exact = (
        lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").count().where(F.col("count") >= sites)
    )
    return sketched.where(clear).select("h1", "h2", "first").unionByName(
        near.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first")
    )


def drop_spread_lines(docs: DataFrame, site: str = "source", sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """All rows and columns of ``docs`` with the text rewritten, plus ``n_lines`` and ``n_removed``.

    Texts without removed lines stay as they are. Columns called n_lines or n_removed are replaced,
    others pass through whatever their names.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = materialize(line_table(docs, site), "lines")
    spread = spread_lines(lines, sites, margin)
    removed = (
        lines.join(spread, ["h1", "h2"])
        .where(F.struct("_id", "_th", "pos") != F.col("first"))
        .groupBy("_id", "_th").agg(F.collect_set("pos").alias("_removed"))
    )
    keyed = docs.select(packed(docs), F.col("text").alias("_text"), *row_key(F.col("doc_id"), F.col("text")))
    joined = keyed.join(
        removed.withColumnsRenamed({"_id": "_rid", "_th": "_rth"}),
        F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth")), "left",
    )
    pieces = _lines(F.col("_text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("_removed"))
    rewritten = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(
        F.concat_ws("\n", F.transform(kept, lambda p: F.get(pieces, p)))
    )
    return joined.select(
        *[rewritten.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(pieces)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
