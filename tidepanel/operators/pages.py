"""Pagination checks over saved listing and tail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel import fixed_values as fv
from tidepanel.functions.identity import is_symbol_identity
from tidepanel.functions.keys import url_parameter
from tidepanel.functions.timefn import MICROS, micros


def request_fields(pages: DataFrame) -> DataFrame:
    """Prefix, delimiter and continuation token of each page's request URL."""
    return pages.withColumns(
        {
            "request_prefix": url_parameter(F.col("url"), "prefix"),
            "request_delimiter": url_parameter(F.col("url"), "delimiter"),
            "request_token": url_parameter(F.col("url"), "continuation-token"),
        }
    )


def page_chain_findings(pages: DataFrame, group: list[str]) -> DataFrame:
    """Breaks in the chain of pages of every listing group; must be empty.

    ``pages`` has the group columns and (page, truncated, next_token, request_token, entry_count,
    declared_count). Pages of one listing are numbered 1..n; each asks with the token the previous
    one returned; only the last is not truncated. Repeated tokens are counted by a map-side
    combined aggregate, not by a window.
    """
    order = Window.partitionBy(*group).orderBy("page")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    usable = F.length(F.trim(F.coalesce("next_token", F.lit("")))) > 0
    linked = pages.withColumns(
        {
            "__rn": F.row_number().over(order),
            "__expected": F.lag(F.when(F.col("truncated"), F.col("next_token")), 1).over(order),
            "__prev_truncated": F.lag("truncated", 1).over(order),
            "__last": F.max("page").over(whole),
        }
    )
    repeats = (
        pages.filter(F.col("truncated") & F.col("next_token").isNotNull())
        .groupBy(*group, "next_token")
        .agg(F.count(F.lit(1)).alias("__uses"))
        .filter("__uses > 1")
    )
    joined = linked.join(repeats, [*group, "next_token"], "left")
    findings = F.array_compact(
        F.array(
            F.when(F.col("page") != F.col("__rn"), F.lit("page_missing")),
            F.when(~F.col("request_token").eqNullSafe(F.col("__expected")), F.lit("chain_broken")),
            F.when(F.col("truncated") & ~usable, F.lit("truncated_without_token")),
            F.when(~F.col("truncated") & usable, F.lit("terminal_with_token")),
            F.when(F.col("__prev_truncated") == F.lit(False), F.lit("page_after_terminal")),
            F.when((F.col("page") == F.col("__last")) & F.col("truncated"), F.lit("no_terminal_page")),
            F.when(F.col("__uses") > 1, F.lit("token_repeated")),
            F.when(
                ~F.col("declared_count").eqNullSafe(F.col("entry_count")), F.lit("count_disagrees")
            ),
        )
    )
    return joined.select(*group, "page", F.explode(findings).alias("finding"))


def page_suffix_findings(rows: DataFrame, pages: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Tail pages whose rows are not the exact contiguous hours of their request window.

    ``rows`` has (page_key, open_time), ``pages`` (page_key, page_start, page_end). Counting exact
    hits, distinct hits and strays decides equality with the expected sequence without building it.
    """
    step = step_seconds * MICROS
    start, end = micros(F.col("page_start")), micros(F.col("page_end"))
    at = micros(F.col("open_time"))
    per_open = rows.groupBy("page_key", "open_time").agg(F.count(F.lit(1)).alias("__n"))
    on_grid = (at >= start) & (at < end) & (F.pmod(at - start, F.lit(step)) == 0)
    held = pages.join(per_open, "page_key", "left").groupBy("page_key", "page_start", "page_end").agg(
        F.count_if(on_grid).alias("matched"),
        F.count_if(F.col("open_time").isNotNull() & ~on_grid).alias("outside"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("repeated"),
    )
    expected = ((end - start) / F.lit(step)).cast("bigint")
    return held.withColumn("missing", expected - F.col("matched")).filter(
        "missing > 0 OR outside > 0 OR repeated > 0"
    ).select("page_key", "missing", "outside", "repeated")


def listing_group_findings(pages: DataFrame, root: str = fv.DAILY_BAR_ROOT) -> DataFrame:
    """Root listing and per-symbol listings must match one to one.

    ``pages`` has (sequence, prefix, delimiter, prefixes array, keys array).
    """
    is_root = (F.col("prefix") == root) & F.col("delimiter").eqNullSafe(F.lit("/"))
    roots = pages.filter(is_root)
    symbol = F.regexp_replace(
        F.expr(f"substring(found, {len(root) + 1})"), "/$", ""
    )
    expected = (
        roots.select(F.explode("prefixes").alias("found"))
        .select(symbol.alias("symbol"))
        .distinct()
        .filter(is_symbol_identity(F.col("symbol")))
        .select(F.concat(F.lit(root), "symbol", F.lit("/1h/")).alias("prefix"), F.lit(True).alias("__wanted"))
    )
    observed = (
        pages.filter(~is_root)
        .groupBy("prefix")
        .agg(
            F.max(F.size("prefixes") > 0).alias("__nested"),
            F.max(F.col("delimiter").isNotNull()).alias("__delimited"),
        )
    )
    both = expected.join(observed, "prefix", "full_outer")
    group_findings = both.select(
        "prefix",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("__nested").isNull(), F.lit("listing_omitted")),
                    F.when(
                        F.col("__wanted").isNull() | F.coalesce("__delimited", F.lit(False)),
                        F.lit("orphan_listing"),
                    ),
                    F.when(F.col("__nested"), F.lit("unexpected_prefixes")),
                )
            )
        ).alias("finding"),
    )
    one = roots.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("k")
    )
    root_findings = one.select(
        F.lit(root).alias("prefix"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("n") == 0, F.lit("root_missing")),
                    F.when(F.col("k") > 0, F.lit("root_holds_objects")),
                )
            )
        ).alias("finding"),
    )
    spread = pages.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sequence").alias("d"),
        F.min("sequence").alias("lo"), F.max("sequence").alias("hi"),
    )
    holes = spread.filter("n != d OR lo != 1 OR hi != n").select(
        F.lit(root).alias("prefix"), F.lit("sequence_incomplete").alias("finding")
    )
    return group_findings.unionByName(root_findings).unionByName(holes)
