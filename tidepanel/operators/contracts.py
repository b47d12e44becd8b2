"""Bar contracts: row rules as boolean columns, violations as rows, metrics in one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.identity import is_token
from tidepanel.functions.timefn import MICROS, micros
from tidepanel.schemas import BAR_SCHEMA, require_columns

_PRICES = ["open", "high", "low", "close"]
_VOLUMES = [
    "base_volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume", "trade_count",
]
_KEY = ["symbol", "open_time"]


class ContractViolation(ValueError):
    """A strict check found rows that break the contract."""


@dataclass(frozen=True)
class Checked:
    """Outcome of a contract check; all three are lazy."""

    valid: DataFrame
    violations: DataFrame
    metrics: DataFrame

    def require(self) -> DataFrame:
        """Run the metrics job and raise if any rule is broken; returns the rows otherwise."""
        counts = self.metrics.first().asDict()
        broken = {k: v for k, v in counts.items() if k != "row_count" and v}
        if broken:
            raise ContractViolation(f"bar contract violated: {broken}")
        return self.valid


def bar_rules(interval_seconds: int = 3600) -> dict[str, Column]:
    """Row rules, TRUE where the row breaks the rule."""
    step = interval_seconds * MICROS
    opened, closed = micros(F.col("open_time")), micros(F.col("close_time"))

    def broken(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    finite = F.lit(True)
    for name in [*_PRICES, *_VOLUMES]:
        value = F.col(name).cast("double")
        finite = finite & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    positive, ordered, nonnegative = F.lit(True), F.lit(True), F.lit(True)
    for name in _PRICES:
        positive = positive & (F.col(name) > 0)
        ordered = ordered & (F.col("high") >= F.col(name)) & (F.col("low") <= F.col(name))
    for name in _VOLUMES:
        nonnegative = nonnegative & (F.col(name) >= 0)
    return {
        "bad_symbol": ~is_token(F.col("symbol")),
        "unaligned_open": broken(F.pmod(opened, F.lit(step)) == 0),
        "wrong_close_time": broken(closed == opened + F.lit(step - 1000)),
        "not_finite": ~finite,
        "price_not_positive": broken(positive),
        "bad_price_order": broken(ordered),
        "negative_volume": broken(nonnegative),
    }


def duplicate_keys(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys held by more than one row, from a map-side combined count."""
    keys = keys or _KEY
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    return counted.filter("key_rows > 1")


def validate_bars(bars: DataFrame, interval_seconds: int = 3600) -> Checked:
    """Check normalized bars. Physical row order is no property of a table, keys are."""
    require_columns(bars, BAR_SCHEMA.fieldNames(), "bars")
    rules = bar_rules(interval_seconds)
    # Duplicate keys are rare, so the joined side is tiny and AQE broadcasts it after measuring.
    flagged = bars.join(
        duplicate_keys(bars).select(*_KEY, F.lit(True).alias("__dup")), _KEY, "left"
    ).withColumn(
        "__broken",
        F.array_compact(
            F.array(
                F.when(F.col("__dup"), F.lit("duplicate_key")),
                *[F.when(rule, F.lit(name)) for name, rule in rules.items()],
            )
        ),
    )
    valid = flagged.filter(F.size("__broken") == 0).select(*bars.columns)
    violations = flagged.filter(F.size("__broken") > 0).select(
        *bars.columns, F.explode("__broken").alias("rule")
    )
    return Checked(valid, violations, _bar_metrics(bars, rules))


def _bar_metrics(bars: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows and broken rules in one narrow exchange: counts by key, combined on the map side, then their sums."""
    keyed = F.lit(True)
    for key in _KEY:
        keyed = keyed & F.col(key).isNotNull()
    per_key = bars.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(rule).alias(name) for name, rule in rules.items()]
    )
    repeated = F.when(keyed & (F.col("__n") > 1), F.col("__n"))
    return per_key.agg(
        *[
            F.coalesce(F.sum(count), F.lit(0)).alias(name)
            for name, count in {"row_count": F.col("__n"), "duplicate_key": repeated, **{n: F.col(n) for n in rules}}.items()
        ]
    )


def validate_canonical(
    bars: DataFrame, cutoff: Column, planned_sources: DataFrame, interval_seconds: int = 3600
) -> DataFrame:
    """One row of canonical-layer checks: contract, non-empty, before the cutoff, planned lineage."""
    require_columns(bars, ["source_key", "source_sha256"], "canonical bars")
    limit = F.date_trunc("hour", cutoff)
    late = (F.col("open_time") >= limit) | (F.col("close_time") >= limit)
    cited = bars.groupBy("source_key").agg(F.count(F.lit(1)).alias("__rows"), F.count_if(late).alias("__late"))
    planned = planned_sources.select("source_key", F.lit(True).alias("__planned")).dropDuplicates(["source_key"])
    by_source = cited.join(planned, "source_key", "left").agg(
        F.coalesce(F.sum("__late"), F.lit(0)).alias("rows_after_cutoff"),
        F.coalesce(F.sum(F.when(F.col("__planned").isNull(), F.col("__rows"))), F.lit(0)).alias("rows_from_unplanned_source"),
    )
    # Both sides are single aggregate rows, so this cross join never grows with the data.
    one_row = validate_bars(bars, interval_seconds).metrics.join(F.broadcast(by_source))
    passed = F.col("row_count") > 0
    for name in one_row.columns:
        if name != "row_count":
            passed = passed & (F.col(name) == 0)
    return one_row.withColumn("passed", passed)


def source_containment(bars: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows outside the half-open range of the source they cite, or citing none that is planned."""
    ranges = sources.select("source_key", "range_start", "range_end")
    inside = (F.col("open_time") >= F.col("range_start")) & (F.col("open_time") < F.col("range_end"))
    return bars.join(ranges, "source_key", "left").filter(~F.coalesce(inside, F.lit(False)))


def quality_manifest(bars: DataFrame) -> DataFrame:
    """Per source: rows, first open, last close, duplicate keys (rows beyond the first per key)."""
    per_key = bars.groupBy("source_key", *_KEY).agg(
        F.count(F.lit(1)).alias("__n"), F.max("close_time").alias("__close")
    )
    return per_key.groupBy("source_key").agg(
        F.sum("__n").alias("row_count"),
        F.min("open_time").alias("first_open_time"),
        F.max("__close").alias("last_close_time"),
        F.sum(F.col("__n") - 1).alias("duplicate_key_count"),
    )


def require_many_to_one(lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Raise when a lookup side has duplicate keys; returns it otherwise (one small job)."""
    if not duplicate_keys(lookup, keys).isEmpty():
        raise ContractViolation(f"lookup has duplicate {keys}")
    return lookup


def lookup_many_to_one(df: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with enforced cardinality; Spark chooses the join by the measured lookup size."""
    return df.join(require_many_to_one(lookup, keys), keys, "left")
