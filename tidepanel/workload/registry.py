"""Query registration: one column list serves the Spark result and the DuckDB counterpart.

Column items are ``name`` or ``kind:name`` with kinds t (instant as text with milliseconds), day
(date as text), d (double, 8 decimals) and i (bigint).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.session import apply_runtime_conf
from tidepanel.workload.views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Item:
    kind: str
    name: str


def _items(columns: str) -> list[Item]:
    parts = [c.split(":") for c in columns.split()]
    return [Item(p[0] if len(p) == 2 else "", p[-1]) for p in parts]


def present(df: DataFrame, columns: str) -> DataFrame:
    """Project to plain comparable types."""
    out = []
    for item in _items(columns):
        col = F.col(item.name)
        if item.kind == "t":
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSS")
        elif item.kind == "day":
            col = F.date_format(col, "yyyy-MM-dd")
        elif item.kind == "d":
            # Adding zero turns a rounded negative zero into zero.
            col = F.round(col.cast("double"), 8) + F.lit(0.0)
        elif item.kind == "i":
            col = col.cast("bigint")
        out.append(col.alias(item.name))
    return df.select(*out)


def _sql_item(item: Item) -> str:
    n = item.name
    return {
        "t": f"strftime({n}, '%Y-%m-%d %H:%M:%S.%g') AS {n}",
        "day": f"strftime({n}, '%Y-%m-%d') AS {n}",
        "d": f"round(CAST({n} AS DOUBLE), 8) + 0.0 AS {n}",
        "i": f"CAST({n} AS BIGINT) AS {n}",
        "": n,
    }[item.kind]


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Prefix a query with the named views and everything they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        needs, _ = SQL_VIEWS[name]
        for need in needs.split():
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    clauses = ", ".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in ordered)
    if not clauses:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{clauses} {body}"


def query(
    name: str, columns: str, sql: str | None = None, needs: str = "", recursive: bool = False
) -> Callable:
    """Register ``fn(views) -> DataFrame`` under a name, with its oracle if there is one."""

    def decorate(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Views(apply_runtime_conf(spark), sf_dir)), columns)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            selected = ", ".join(_sql_item(i) for i in _items(columns))
            ORACLES[name] = with_views(needs, f"SELECT {selected} FROM ({sql})", recursive)
        return fn

    return decorate
