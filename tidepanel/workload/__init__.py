"""Registered queries over the supplied tables, each with its DuckDB counterpart."""

from tidepanel.workload import catalog, core, evidence, lifecycle, pipeline, slices, stages  # noqa: F401
from tidepanel.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
