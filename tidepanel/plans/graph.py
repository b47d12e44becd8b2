"""A graph of stored tables, each of which carries the fingerprints of what it was made from.

Raw sources are files. A derived table is stored below a digest of its name and of the fingerprints of
its inputs, with a manifest of its own fingerprint and theirs. So a run that finds its inputs unchanged
reads what is stored, one with a changed input derives anew what depends on it and nothing else, and neither
ever overwrites the other. The manifest is written last: a table without one was never finished.

Fingerprints are order-free row counts with hash sums (``quality.frame_fingerprint``); one small row of each
reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.operators.quality import frame_fingerprint

_MANIFEST = "name string, fingerprint string, inputs map<string,string>"


def fingerprint_text(df: DataFrame) -> str:
    row = frame_fingerprint(df).first()
    return f"{row['row_count']}:{row['hash_sum']}:{row['hash_xor']}"


@dataclass
class TableGraph:
    """Sources and derived tables below one folder that all executors reach."""

    spark: SparkSession
    root: str
    fingerprints: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    made_from: dict[str, dict[str, str]] = field(default_factory=dict)
    reused: set[str] = field(default_factory=set)

    def source(self, name: str, path: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
        """A raw source: the lines of its files give its fingerprint, ``read`` its table."""
        self.fingerprints[name] = fingerprint_text(self.spark.read.text(path).select("value"))
        self.tables[name] = read(self.spark, path)
        return self.tables[name]

    def derive(self, name: str, inputs: list[str], make: Callable[..., DataFrame]) -> DataFrame:
        """``make(*inputs)``, stored, or what an earlier run stored for the same inputs."""
        from_ = {i: self.fingerprints[i] for i in inputs}
        digest = hashlib.sha256(repr((name, sorted(from_.items()))).encode()).hexdigest()[:24]
        path = f"{self.root}/{name}-{digest}"
        recorded = self._manifest(path)
        if recorded is None:
            make(*(self.tables[i] for i in inputs)).write.mode("overwrite").parquet(f"{path}/data")
        else:
            self.reused.add(name)
        stored = self.spark.read.parquet(f"{path}/data")
        own = fingerprint_text(stored)
        if recorded is None:
            marks = F.create_map(*[F.lit(x) for pair in from_.items() for x in pair])
            row = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(own).alias("fingerprint"), marks.alias("inputs"))
            row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
        elif recorded["fingerprint"] != own:
            raise ValueError(f"stored table {name} is not what its manifest says: {path}")
        self.fingerprints[name], self.tables[name], self.made_from[name] = own, stored, from_
        return stored

    def _manifest(self, path: str):
        try:
            return self.spark.read.schema(_MANIFEST).json(f"{path}/manifest").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def provenance(self, after: TableGraph | None = None) -> DataFrame:
        """One row per derived table and input: rows of the input, and how a later run found it.

        ``input_changed``: its fingerprint is another one now; ``derived_again``: the later run stored the table anew.
        """
        later = after or self
        rows = [
            (name, i, int(mark.split(":")[0]), later.fingerprints[i] != mark, name not in later.reused)
            for name, inputs in self.made_from.items() for i, mark in inputs.items()
        ]
        return self.spark.createDataFrame(rows, "table_name string, input string, input_rows bigint, input_changed boolean, derived_again boolean")
