"""The flagship plan: make weights once, write them, and apply them to any number of fields, levels and variables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from graticula.operators import interpolation, sparse
from graticula.sources.records import scratch


@dataclass
class Remap:
    """weights: (row, col, w); rows: all targets (row). Fields have gidx and value, and any further keys."""

    weights: DataFrame
    rows: DataFrame | None = None
    marker: float = 9999.0

    @classmethod
    def by(cls, name: str, *args, rows: DataFrame | None = None, **options) -> Remap:
        return cls(interpolation.method(name)(*args, **options), rows)

    def stored(self, path: str | None = None) -> Remap:
        """The same with its weights written as a table and read again, so that they are made once."""
        spark: SparkSession = self.weights.sparkSession
        path = path or scratch(spark, "weights")
        self.weights.write.mode("overwrite").parquet(path)
        return Remap(spark.read.parquet(path), self.rows, self.marker)

    def execute(self, field: DataFrame, by: tuple[str, ...] = (), missing: Column | None = None, policy: str = "missing-if-all-missing") -> DataFrame:
        if missing is not None:
            return sparse.apply_missing(self.weights, field, missing, policy, self.marker, by)
        out = sparse.apply(self.weights, field, by)
        return sparse.with_failed(out, self.rows, self.marker) if self.rows is not None and not by else out

    def execute_adjoint(self, field: DataFrame) -> DataFrame:
        return sparse.adjoint(self.weights, field)
