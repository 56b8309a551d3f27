"""Checks of a table in the pass that uses it: metrics are observed while the rows stream on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldcal.sources.tables import COORDINATE_RANGES


class ScanChecks:
    """Rules of a scan, and what they found once an action over its rows has ended.

    ``rows``: rows read; ``bad_c``: rows outside the range of column c; ``null_c``: rows without it; ``kept``: rows that go on;
    ``duplicates``: rows whose key came before. With ``drop`` rows outside a range go no further. With ``keys`` one row of each key stays,
    the smallest in all its columns, so reruns agree; rows are combined per task before the shuffle, so a key that holds a large
    share of all rows is no burden. A row counts once for each time its task's result is used: an executor lost after its shuffle
    files were written may have its rows counted again.
    """

    def __init__(self, ranges: dict[str, tuple[float, float]] | None = None, keys: Sequence[str] = (), drop: bool = False) -> None:
        self.ranges, self.keys, self.drop = dict(COORDINATE_RANGES if ranges is None else ranges), list(keys), drop
        self._read, self._kept = Observation(), Observation()
        self._valid = Observation()

    def _outside(self, column: str) -> Column:
        return ~F.col(column).between(*self.ranges[column])

    def watch(self, df: DataFrame) -> DataFrame:
        """``df`` with the checks in its plan. One use per object."""
        missing = [c for c in [*self.ranges, *self.keys] if c not in df.columns]
        if missing:
            raise ValueError(f"the table lacks the columns {missing}")
        counts = [F.count_if(self._outside(c)).alias(f"bad_{c}") for c in self.ranges]
        counts += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in dict.fromkeys([*self.ranges, *self.keys])]
        out = df.observe(self._read, F.count(F.lit(1)).alias("rows"), *counts)
        if self.drop:
            for c in self.ranges:
                out = out.filter(F.coalesce(~self._outside(c), F.lit(False)))
        out = out.observe(self._valid, F.count(F.lit(1)).alias("valid"))
        if self.keys:
            rest = [c for c in df.columns if c not in self.keys]
            least = F.min(F.struct(*[F.col(c) for c in rest])).alias("_rest") if rest else F.count(F.lit(1)).alias("_rest")
            out = out.groupBy(*self.keys).agg(least)
            out = out.select(*[F.col(c) if c in self.keys else F.col(f"_rest.{c}").alias(c) for c in df.columns])
        return out.observe(self._kept, F.count(F.lit(1)).alias("kept"))

    def metrics(self) -> dict[str, int]:
        """The counts; waits for the first action over the watched rows."""
        found = dict(self._read.get) | dict(self._valid.get) | dict(self._kept.get)
        valid = found.pop("valid")
        return found | {"duplicates": valid - found["kept"]}

    def report(self, spark: SparkSession) -> DataFrame:
        """The metrics as rows (metric, value)."""
        return spark.createDataFrame(sorted(self.metrics().items()), "metric string, value long")
