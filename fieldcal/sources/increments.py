"""Tables derived year by year: a manifest of what is done, so that a rerun works only on years whose source changed.

A store is one folder: ``parts/version=N`` holds the years built by update N, ``manifest`` one row per year and update. Parts are never
overwritten. An update writes its parts first and its manifest rows last, in one small file, so an update that fails half way leaves the
store as it was, readers see whole updates only, and a rerun starts a new version. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "year int, version int, live boolean, n long, total decimal(38,0), mixed long"


def fingerprints(source: DataFrame) -> DataFrame:
    """Number of rows and two order-free sums of row hashes of each year; rows without a year count as one more year (null).

    Rows are combined on the map side, whatever the size of a year. Repeated rows count: the first sum tells them apart.
    """
    row = F.xxhash64(*[F.col(c) for c in sorted(source.columns)], *[F.col(c).isNull() for c in sorted(source.columns)])
    hashed = source.select("year", row.alias("_row"))
    return hashed.groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count("*").alias("n"), F.sum(F.col("_row").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"),
        F.bit_xor(F.xxhash64("_row")).alias("mixed"))


class YearStore:
    """A derived table kept by year. ``build`` turns source rows of whole years into result rows with a column ``year``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        """The newest entry of each year: year, version, live, n, total, mixed."""
        try:
            entries = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)
        newest = F.max_by(F.struct(*[F.col(c) for c in entries.columns]), "version").alias("entry")
        return entries.groupBy("year").agg(newest).select("entry.*")

    def update(self, source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> dict[str, list[int | None]]:
        """Bring the store in step with ``source``: years that are new or changed are built, years that are gone are withdrawn, the rest
        is not touched. Returns the years of each kind. Only years and their fingerprints reach the driver, a row per year.
        """
        known = {r.year: r for r in self.manifest().collect()}
        now = {r.year: r for r in fingerprints(source).collect()}
        same = lambda a, b: (a.n, a.total, a.mixed) == (b.n, b.total, b.mixed)
        order = lambda years: sorted(years, key=lambda y: (y is None, y))
        built = order(y for y, r in now.items() if y not in known or not known[y].live or not same(known[y], r))
        gone = order(y for y, r in known.items() if r.live and y not in now)
        if not built and not gone:
            return {"built": [], "withdrawn": []}
        version = max((r.version for r in known.values()), default=0) + 1
        if built:
            wanted = F.col("year").isin([y for y in built if y is not None])
            if None in built:
                wanted = wanted | F.col("year").isNull()
            parts = build(source.filter(wanted))
            # a version that an earlier, failed update began has no manifest row and is replaced
            parts.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/parts/version={version}")
        entries = [(y, version, True, now[y].n, now[y].total, now[y].mixed) for y in built]
        entries += [(y, version, False, 0, None, None) for y in gone]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return {"built": built, "withdrawn": gone}

    def read(self) -> DataFrame:
        """The current rows, with the version each year was built in. Superseded rows are left out by a small join on (year, version),
        versions without a live year are not read."""
        live = [r for r in self.manifest().collect() if r.live]
        if not live:
            raise ValueError(f"{self.path} holds no year")
        paths = sorted({f"{self.path}/parts/version={r.version}" for r in live})
        parts = self.spark.read.option("basePath", f"{self.path}/parts").parquet(*paths)
        current = F.lit(False)
        for version in sorted({r.version for r in live}):
            years = [r.year for r in live if r.version == version]
            rule = F.col("year").isin([y for y in years if y is not None])
            if None in years:
                rule = F.coalesce(rule, F.lit(False)) | F.col("year").isNull()
            current = current | ((F.col("version") == version) & rule)
        return parts.filter(current)
