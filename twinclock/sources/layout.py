"""A version table on plain Parquet, partitioned by the year a version ended, plus CURRENT.

``<path>/versions/end_year=CURRENT|1998|.../`` holds rows with row_start and row_end. Retention is recorded
first as a floor, an empty folder ``<path>/floors/<instant>``, that every reader applies; the clean-up of files may
follow later. A table object lists its files and reads their schema once; ``refresh`` looks again after another writer.
"""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinclock.operators import systime as D
from twinclock.schema import ntz, system_max

CURRENT = "CURRENT"


def end_bucket(granularity: str = "year") -> Column:
    text = F.date_format(F.to_date("row_end"), "yyyy" if granularity == "year" else "yyyy-MM")
    return F.when(F.col("row_end") == system_max(), CURRENT).otherwise(text)


class VersionTable:
    def __init__(self, spark: SparkSession, path: str, granularity: str = "year"):
        if granularity not in ("none", "year", "month"):
            raise ValueError("granularity is none, year or month")
        self.spark, self.path, self.granularity = spark, path.rstrip("/"), granularity
        self._data, self._floors = f"{self.path}/versions", f"{self.path}/floors"
        self._known: DataFrame | None = None

    def refresh(self) -> None:
        self._known = None

    def append(self, versions: DataFrame) -> None:
        """Add rows with their own row_start and row_end.

        The rebalance cuts a large partition (CURRENT, a busy year) into files of the advisory size and
        merges small ones. Files are sorted by row_start, so their footers prune AS OF reads on the lower
        bound as well.
        """
        if self.granularity == "none":
            versions.hint("rebalance").sortWithinPartitions("row_start").write.mode("append").parquet(self._data)
            self.refresh()
            return
        (versions.withColumn("end_year", end_bucket(self.granularity)).hint("rebalance", "end_year")
         .sortWithinPartitions("end_year", "row_start")
         .write.mode("append").partitionBy("end_year").parquet(self._data))
        self.refresh()

    def _raw(self) -> DataFrame:
        """All files, those below the retention floor included."""
        if self._known is None:
            df = self.spark.read.parquet(self._data)
            self._known = df if "end_year" not in df.columns else df.withColumn("end_year", F.col("end_year").cast("string"))
        return self._known

    def _floor(self) -> str | None:
        """Newest retention floor: one folder per retention call."""
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path(self._floors)
        if not fs.exists(path):
            return None
        names = [str(f.getPath().getName()) for f in fs.listStatus(path)]
        return max((n.replace("T", " ").replace("_", ":") for n in names if n[:1].isdigit()), default=None)

    def _kept(self, ended_after=None) -> DataFrame:
        """Rows above the floor, and that ended after an instant, reading only the partitions that can hold them."""
        df, floor = self._raw(), self._floor()
        if floor is not None:
            df = df.filter(F.col("row_end") >= ntz(floor))
        bounds = [str(b) for b in (floor, ended_after) if b is not None]
        if bounds and "end_year" in df.columns:
            width = 4 if self.granularity == "year" else 7
            # digits sort before letters, so CURRENT always passes
            df = df.filter(F.col("end_year") >= max(bounds)[:width])
        return df

    def _read(self, ended_after=None) -> DataFrame:
        return self._kept(ended_after).drop("end_year")

    def all(self) -> DataFrame:
        return self._read()

    def current(self) -> DataFrame:
        if self.granularity == "none":
            return D.current(self._read())
        return self._raw().filter(F.col("end_year") == CURRENT).drop("end_year")

    def as_of(self, s) -> DataFrame:
        return D.as_of(self._read(s), s)

    def between(self, a, b) -> DataFrame:
        return D.between(self._read(a), a, b)

    def from_to(self, a, b) -> DataFrame:
        return D.from_to(self._read(a), a, b)

    def partition(self, name: str) -> DataFrame:
        return self._kept().filter(F.col("end_year") == name).drop("end_year")

    def partition_counts(self, size: str) -> DataFrame:
        return self._kept().groupBy("end_year").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))

    def retain_since(self, cutoff) -> None:
        """Versions that ended before ``cutoff`` disappear for readers at once."""
        jvm, fs = self._fs()
        instant = str(cutoff).replace(" ", "T").replace(":", "_")
        if not fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self._floors}/{instant}")):
            raise OSError(f"the retention floor {cutoff} could not be written")

    def drop_years_before(self, year: int) -> None:
        """Retention by whole year partitions; CURRENT is never among them."""
        self.retain_since(f"{year}-01-01 00:00:00")
        self._delete([y for y in self._closed_years() if y < f"{year}"])

    def clean_up(self) -> None:
        """Remove the files below the floor: whole partitions, then the part of the one it cuts through.

        The kept rows are written beside the table before their partition is replaced; a run that was
        interrupted there is finished by the next one.
        """
        floor = self._floor()
        if floor is None or self.granularity == "none":
            return
        edge = floor[:4 if self.granularity == "year" else 7]
        parked = f"{self.path}/kept-{edge}-{floor.replace(' ', 'T').replace(':', '')}"
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        self._delete([y for y in self._closed_years() if y < edge])
        if not fs.exists(path(f"{parked}/_SUCCESS")):
            if edge not in self._closed_years():
                return
            kept = self._raw().filter((F.col("end_year") == edge) & (F.col("row_end") >= ntz(floor)))
            kept.drop("end_year").write.mode("overwrite").parquet(parked)
        self._delete([edge])
        if not fs.rename(path(parked), path(f"{self._data}/end_year={edge}")):
            raise OSError(f"{parked} could not be moved into the table; it holds the rows of {edge} that stay")
        self.refresh()

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self._data)
        return jvm, path.getFileSystem(conf)

    def _closed_years(self) -> list[str]:
        """Names of the closed partitions: one per year or month of history."""
        jvm, fs = self._fs()
        names = [urlparse(str(s.getPath())).path.rsplit("/", 1)[-1]
                 for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self._data))]
        years = [n.split("=", 1)[1] for n in names if n.startswith("end_year=")]
        return sorted(y for y in years if y != CURRENT)

    def _delete(self, names: list[str]) -> None:
        jvm, fs = self._fs()
        for n in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self._data}/end_year={n}")
            if not fs.delete(path, True) and fs.exists(path):
                raise OSError(f"{path} could not be removed")
        self.refresh()
