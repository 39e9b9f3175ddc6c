"""A mirror that follows its source by batches of changes: open rows are closed and their successors opened.

    versions/end_year=Y/batch_id=N        versions that batch N closed, under the year they ended
    versions/end_year=CURRENT/batch_id=N  versions that batch N opened, and a row marked ``gone`` for each entity it left
                                          without one; every open version, where the commit row says snapshot
    commits/batch_id=N                    the commit row, written last; readers see committed batches only

A batch writes what it changed, not one row per entity. Every ``snapshot_every``-th batch writes all open versions, so a
reader of the current state opens one snapshot and the few batches after it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinclock.operators import systime as D
from twinclock.schema import ntz, system_max
from twinclock.session import materialise
from twinclock.sources.layout import CURRENT, end_bucket

RESERVED = {"row_start", "row_end", "gone", "closed_at", "end_year", "batch_id"}
COMMIT = """through TIMESTAMP_NTZ, snapshot BOOLEAN, changes BIGINT, opened BIGINT, closed BIGINT, gone BIGINT, carried BIGINT,
            batch_id BIGINT"""


class Mirror:
    def __init__(self, spark: SparkSession, path: str, snapshot_every: int = 16):
        if snapshot_every < 1:
            raise ValueError("snapshot_every is at least 1")
        self.spark, self.path, self.snapshot_every = spark, path.rstrip("/"), snapshot_every
        self._data = f"{self.path}/versions"
        self._last: int | None = None
        self._through: datetime | None = None
        self._snapshot = 0

    # -- reading -----------------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        """The commit log: one small row per batch with its counters."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits")

    def refresh(self) -> int:
        """Look up the newest committed batch, its instant and the newest snapshot again."""
        r = self.commits().agg(F.max("batch_id").alias("last"), F.max("through").alias("through"),
                               F.max(F.when(F.col("snapshot"), F.col("batch_id"))).alias("snapshot")).first()
        self._last, self._through, self._snapshot = r["last"] or 0, r["through"], r["snapshot"] or 0
        return self._last

    def current(self) -> DataFrame:
        """The open version of every entity that is not deleted."""
        return self._open().drop("gone")

    def closed(self, ended_after=None) -> DataFrame:
        """Closed versions; with ``ended_after`` only the years that can hold later ends are opened."""
        rows = self._committed().filter(F.col("end_year") != CURRENT)
        if ended_after is not None:
            rows = rows.filter((F.col("end_year") >= str(ended_after)[:4]) & (F.col("row_end") > ntz(ended_after)))
        return rows.drop("end_year", "batch_id", "gone")

    def all(self) -> DataFrame:
        return self.closed().unionByName(self.current())

    def as_of(self, s) -> DataFrame:
        return D.as_of(self.closed(s).unionByName(self.current()), s)

    def _committed(self) -> DataFrame:
        if self._last is None:
            self.refresh()
        if not self._exists("versions"):
            raise ValueError(f"{self.path} holds no versions yet")
        rows = self.spark.read.parquet(self._data)
        return (rows.withColumn("end_year", F.col("end_year").cast("string"))
                .filter(F.col("batch_id") <= self._last))

    def _open(self) -> DataFrame:
        """The newest snapshot without the entities changed since, and the newest row of those."""
        rows = self._committed().filter(F.col("end_year") == CURRENT).drop("end_year")
        kept = [c for c in rows.columns if c != "batch_id"]
        base = rows.filter(F.col("batch_id") == self._snapshot).select(*kept)
        if self._last == self._snapshot:
            return base.filter(~F.col("gone"))
        later = (rows.filter(F.col("batch_id") > self._snapshot).groupBy("entity")
                 .agg(F.max_by(F.struct(*kept), "batch_id").alias("r")).select("r.*"))
        if self._snapshot:
            later = later.unionByName(base.join(later.select("entity"), "entity", "left_anti"))
        return later.filter(~F.col("gone"))

    # -- writing -----------------------------------------------------------------------------------

    def apply(self, batch_id: int, changes: DataFrame, through) -> bool:
        """Apply a batch of changes (entity, rev_id, ts, op, ...), op D for a delete; False if it is committed already.

        A batch holds every change after the instant of the batch before, up to and including ``through``, so that the changes
        of one instant are never split. A change outside, or with a null entity, rev_id, ts or op, is an error and nothing is
        written. An attempt that was interrupted leaves no trace in the next one. A delete of an unknown entity opens nothing.
        """
        if batch_id <= self.refresh():
            return False
        if batch_id != self._last + 1:
            raise ValueError(f"batch {batch_id} does not follow batch {self._last}")
        clash = RESERVED & set(changes.columns)
        if clash:
            raise ValueError(f"columns with names of the mirror: {sorted(clash)}")
        self._remove(batch_id)
        seen = Observation()
        unusable = F.greatest(*[F.col(c).isNull() for c in ("entity", "rev_id", "ts", "op")])
        batch = materialise(changes.observe(seen, F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"),
                                            F.count_if(unusable).alias("unusable")), "changes")
        found = seen.get
        end = datetime.fromisoformat(str(through))
        if self._through is not None and end <= self._through:
            raise ValueError(f"batch {batch_id} ends at {end}, not after {self._through}")
        if found["unusable"]:
            raise ValueError(f"{found['unusable']} changes without entity, rev_id, ts or op")
        if found["n"] and (found["hi"] > end or (self._through is not None and found["lo"] <= self._through)):
            raise ValueError(f"changes from {found['lo']} to {found['hi']} do not lie after {self._through} up to {end}")
        snapshot = batch_id % self.snapshot_every == 0
        wrote = Observation()
        if found["n"] or (snapshot and self._exists("versions")):
            rows = self._changed(batch, snapshot).observe(
                wrote, F.count_if(F.col("how") == "opened").alias("opened"), F.count_if(F.col("how") == "closed").alias("closed"),
                F.count_if(F.col("how") == "gone").alias("gone"), F.count_if(F.col("how") == "carried").alias("carried"))
            (rows.drop("how").withColumns({"end_year": end_bucket(), "batch_id": F.lit(batch_id).cast("bigint")})
             .hint("rebalance", "end_year").sortWithinPartitions("end_year", "row_start")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("end_year", "batch_id").parquet(self._data))
            counters = wrote.get
        else:
            counters, snapshot = dict.fromkeys(("opened", "closed", "gone", "carried"), 0), False
        row = [ntz(end).alias("through"), F.lit(snapshot).alias("snapshot"), F.lit(found["n"]).cast("bigint").alias("changes"),
               *[F.lit(counters[c]).cast("bigint").alias(c) for c in ("opened", "closed", "gone", "carried")]]
        (self.spark.range(1).coalesce(1).select(*row).write.mode("overwrite").parquet(f"{self.path}/commits/batch_id={batch_id}"))
        self.refresh()
        return True

    def _changed(self, batch: DataFrame, snapshot: bool) -> DataFrame:
        """What a batch writes, each row with how it came about."""
        touched = batch.groupBy("entity").agg(F.min("ts").alias("closed_at"))
        new = D.scd2_with_deletes(batch).withColumn("gone", F.lit(False))
        is_open = F.col("row_end") == system_max()
        out = new.withColumn("how", F.when(is_open, "opened").otherwise("closed"))
        left = touched.join(new.filter(is_open).select("entity"), "entity", "left_anti").select(
            "entity", F.col("closed_at").alias("row_start"), system_max().alias("row_end"), F.lit(True).alias("gone"), F.lit("gone").alias("how"))
        out = out.unionByName(left, allowMissingColumns=True)
        if not self._exists("versions"):
            return out
        before = self._open()
        ended = (before.join(touched, "entity").withColumns({"row_end": F.col("closed_at"), "how": F.lit("closed")}).drop("closed_at"))
        out = out.unionByName(ended)
        if snapshot:
            out = out.unionByName(before.join(touched, "entity", "left_anti").withColumn("how", F.lit("carried")))
        return out

    # -- files -------------------------------------------------------------------------------------

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, fs = self._fs()
        return fs.exists(path(f"{self.path}/{name}"))

    def _remove(self, batch_id: int) -> None:
        """Delete what an attempt at the batch left, in every year: the next one may write fewer."""
        path, fs = self._fs()
        for found in fs.globStatus(path(f"{self._data}/end_year=*/batch_id={batch_id}")) or []:
            if not fs.delete(found.getPath(), True) and fs.exists(found.getPath()):
                raise OSError(f"{found.getPath()} could not be removed")
