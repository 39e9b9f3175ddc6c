"""The synchronised store: events, texts, state and bitemporal timeline as Parquet, one folder per batch.

A batch writes its own folders and appends its commit row last; readers only see committed batches. ``begin`` removes
whatever an earlier attempt at the batch left, in every folder and year, so a crash or a retry changes nothing, also if
the retry has another instant or writes fewer folders.

    events/batch_id=N     events added by batch N
    texts/batch_id=N      texts added by batch N
    open/batch_id=N       open-ended intervals that batch N began; the newest one of an entity counts
    open_all/batch_id=N   instead of it, every ``snapshot_every`` batches: the open-ended interval of every entity
    settled/batch_id=N    closed intervals that batch N added; never rewritten
    unsettled/batch_id=N  closed intervals that batch N took back because a late event fell into them
    history/end_year=Y/batch_id=N   beliefs superseded by batch N
    state/batch_id=N      synced range per entity after batch N
    commits/batch_id=N    the commit row

Closed intervals are appended and open ones written where they changed, so a batch writes what its new events changed; the
whole set of open intervals is written now and then, so that a reader meets one snapshot and few batches after it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinclock.schema import ntz, system_max

BELIEF = "entity {e}, rev_id BIGINT, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, row_start TIMESTAMP_NTZ, row_end TIMESTAMP_NTZ"
STATE = "entity {e}, synced_from TIMESTAMP_NTZ, synced_through TIMESTAMP_NTZ, last_batch BIGINT"
COUNTERS = ["seen", "inserted", "skipped", "texts", "raw_bytes", "trims", "deletes", "inserts", "shadowed",
            "entities_total", "entities_failed", "unsettled"]
EPOCH = "stream STRING, epoch BIGINT"
_FLOORS = T.StructType([T.StructField("floor", T.TimestampNTZType())])
COMMIT = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("run_id", T.LongType()),
    T.StructField("synced_through", T.TimestampNTZType()), T.StructField("completed_at", T.TimestampNTZType()),
    *[T.StructField(c, T.LongType()) for c in COUNTERS]])


class Store:
    def __init__(self, spark: SparkSession, path: str, entity_type: str = "BIGINT", snapshot_every: int = 8):
        if snapshot_every < 1:
            raise ValueError("snapshot_every is at least 1")
        self.spark, self.path, self.snapshot_every = spark, path.rstrip("/"), snapshot_every
        self.entity_type = entity_type
        self.belief_schema = BELIEF.format(e=entity_type)
        self.state_schema = STATE.format(e=entity_type)
        self._last: int | None = None
        self._taken_back = 0

    # -- commit log --------------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        """The commit log: one small row per batch."""
        return self._read("commits", COMMIT)

    def refresh(self) -> int:
        """Look up the newest committed batch again."""
        r = self.commits().agg(F.coalesce(F.max("batch_id"), F.lit(0)).alias("n"),
                               F.coalesce(F.sum("unsettled"), F.lit(0)).alias("taken")).first()
        self._last, self._taken_back = r["n"], r["taken"]
        return self._last

    def last_batch(self) -> int:
        return self.refresh() if self._last is None else self._last

    def commit(self, batch_id: int, synced_through, completed_at, run_id: int = 1, **counters) -> None:
        row = (batch_id, run_id, _when(synced_through), _when(completed_at),
               *[int(counters.get(c) or 0) for c in COUNTERS])
        cells = [F.lit(None if v is None else str(v)).cast(f.dataType).alias(f.name)
                 for f, v in zip(COMMIT, row) if f.name != "batch_id"]
        (self.spark.range(1).coalesce(1).select(*cells)
         .write.mode("overwrite").parquet(f"{self.path}/commits/batch_id={batch_id}"))
        self._last = batch_id
        self._taken_back += int(counters.get("unsettled") or 0)

    # -- reading -----------------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema) -> DataFrame:
        if not self._exists(name):
            return self._empty(schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(_with_batch(name, schema))
        return reader.parquet(f"{self.path}/{name}")

    def _committed(self, name: str, schema) -> DataFrame:
        return self._read(name, schema).filter(F.col("batch_id") <= self.last_batch()) if self._exists(name) \
            else self._empty(schema)

    def _empty(self, schema) -> DataFrame:
        """No rows, known as such to the optimiser."""
        fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).limit(0)

    def events(self, columns: str | None = None) -> DataFrame | None:
        """Stored events, or None before the first batch. Their attributes are the caller's; ``columns`` is a
        schema where only some of them are wanted."""
        return self._committed("events", columns).drop("batch_id") if self.last_batch() else None

    def texts(self, columns: str | None = None) -> DataFrame | None:
        return self._committed("texts", columns).drop("batch_id") if self._exists("texts") and self.last_batch() else None

    def _latest(self, name: str, schema) -> DataFrame:
        return self._read(name, schema).filter(F.col("batch_id") == self.last_batch()).drop("batch_id") \
            if self._exists(name) else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        return self._latest("state", self.state_schema)

    def open_rows(self) -> DataFrame:
        """The open-ended interval of every entity: the newest snapshot but for the entities opened anew since, and those."""
        last, base = self.last_batch(), self._snapshot()
        whole = self.spark.read.schema(self.belief_schema).parquet(f"{self.path}/open_all/batch_id={base}") if base else None
        if base and base == last:
            return whole
        if not self._exists("open"):
            return self.spark.createDataFrame([], self.belief_schema) if whole is None else whole
        later = self._read("open", self.belief_schema).filter(F.col("batch_id").between(base + 1, last))
        cells = F.struct(*[c for c in later.columns if c != "batch_id"])
        newest = later.groupBy("entity").agg(F.max_by(cells, "batch_id").alias("r")).select("r.*")
        return newest if whole is None else newest.unionByName(whole.join(newest.select("entity"), "entity", "left_anti"))

    def _snapshot(self) -> int:
        """Newest committed batch that wrote every open row; 0: none."""
        return max((b for b in self._batches("open_all") if b <= self.last_batch()), default=0)

    def _batches(self, name: str) -> list[int]:
        path, fs = self._fs()
        found = fs.globStatus(path(f"{self.path}/{name}/batch_id=*")) or []
        return [int(f.getPath().getName().split("=")[1]) for f in found]

    def is_snapshot(self, batch_id: int) -> bool:
        """Whether this batch is to write every open row."""
        return batch_id % self.snapshot_every == 0

    def settled_rows(self) -> DataFrame:
        """Closed intervals believed now. Only where late events took some back is there a join."""
        rows = self._committed("settled", self.belief_schema).drop("batch_id")
        self.last_batch()
        if not self._taken_back:
            return rows
        gone = self._committed("unsettled", self.belief_schema).select("entity", "rev_id", "valid_from", "row_start")
        return rows.join(gone, ["entity", "rev_id", "valid_from", "row_start"], "left_anti")

    def current(self) -> DataFrame:
        return self.open_rows().unionByName(self.settled_rows())

    def history(self, floor: bool = True) -> DataFrame:
        rows = self._committed("history", self.belief_schema)
        limit = self._floor() if floor else None
        if limit is not None:
            rows = rows.filter((F.col("row_end") >= ntz(limit)) & (F.col("end_year") >= int(limit[:4])))
        return rows.drop("batch_id", "end_year")

    def versions(self) -> DataFrame:
        return self.current().unionByName(self.history())

    # -- writing -----------------------------------------------------------------------------------

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _remove(self, pattern: str) -> None:
        """Delete the folders that fit; a folder that stays is an error."""
        path, fs = self._fs()
        for found in fs.globStatus(path(f"{self.path}/{pattern}")) or []:
            if not fs.delete(found.getPath(), True) and fs.exists(found.getPath()):
                raise OSError(f"{found.getPath()} could not be removed")

    def begin(self, batch_id: int) -> None:
        """Start a batch that is not committed: nothing of an earlier attempt stays."""
        if batch_id <= self.refresh():
            raise ValueError(f"batch {batch_id} is committed")
        self._remove(f"*/batch_id={batch_id}")
        self._remove(f"history/end_year=*/batch_id={batch_id}")

    def clean_up(self) -> None:
        """Remove what no reader needs any more: the open rows before the newest snapshot, the states before the newest
        batch, the plans and failures of committed batches, and the history of years that end before the retention floor."""
        last = self.refresh()
        path, fs = self._fs()
        base = self._snapshot()
        for name, keep in (("open", base), ("open_all", base), ("state", last), ("plans", last + 1), ("failed", last + 1)):
            for batch in self._batches(name):
                if batch < keep:
                    self._remove(f"{name}/batch_id={batch}")
        floor = self._floor()
        if floor is not None:
            for found in fs.globStatus(path(f"{self.path}/history/end_year=*")) or []:
                if int(found.getPath().getName().split("=")[1]) < int(floor[:4]):
                    self._remove(f"history/{found.getPath().getName()}")

    def _floor(self) -> str | None:
        if not self._exists("floors"):
            return None
        return self._read("floors", _FLOORS).agg(F.max("floor").cast("string").alias("f")).first()["f"]

    def write(self, name: str, batch_id: int, df: DataFrame) -> DataFrame:
        """Write a folder of the batch; returns it as read back, with its lineage cut."""
        path = f"{self.path}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_history(self, batch_id: int, at, df: DataFrame) -> None:
        """A batch ends beliefs at one instant, so its history lies in one year."""
        year = str(at)[:4]
        df.write.mode("overwrite").parquet(f"{self.path}/history/end_year={year}/batch_id={batch_id}")

    def has_epoch(self, stream: str, epoch: int) -> bool:
        """Whether a committed batch holds this epoch of a stream."""
        done = self._committed("epochs", EPOCH)
        return not done.filter((F.col("stream") == stream) & (F.col("epoch") == epoch)).isEmpty()

    def log_run(self, run_id: int, start, end, status: str, failed: DataFrame | None) -> None:
        """One row per run, and one per failed entity with its reason, under runs/run_id=N."""
        row = self.spark.range(1).select(F.lit(None).cast(self.entity_type).alias("entity"), ntz(start).alias("window_start"),
                                         ntz(end).alias("window_end"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("reason"))
        if failed is not None:
            row = row.unionByName(failed.select("entity", F.lit("failed").alias("status"), "reason"), allowMissingColumns=True)
        row.write.mode("overwrite").parquet(f"{self.path}/runs/run_id={run_id}")

    def runs(self) -> DataFrame:
        """The run log: entity is null in the row of the run itself."""
        schema = f"entity {self.entity_type}, window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, status STRING, reason STRING"
        return self._read("runs", T.StructType.fromDDL(schema + ", run_id BIGINT"))

    def retain_since(self, cutoff) -> None:
        """Readers drop beliefs that ended before ``cutoff`` from now on; a floor never moves back."""
        self.spark.range(1).select(ntz(cutoff).alias("floor")).write.mode("append").parquet(f"{self.path}/floors")


def opened(rows: DataFrame, at) -> DataFrame:
    return rows.withColumns({"row_start": ntz(at), "row_end": system_max()})


def _when(value) -> datetime | None:
    return value if value is None or isinstance(value, datetime) else datetime.fromisoformat(str(value))


def _with_batch(name: str, schema):
    """The schema of a folder with its partition columns."""
    if isinstance(schema, T.StructType):
        return schema
    return schema + ", batch_id BIGINT" + (", end_year INT" if name == "history" else "")
