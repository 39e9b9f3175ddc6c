"""Streaming forms of the sync and of the edit counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from twinclock.plans.sync import sync_step
from twinclock.sources.revisions import new_events
from twinclock.sources.store import Store


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_sync(events: DataFrame, store: Store, checkpoint: str, clock: Callable[[int], str],
                start: str = "1000-01-01 00:00:00", run_id: int = 1) -> StreamingQuery:
    """Every micro-batch is one sync step. There is no watermark: an event may be arbitrarily late, its
    interval is re-planned and the belief it corrects is kept.

    ``clock`` gives the system time of the stream's n-th batch, from 1, so a replayed batch gets the same one. A batch that
    was committed before a crash is recognised by the stream's checkpoint and its epoch, and left alone; the store numbers
    its batches on its own, so ``run_sync`` may write it before, between and after. A stream knows nothing of events that
    did not arrive, so it records no synced ranges: a later ``run_sync`` reads the whole window.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        batch_id = store.refresh() + 1
        if store.has_epoch(checkpoint, epoch):
            return
        batch = batch.dropDuplicates(["rev_id"])
        horizon = batch.agg(F.max("ts").cast("string").alias("t")).first()["t"]
        stored = store.events("rev_id BIGINT, ts TIMESTAMP_NTZ")
        # a stream that lost its checkpoint brings what the store has
        if horizon is None or stored is not None and new_events(batch, stored).isEmpty():
            return
        sync_step(store, batch, start, horizon, clock(epoch + 1), batch_id, run_id, whole_input=True, epoch=(checkpoint, epoch))

    return (events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def lateness(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Events older than what their entity was already synced through."""
    return (batch.join(state.select("entity", "synced_through"), "entity")
            .agg(F.count_if(F.col("ts") < F.col("synced_through")).alias("late"), F.count(F.lit(1)).alias("seen")))


def edit_counts(events: DataFrame, delay: str) -> DataFrame:
    """Edits per entity and day window over a stream of events, with a watermark that bounds the state.

    Months differ in length and a streaming window does not; days add up to months in ``monthly``.
    """
    # the instant whose UTC reading is ts, and back: the session's zone plays no part
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    stamped = events.withColumn("at", F.timestamp_micros(F.timestamp_diff("MICROSECOND", zero, F.col("ts"))))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window.start") / 86_400).cast("int"))
    return (stamped.withWatermark("at", delay).groupBy("entity", F.window("at", "1 day"))
            .agg(F.count(F.lit(1)).alias("edits")).select("entity", day.alias("day"), "edits"))


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update mode: every batch writes the new totals of the days it touched to its own folder."""
    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def newest_days(spark: SparkSession, path: str) -> DataFrame:
    """Newest total per (entity, day) of what ``write_counts`` wrote."""
    return spark.read.parquet(path).groupBy("entity", "day").agg(F.max_by("edits", "epoch").alias("edits"))


def corrected(days: DataFrame, events: DataFrame) -> DataFrame:
    """(entity, day, edits, missed): totals from the stored events, and how many of them the stream let go because they
    came later than its watermark allows."""
    true = events.groupBy("entity", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("edits"))
    counted = days.select("entity", "day", F.col("edits").alias("counted"))
    return true.join(counted, ["entity", "day"], "left").select(
        "entity", "day", "edits", (F.col("edits") - F.coalesce("counted", F.lit(0))).alias("missed"))


def monthly(spark: SparkSession, path: str) -> DataFrame:
    """Newest total per (entity, day), added up per month."""
    return newest_days(spark, path).groupBy("entity", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("edits").alias("edits"))
