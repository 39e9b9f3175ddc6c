"""Columns that look towards the end of a partition cost one pass, and a run leaves its trace."""

import time

import pytest
from pyspark.sql import functions as F

from twinclock.operators import diff, lookups, measure
from twinclock.plans import sync
from twinclock.session import new_table_path
from twinclock.sources.store import Store


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def forms(spark):
    line = spark.createDataFrame([("a", 1, "2020-01-01", "2021-01-01")], "entity string, rev_id bigint, f string, t string")
    line = line.select("entity", "rev_id", F.col("f").cast("timestamp_ntz").alias("valid_from"), F.col("t").cast("timestamp_ntz").alias("valid_to"))
    lines = spark.createDataFrame([(1, 1, "OK", "same", "x", 1, 1)], "pair_id bigint, seq bigint, status string, type string, text string, old_no bigint, new_no bigint")
    timings = spark.createDataFrame([("g", 1.0)], "g string, v double")
    return [lookups.history_page(line, "2019-01-01", "2022-01-01"), diff.hunk_lines(lines), measure.nearest_rank(timings, "g", "v")]


def test_no_frame_from_the_row_to_the_end(spark):
    for df in forms(spark):
        assert "currentrow$(), unboundedfollowing$()" not in plan_of(df)


def test_one_key_of_many_rows(spark):
    n = 300_000
    timings = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    began = time.time()
    row = measure.nearest_rank(timings, "g", "v").first()
    assert (row["n"], row["p50"], row["p95"], row["p99"]) == (n, n // 2 - 1, n * 95 // 100 - 1, n * 99 // 100 - 1)
    lines = spark.range(1, 200_001).select(F.lit(1).alias("pair_id"), F.col("id").alias("seq"), F.lit("OK").alias("status"),
                                           F.when(F.col("id") % 1000 == 0, "add").otherwise("same").alias("type"), F.lit("x").alias("text"),
                                           F.col("id").alias("old_no"), F.col("id").alias("new_no"))
    assert diff.hunk_lines(lines, 3).agg(F.max("hunk")).first()[0] == 200
    assert time.time() - began < 60


def test_a_run_that_raises_is_logged(spark):
    store = Store(spark, new_table_path(spark, "raises"))
    events = spark.createDataFrame([(1, 10, "2020-01-01")], "entity bigint, rev_id bigint, ts string").select("entity", "rev_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    sync.run_sync(store, events, "2019-01-01 00:00:00", [("2021-01-01 00:00:00", "2022-01-01 00:00:00")], run_id=1)
    with pytest.raises(Exception, match="no_such"):
        sync.run_sync(store, events.select("entity", "rev_id", F.raise_error(F.lit("no_such")).cast("timestamp_ntz").alias("ts")), "2019-01-01 00:00:00",
                      [("2022-01-01 00:00:00", "2023-01-01 00:00:00")], run_id=2)
    assert {(r["run_id"], r["status"]) for r in store.runs().collect()} == {(1, sync.run_status(1, 0)), (2, "failed")}


def test_an_epoch_is_known_by_stream_and_number(spark):
    store = Store(spark, new_table_path(spark, "epochs"))
    events = spark.createDataFrame([(1, 10, "2020-01-01")], "entity bigint, rev_id bigint, ts string").select("entity", "rev_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    sync.sync_step(store, events, "2019-01-01 00:00:00", "2020-01-01 00:00:00", "2022-01-01 00:00:00", 1, whole_input=True, epoch=("here", 0))
    assert store.has_epoch("here", 0) and not store.has_epoch("here", 1) and not store.has_epoch("there", 0)
