from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests import data
from tests.conftest import ts
from twinclock.operators import measure as M
from twinclock.operators import quality as V
from twinclock.operators import systime as D
from twinclock.operators import timelines as B
from twinclock.plans.sync import backfill_beliefs
from twinclock.session import new_table_path


def failed(report):
    return sorted(r["name"] for r in report.filter("NOT ok").collect())


@pytest.fixture(scope="module")
def line(spark):
    return B.build_timeline(data.events(spark))


def test_sound_timeline_passes_everything(spark, line):
    ev = data.events(spark)
    report = V.together(V.timeline_checks(line), V.timeline_event_checks(line, ev, data.START),
                        V.agreement_check(line, D.scd2_from_log(ev.select("entity", "rev_id", "ts")), data.START))
    assert failed(report) == ["every entity has a state at the window start"]   # one entity begins inside the window
    assert V.overall(report).first()["ok"]


DAMAGE = {
    "no gaps": lambda df: df.withColumn("valid_to", F.when(F.col("rev_id") == 44, F.col("valid_to") - F.expr("interval 1 day")).otherwise(F.col("valid_to"))),
    "no overlaps": lambda df: df.withColumn("valid_to", F.when(F.col("rev_id") == 44, F.col("valid_to") + F.expr("interval 1 day")).otherwise(F.col("valid_to"))),
    "valid_from before valid_to": lambda df: df.withColumn("valid_to", F.when(F.col("rev_id") == 44, F.col("valid_from")).otherwise(F.col("valid_to"))),
    "only the last interval is open": lambda df: df.filter("rev_id <> 95"),
}


@pytest.mark.parametrize("name", DAMAGE)
def test_damaged_timeline_is_noticed(spark, line, name):
    assert name in failed(V.timeline_checks(DAMAGE[name](line)))


def test_lost_interval_is_noticed(spark, line):
    ev = data.events(spark)
    lost = line.filter("rev_id <> 63")
    assert "every event is on the timeline or shadowed" in failed(V.timeline_event_checks(lost, ev, data.START))
    assert failed(V.agreement_check(line, D.scd2_from_log(ev.select("entity", "rev_id", "ts").filter("rev_id <> 63")), data.START)) == ["timeline and mirror agree"]
    moved = line.withColumn("valid_from", F.col("valid_from") + F.expr("interval 1 second"))
    assert "valid_from is the event's instant" in failed(V.timeline_event_checks(moved, ev, data.START))


def test_versions(spark):
    ev = data.events(spark)
    v = backfill_beliefs(ev, data.CHECKPOINTS)
    assert failed(V.version_checks(v, D.current(v), ev)) == []
    assert failed(V.version_checks(v, D.current(v).limit(3), ev.filter("rev_id <> 44"))) == [
        "current rows are the versions without end", "history references events"]
    twisted = v.withColumn("row_start", F.col("row_end"))
    assert "row_start before row_end" in failed(V.version_checks(twisted, D.current(twisted), ev))


def test_events_and_references(spark):
    ev = data.events(spark).withColumns({"is_baseline": F.col("ts") < F.lit(data.START).cast("timestamp_ntz"),
                                         "content_status": F.when(F.col("content_hidden"), "hidden").otherwise("available")})
    arts = spark.createDataFrame([(7, "resolved"), (8, "redirect"), (9, "resolved"), (10, "resolved"), (11, "missing")], "article_id bigint, status string")
    texts = ev.filter("text is not null").select("sha1", "text", F.octet_length("text").alias("byte_length")).distinct()
    assert failed(V.event_checks(ev, data.START, data.END)) == []
    assert failed(V.event_checks(ev.unionByName(ev.filter("rev_id = 44")), data.START, "2018-06-01 00:00:00")) == ["events lie inside the window", "revision ids are unique"]
    assert failed(V.reference_checks(ev, arts, texts)) == ["usable entities have events"]
    assert failed(V.reference_checks(ev, arts.filter("article_id <> 8"), texts.filter("text <> 'first'"))) == [
        "available events have a text", "events reference an entity", "usable entities have events"]
    assert failed(V.text_checks(texts, ev)) == []
    assert len(failed(V.text_checks(texts.withColumn("text", F.upper("text")), ev.withColumn("sha1", F.lit("x"))))) == 2


def test_state_and_checkpoints(spark):
    arts = spark.createDataFrame([(1, "resolved"), (2, "missing")], "article_id bigint, status string")
    state = spark.createDataFrame([(1, ts("2021-01-01"), ts("2022-01-01"))], "entity bigint, synced_from timestamp_ntz, synced_through timestamp_ntz")
    assert failed(V.state_checks(arts, state, "2022-01-01 00:00:00")) == []
    assert failed(V.state_checks(arts, state.withColumn("synced_from", F.lit("2023-01-01").cast("timestamp_ntz")), "2022-01-02 00:00:00")) == [
        "synced ranges are ordered", "usable entities are synced to the window end"]
    log = spark.createDataFrame([(1, ts("2022-01-01")), (2, ts("2022-01-02"))], "batch_id bigint, completed_at timestamp_ntz")
    assert failed(V.checkpoint_checks(log)) == []
    assert failed(V.checkpoint_checks(log.withColumn("batch_id", -F.col("batch_id")))) == ["checkpoints are ordered"]


# ---- measurement ---------------------------------------------------------------------------------

@pytest.mark.parametrize("max_rows", [None, 25])
def test_strategies_agree(spark, max_rows):
    ev = spark.createDataFrame(data.random_events(seed=11), data.EVENT_SCHEMA)
    probes = M.probe_workload(ev, 300, "2020-01-01 00:00:00", "2020-02-01 00:00:00")
    assert probes.count() == 300 and probes.select("entity").distinct().count() == 5
    r = M.strategy_agreement(B.build_timeline(ev), ev, D.scd2_from_log(ev), probes, max_rows).first()
    assert r.asDict() == {"probes": 300, "join_differs": 0, "events_differs": 0, "mirror_differs": 0}


def test_scaled_copies_keep_times_and_shift_entities(spark, rows):
    ev = data.events(spark).select("entity", "rev_id", "ts")
    copies = M.scaled_copies(ev, 3)
    assert copies.count() == 39 and copies.select("entity").distinct().count() == 9
    plan = copies._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "CartesianProduct" not in plan


def test_layouts_give_equal_answers(spark, rows):
    v = D.scd2_from_log(spark.createDataFrame(data.random_events(seed=12), data.EVENT_SCHEMA).drop("status"))
    tables = M.build_layouts(v, new_table_path(spark, "layouts"))
    reads = M.layout_queries(0, "2020-01-15 00:00:00", "2020-01-03 00:00:00", "2020-01-28 00:00:00", ("2020-01-05 00:00:00", "2020-01-06 00:00:00"))
    answers = rows(M.layout_answers(tables, reads), "query", "n", "bytes")
    assert len(answers) == 21 and len(set(answers)) == 7


@pytest.mark.parametrize("max_rows", [None, 10])
def test_nearest_rank(spark, rows, max_rows):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 5.0)], "g string, ms double")
    assert rows(M.nearest_rank(df, "g", "ms", max_rows=max_rows)) == [("a", 100, 50.0, 95.0, 99.0), ("b", 1, 5.0, 5.0, 5.0)]


def test_table_counts(spark, rows):
    v = D.scd2_from_log(data.events(spark).select("entity", "rev_id", "ts"))
    assert rows(M.table_counts({"m": v, "e": data.events(spark)})) == [("e", 13, 13, 0), ("m", 12, 3, 9)]
    assert datetime(2106, 2, 7).year == 2106
