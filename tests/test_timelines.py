from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests import data
from tests.conftest import ts
from twinclock.operators import lookups as L
from twinclock.operators import timelines as B
from twinclock.schema import ntz


def three_points(spark, *extra):
    base = [(1, 1, ts("2022-01-01")), (1, 2, ts("2022-02-01")), (1, 3, ts("2022-03-01"))]
    return spark.createDataFrame(base + [(1, r, t) for r, t in extra], "entity bigint, rev_id bigint, ts timestamp_ntz")


def test_intervals_touch_and_last_is_open(spark, rows):
    got = rows(B.build_timeline(three_points(spark)), "rev_id", "valid_from", "valid_to")
    assert got == [(1, ts("2022-01-01"), ts("2022-02-01")), (2, ts("2022-02-01"), ts("2022-03-01")), (3, ts("2022-03-01"), data.INF)]


def test_same_second_highest_id_is_visible(spark, rows):
    ev = three_points(spark, (5, ts("2022-02-01")), (9, ts("2022-02-01")))
    assert rows(B.build_timeline(ev), "rev_id") == [(1,), (3,), (9,)]
    assert rows(B.shadowed(ev), "rev_id") == [(2,), (5,)]


def test_empty_input(spark, rows):
    none = three_points(spark).filter("rev_id > 10")
    assert rows(B.build_timeline(none)) == []


def test_busy_entity(spark, rows):
    line = B.build_timeline(data.events(spark)).filter("entity = 7")
    assert rows(line, "rev_id", "valid_from", "valid_to") == [(r, ts(a), ts(z)) for r, a, z in data.BUSY_LINE]


@pytest.mark.parametrize("max_rows", [None, 20, 50])
@pytest.mark.parametrize("seed", [1, 2])
def test_timeline_equals_brute_force_with_and_without_slices(spark, rows, max_rows, seed):
    raw = data.random_events(seed=seed)
    ev = spark.createDataFrame(raw, data.EVENT_SCHEMA)
    assert rows(B.build_timeline(ev, max_rows)) == data.brute_timeline(raw)
    visible = {r[1] for r in data.brute_timeline(raw)}
    assert rows(B.shadowed(ev, max_rows), "rev_id") == sorted((r[1],) for r in raw if r[1] not in visible)


def test_one_hot_instant(spark, rows):
    """A third of all rows at one instant of one entity."""
    raw = [(1, i, datetime(2020, 1, 1), "a", 1) for i in range(300)] + [(1, 300 + i, datetime(2020, 1, 2 + i % 20), "b", 1) for i in range(600)]
    ev = spark.createDataFrame(raw, data.EVENT_SCHEMA)
    assert rows(B.build_timeline(ev, 40)) == data.brute_timeline(raw)
    assert B.shadowed(ev, 40).count() == 900 - 21


def test_plan_insert_trim_and_split(spark, rows):
    ev = three_points(spark)
    now = B.build_timeline(ev.filter("rev_id <> 2"))
    plan = B.plan_changes(now, ev)
    assert rows(plan, "rev_id", "action") == [(1, "trim"), (2, "insert"), (3, "keep")]
    B.assert_plan_allowed(plan)


def test_plan_delete_on_same_second_successor(spark, rows):
    ev = three_points(spark, (9, ts("2022-02-01")))
    plan = B.plan_changes(B.build_timeline(three_points(spark)), ev)
    assert rows(plan.filter("action <> 'keep'"), "rev_id", "action") == [(2, "delete"), (9, "insert")]


def test_plan_refuses_growth(spark):
    plan = B.plan_changes(B.build_timeline(three_points(spark)), three_points(spark).filter("rev_id <> 2"))
    with pytest.raises(ValueError, match="revision 1"):
        B.assert_plan_allowed(plan)


def test_apply_plan_keeps_the_old_belief(spark, rows):
    from twinclock.operators.systime import start_versioning
    now = B.build_timeline(three_points(spark).filter("rev_id < 3"))
    out = B.apply_plan(start_versioning(now, "2023-01-01 00:00:00"), B.plan_changes(now, three_points(spark)), "2024-01-01 00:00:00")
    old = rows(out.filter("row_end < timestamp_ntz '2100-01-01'"), "rev_id", "valid_to", "row_end")
    assert old == [(2, data.INF, ts("2024-01-01"))]
    assert out.count() == 4


def test_half_open_boundaries(spark, rows):
    line = B.build_timeline(three_points(spark))
    assert rows(B.interval_at(line, "2022-02-01 00:00:00"), "rev_id") == [(2,)]
    assert rows(B.interval_at(line, "2022-01-31 23:59:59"), "rev_id") == [(1,)]
    assert rows(B.interval_at(line, "2021-12-31 23:59:59"), "rev_id") == []


def portion_row(spark):
    return data.intervals(spark, [(1, 31, "2013-05-20 06:07:08", "9999-12-31 23:59:59")])


def test_delete_for_portion_trims(spark, rows):
    out = B.delete_for_portion(portion_row(spark), "2014-09-01 12:00:01", "9999-12-31 23:59:59")
    assert rows(out, "valid_from", "valid_to") == [(ts("2013-05-20 06:07:08"), ts("2014-09-01 12:00:01"))]


def test_delete_for_portion_leaves_two_remnants_or_none(spark, rows):
    row = portion_row(spark)
    assert B.delete_for_portion(row, "2014-01-01 00:00:00", "2015-01-01 00:00:00").count() == 2
    assert B.delete_for_portion(row, "2010-01-01 00:00:00", "9999-12-31 23:59:59").count() == 0
    assert B.delete_for_portion(row, "2014-01-01 00:00:00", "2015-01-01 00:00:00", F.col("rev_id") == 1).count() == 1


def test_update_for_portion_on_dates(spark, rows):
    df = spark.sql("select 1 id, 'a' v, date'2022-01-01' f, date'2022-12-31' t")
    out = B.update_for_portion(df, "2022-04-01", "2022-06-01", {"v": F.lit("b")}, period=("f", "t"))
    assert [(v, str(f), str(t)) for v, f, t in sorted(rows(out, "v", "f", "t"), key=lambda r: r[1])] == [
        ("a", "2022-01-01", "2022-04-01"), ("b", "2022-04-01", "2022-06-01"), ("a", "2022-06-01", "2022-12-31")]


def test_problems(spark, rows):
    bad = data.intervals(spark, [(1, 1, "2022-01-01", "2022-02-01"), (1, 2, "2022-01-20", "2022-03-01"),
                                 (1, 3, "2022-04-01", "2022-04-01"), (1, 4, "2022-04-02", "9999-12-31 23:59:59")])
    assert rows(B.timeline_problems(bad), "rev_id", "problem") == [(1, "overlap"), (2, "gap"), (3, "empty"), (3, "gap")]
    assert rows(B.overlapping_rows(bad), "rev_id") == [(2,)]
    assert rows(B.empty_rows(bad), "rev_id") == [(3,)]


@pytest.mark.parametrize("max_rows", [None, 30])
def test_overlaps_with_slices(spark, rows, max_rows):
    raw = data.brute_timeline(data.random_events(seed=3))
    stretched = [(e, r, a, z if i % 7 else datetime(2020, 3, 1)) for i, (e, r, a, z) in enumerate(raw)]
    df = spark.createDataFrame(stretched, "entity bigint, rev_id bigint, valid_from timestamp_ntz, valid_to timestamp_ntz")
    want = [(r,) for e, r, a, z in stretched if any(e2 == e and a2 < a and z2 > a for e2, _, a2, z2 in stretched)]
    assert rows(B.overlapping_rows(df, max_rows), "rev_id") == sorted(want)


# ---- lookups -------------------------------------------------------------------------------------

ANSWERS = [("2015-08-19 21:00:00", 47), ("2015-08-19 20:59:59", 44), ("2016-03-04 14:14:14", 59), ("2016-03-04 14:14:20", 59),
           ("2016-03-04 14:14:21", 63), ("2018-01-01 00:00:00", 82), (data.END, 95), ("2014-06-01 00:00:00", None)]


@pytest.mark.parametrize("strategy,max_rows", [("carry", None), ("carry", 3), ("join", None)])
def test_as_of_answers(spark, rows, strategy, max_rows):
    probes = spark.createDataFrame([(i, 7, ts(t)) for i, (t, _) in enumerate(ANSWERS)], "probe_id bigint, entity bigint, t timestamp_ntz")
    got = rows(L.revisions_at(B.build_timeline(data.events(spark)), probes, strategy, max_rows), "probe_id", "rev_id")
    assert got == [(i, r) for i, (_, r) in enumerate(ANSWERS)]


@pytest.mark.parametrize("max_rows", [None, 25])
def test_lookups_with_slices_equal_brute_force(spark, rows, max_rows):
    raw = data.random_events(seed=4)
    line = data.brute_timeline(raw)
    probes = [(i, e, t) for i, (e, _, t, *_) in enumerate(raw)] + [(1000 + i, 0, datetime(2020, 1, 15)) for i in range(200)]
    ev = spark.createDataFrame(raw, data.EVENT_SCHEMA)
    pr = spark.createDataFrame(probes, "probe_id bigint, entity bigint, t timestamp_ntz")
    want = sorted((i, next((r for e2, r, a, z in line if e2 == e and a <= t < z), None)) for i, e, t in probes)
    assert rows(L.revisions_at(B.build_timeline(ev, max_rows), pr, "carry", max_rows), "probe_id", "rev_id") == want
    assert rows(L.latest_before(ev, pr, max_rows), "probe_id", "rev_id") == want
    counts = sorted((i, sum(r[0] == e and r[2] <= t for r in raw)) for i, e, t in probes)
    assert rows(L.events_until(ev, pr, max_rows), "probe_id", "n") == counts


@pytest.mark.parametrize("t", ["2020-01-10 01:00:01", "2020-01-01 00:00:00", "2019-01-01 00:00:00", "2021-01-01 00:00:00"])
def test_snapshot_of_events_equals_the_timeline(spark, rows, t):
    ev = spark.createDataFrame(data.random_events(seed=5), data.EVENT_SCHEMA)
    cols = ["entity", "rev_id", "valid_from", "valid_to"]
    assert rows(L.snapshot_of_events(ev, t), *cols) == rows(L.snapshot(B.build_timeline(ev), t), *cols)


def test_overlap_upper_bound_is_inclusive(spark, rows):
    line = B.build_timeline(three_points(spark))
    assert rows(L.overlapping(line, "2022-01-15 00:00:00", "2022-02-01 00:00:00"), "rev_id") == [(1,), (2,)]
    assert rows(L.overlapping(line, "2022-02-01 00:00:00", "2022-02-15 00:00:00"), "rev_id") == [(2,)]


def test_history_of_one_year(spark, rows):
    line = B.build_timeline(data.events(spark)).filter("entity = 7")
    page = L.history_page(line, "2016-01-01 00:00:00", "2016-12-31 23:59:59").orderBy("position")
    assert [r["rev_id"] for r in page.collect()] == [63, 59, 47]
    with pytest.raises(ValueError):
        L.history_page(line, data.START, data.END, page=0)


@pytest.mark.parametrize("max_rows", [None, 2])
def test_compare(spark, rows, max_rows):
    pairs = spark.createDataFrame([(1, 7, ts("2016-06-01"), ts("2015-03-01")), (2, 9, ts("2016-01-01"), ts("2017-01-01")), (3, 8, ts("2015-01-01"), ts("2015-06-01"))],
                                  "pair_id bigint, entity bigint, a timestamp_ntz, b timestamp_ntz")
    ev = data.events(spark)
    got = rows(L.compare(B.build_timeline(ev), ev, pairs, max_rows), "pair_id", "swapped", "rev_a", "rev_b", "same_revision", "edits_between")
    assert got == [(1, True, 44, 63, False, 4), (2, False, 5, 5, True, 0), (3, False, None, None, None, 0)]


def test_neighbours_are_clipped_to_the_coverage(spark, rows):
    got = rows(L.neighbours(B.build_timeline(data.events(spark)), data.START, data.END).filter("entity = 7"),
               "rev_id", "previous_rev", "next_rev")
    assert got[0] == (31, None, 44) and got[1] == (44, 31, 47) and got[-1] == (95, 82, None)


def test_not_yet_created(spark, rows):
    ev = data.events(spark)
    line = B.build_timeline(ev)
    probes = spark.createDataFrame([(1, 8, ts("2016-01-01"))], "probe_id bigint, entity bigint, t timestamp_ntz")
    got = rows(L.with_creation(L.revisions_at(line, probes), L.timeline_bounds(line, ev)), "rev_id", "not_yet_created", "first_from")
    assert got == [(None, True, ts("2016-09-09 09:00:00"))]


def test_month_series_counts_empty_months(spark):
    ev = data.events(spark).filter("entity = 7")
    s = {r["month"]: r for r in L.month_series(ev, data.START, data.END).collect()}
    assert len(s) == 48 and s["2016-03"]["edits"] == 3 and s["2016-04"]["edits"] == 0
    assert s["2018-12"]["last_second"] == ts(data.END) and s["2015-01"]["last_second"] == ts("2015-01-31 23:59:59")


def test_iso_shows_microseconds_only_when_present(spark, rows):
    df = spark.sql("select timestamp_ntz'2023-01-02 03:04:05' a, timestamp_ntz'2023-01-02 03:04:05.25' b, timestamp_ntz'9999-12-31 23:59:59' c")
    assert rows(df.select(L.iso("a"), L.iso("b"), L.iso("c"))) == [("2023-01-02T03:04:05Z", "2023-01-02T03:04:05.250000Z", None)]


def test_filter_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("rev_id"), F.col("o_orderdate").alias("ts"))
    plan = orders.filter(F.col("ts") <= ntz("1998-01-01 00:00:00"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[-1]


def test_a_large_scan_is_dealt_to_more_tasks(spark, monkeypatch):
    from twinclock.operators import slices

    monkeypatch.setattr(slices, "TASK_ROWS", 20)
    events = spark.createDataFrame(data.random_events(n=600, entities=300, hot_share=0.0), data.EVENT_SCHEMA)
    scan = slices.Scan(events.select("entity", "rev_id", "ts"), "entity", ["ts", "rev_id"], 400).lead("ts", "next_ts").result()
    assert scan.rdd.getNumPartitions() == 30
    assert sorted(map(tuple, B.build_timeline(events, 400).collect())) == data.brute_timeline(data.random_events(n=600, entities=300, hot_share=0.0))
