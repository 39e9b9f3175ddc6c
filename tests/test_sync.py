import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import data
from tests.conftest import ts
from twinclock.functions import instants
from twinclock.operators import systime as D
from twinclock.operators import timelines as B
from twinclock.plans import sync as E
from twinclock.session import new_table_path
from twinclock.sources import revisions as R
from twinclock.sources.store import Store
from twinclock.streaming import jobs


@pytest.fixture
def store(spark):
    return Store(spark, new_table_path(spark, "store"))


def line_of(store, entity):
    return [tuple(r) for r in store.current().filter(F.col("entity") == entity).orderBy("valid_from").select("rev_id", "valid_from", "valid_to").collect()]


BUSY = [(r, ts(a), ts(z)) for r, a, z in data.BUSY_LINE]
SUPERSEDED = [(36,), (47,), (63,), (77,), (82,)]


def test_full_run_of_the_fixture(spark, store, rows):
    assert E.run_sync(store, data.events(spark), data.START, data.CHECKPOINTS) == "succeeded"
    assert store.events().count() == 13 and store.texts().count() == 11
    assert store.current().count() == 12
    assert line_of(store, 7) == BUSY
    assert rows(store.history(), "rev_id") == SUPERSEDED
    assert store.history().filter(F.col("valid_to") < F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")).count() == 0
    assert [str(r["synced_through"]) for r in E.checkpoint_report(store).collect()] == data.CUTOFFS
    assert rows(store.events().filter("is_baseline"), "rev_id") == [(5,), (31,)]
    assert rows(D.believed_at(store.versions(), data.CHECKPOINTS[0][1], "2017-03-01 00:00:00").filter("entity = 7"), "rev_id", "valid_to") == [(47, data.INF)]

    # the same again: nothing new to read, no new rows, no new versions
    before = (store.events().count(), store.versions().count())
    c = E.sync_step(store, data.events(spark), data.START, data.END, "2019-03-01 00:00:00", 5)
    assert c["seen"] == 0 and c["inserted"] == 0 and (store.events().count(), store.versions().count()) == before

    # state lost: everything is read again and skipped
    store.write("state", 5, store.state().limit(0))
    c = E.sync_step(store, data.events(spark), data.START, data.END, "2019-03-02 00:00:00", 6)
    assert (c["seen"], c["inserted"], c["skipped"], c["texts"]) == (13, 0, 13, 0)
    assert (store.events().count(), store.versions().count()) == before

    store.retain_since(data.CHECKPOINTS[2][1])
    assert rows(store.history(), "rev_id") == [(36,), (63,), (77,), (82,)]
    assert store.history(floor=False).count() == 5


def test_backfill_equals_the_fixture_beliefs(spark, rows):
    v = E.backfill_beliefs(data.events(spark), data.CHECKPOINTS)
    assert v.filter("entity = 7").count() == 11
    assert rows(D.superseded(v), "rev_id") == SUPERSEDED


@pytest.mark.parametrize("max_rows", [None, 20])
def test_stepwise_planning_equals_one_pass(spark, rows, max_rows):
    raw = data.random_events(n=300, seed=8)
    ev = spark.createDataFrame(raw, data.EVENT_SCHEMA)
    steps = [(f"2020-01-{d:02d} 00:00:00", f"2020-01-{d:02d} 01:00:00") for d in (8, 9, 20, 29)]
    versions = spark.createDataFrame([], "entity bigint, rev_id bigint, valid_from timestamp_ntz, valid_to timestamp_ntz, row_start timestamp_ntz, row_end timestamp_ntz")
    for cutoff, at in steps:
        now = D.current(versions).select("entity", "rev_id", "valid_from", "valid_to")
        plan = B.plan_changes(now, ev.filter(F.col("ts") <= F.lit(cutoff).cast("timestamp_ntz")), max_rows)
        from twinclock.session import materialise
        versions = materialise(B.apply_plan(versions, plan, at), "steps")
    cols = ["entity", "rev_id", "valid_from", "valid_to", "row_start", "row_end"]
    assert rows(versions, *cols) == rows(E.backfill_beliefs(ev, steps, max_rows), *cols)


def test_bad_digest_fails_only_its_entity_and_a_later_run_repairs_it(spark, store, rows):
    good = data.events(spark)
    bad = good.withColumn("sha1", F.when(F.col("rev_id") == 63, F.lit("0" * 40)).otherwise(F.col("sha1")))
    assert E.run_sync(store, bad, data.START, data.CHECKPOINTS) == "partial"
    assert [r[0] for r in line_of(store, 7)] == [31, 44, 47] and line_of(store, 7)[-1][2] == data.INF
    assert rows(store.state().filter("entity = 7"), "synced_through") == [(ts(data.CUTOFFS[0]),)]
    assert len(line_of(store, 8)) == 3
    later = [(data.END, "2019-03-01 00:00:00")]
    assert E.run_sync(store, good, data.START, later, run_id=2) == "succeeded"
    assert line_of(store, 7) == BUSY


def test_narrow_window_first_then_the_full_one(spark, store):
    ev = data.events(spark)
    E.run_sync(store, ev, "2016-01-01 00:00:00", [("2017-06-01 00:00:00", "2019-02-01 00:00:00")])
    assert [r[0] for r in line_of(store, 7)] == [47, 59, 63, 70]
    E.run_sync(store, ev, data.START, [(data.END, "2019-02-02 00:00:00")])
    assert line_of(store, 7) == BUSY


def test_interrupted_batch_is_invisible_and_can_be_run_again(spark, store):
    ev = data.events(spark)
    E.run_sync(store, ev, data.START, data.CHECKPOINTS[:2])
    before = store.versions().count()
    # a crash after some folders of batch 3 were written, before its commit
    store.write("settled", 3, store.settled_rows())
    store.write("open", 3, store.open_rows().limit(1))
    fresh = Store(spark, store.path)
    assert fresh.versions().count() == before
    E.run_sync(fresh, ev, data.START, data.CHECKPOINTS[2:])
    assert line_of(fresh, 7) == BUSY


def test_a_batch_run_again_in_another_year_replaces_the_first_attempt(spark, store):
    ev = data.events(spark)
    E.run_sync(store, ev, data.START, data.CHECKPOINTS[:1])
    half = ev.filter("rev_id <> 59")

    def attempt(events, at):
        s = Store(spark, store.path)
        s.commit = lambda *a, **k: None            # a crash just before the commit row
        E.sync_step(s, events, data.START, data.CUTOFFS[1], at, 2)

    attempt(ev, "2019-12-31 23:59:59")
    attempt(half, "2020-01-01 00:00:01")
    fresh = Store(spark, store.path)
    once = Store(spark, store.path + "-once")
    E.run_sync(once, ev, data.START, data.CHECKPOINTS[:1])
    for s in (fresh, once):
        E.sync_step(s, ev, data.START, data.CUTOFFS[1], "2020-06-01 00:00:00", 2)
    cols = ["entity", "rev_id", "valid_from", "valid_to", "row_end"]
    assert sorted(map(tuple, fresh.versions().select(cols).collect())) == sorted(map(tuple, once.versions().select(cols).collect()))
    with pytest.raises(ValueError, match="committed"):
        fresh.begin(2)


def test_clean_up_keeps_what_readers_see(spark, store):
    E.run_sync(store, data.events(spark), data.START, data.CHECKPOINTS)
    before, state = sorted(map(tuple, store.versions().collect())), sorted(map(tuple, store.state().collect()))
    store.clean_up()
    again = Store(spark, store.path)
    assert sorted(map(tuple, again.versions().collect())) == before and sorted(map(tuple, again.state().collect())) == state


def test_a_step_writes_the_open_rows_it_began(spark, rows):
    store = Store(spark, new_table_path(spark, "store"), snapshot_every=3)
    schema = "entity bigint, rev_id bigint, ts timestamp_ntz"
    raw = [(e, e, ts("2015-03-01")) for e in range(200)]
    fresh = {2: [(e, 1000 + e, ts("2016-03-01")) for e in range(10)], 3: [(e, 2000 + e, ts("2017-03-01")) for e in range(5, 12)],
             4: [(7, 3000, ts("2018-03-01"))]}
    done = []
    for n, end in enumerate(data.CUTOFFS, 1):
        done += raw if n == 1 else fresh[n]
        E.sync_step(store, spark.createDataFrame(done, schema), data.START, end, f"2019-02-0{n} 12:00:00", n)
        newest = {e: r for e, r, _ in done}
        assert rows(store.open_rows(), "entity", "rev_id") == sorted(newest.items())
        wrote = spark.read.parquet(f"{store.path}/{'open_all' if n == 3 else 'open'}/batch_id={n}").count()
        assert wrote == {1: 200, 2: 10, 3: 200, 4: 1}[n]
    before = rows(store.versions())
    store.clean_up()
    assert rows(Store(spark, store.path).versions()) == before
    kept = {name: [b for b in range(1, 5) if store._exists(f"{name}/batch_id={b}")] for name in ("open", "open_all")}
    assert kept == {"open": [4], "open_all": [3]}


def test_hidden_and_stored_events_fail_nothing(spark, store, rows):
    good = data.events(spark)
    assert E.run_sync(store, good, data.START, data.CHECKPOINTS) == "succeeded"
    bad = good.withColumn("sha1", F.lit("0" * 40))
    assert E.run_sync(store, bad, data.START, [(data.END, "2019-03-01 00:00:00")], run_id=2) == "succeeded"
    assert rows(store.runs().filter("run_id = 2"), "entity", "status", "reason") == [(None, "succeeded", None)]


def test_failed_entities_are_logged_with_a_reason(spark, store, rows):
    bad = data.events(spark).withColumn("sha1", F.when(F.col("rev_id") == 63, F.lit("0" * 40)).otherwise(F.col("sha1")))
    E.run_sync(store, bad, data.START, data.CHECKPOINTS, run_id=4)
    assert rows(store.runs().filter("entity is not null"), "entity", "status", "reason") == [(7, "failed", "digest mismatch, revision 63")]
    with pytest.raises(ValueError, match="empty"):
        E.run_sync(store, bad, data.END, [(data.START, "2019-03-01 00:00:00")])


def test_texts_of_the_store_can_be_packed_and_looked_up(spark, store):
    from twinclock.operators import content as G

    E.run_sync(store, data.events(spark), data.START, data.CHECKPOINTS)
    assert G.pack_texts(store.texts()).count() == store.texts().count() > 0
    assert {r[0] for r in store.events().select("content_status").distinct().collect()} <= {"available", "hidden"}


def test_lower_bound_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    data.events(spark).select("entity", "rev_id", "ts").write.parquet(path)
    ev = spark.read.parquet(path)
    entities = ev.select("entity").distinct()
    state = entities.select("entity", F.lit("2010-01-01").cast("timestamp_ntz").alias("synced_from"), F.lit("2017-01-01").cast("timestamp_ntz").alias("synced_through"))
    read = E.events_to_read(ev, state, data.START, "2018-12-01 00:00:00", entities)
    plan = read._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2017-01-01" in plan
    want = ev.filter("ts >= timestamp_ntz '2017-01-01' and ts <= timestamp_ntz '2018-12-01'").count()
    assert read.count() == want > 0


def test_late_events_in_random_order_end_in_the_same_timeline(spark, store, rows):
    raw = data.random_events(n=120, seed=9)
    random.Random(9).shuffle(raw)
    ev = spark.createDataFrame(raw, data.EVENT_SCHEMA)
    for i in range(3):
        part = spark.createDataFrame(raw[i * 40:(i + 1) * 40], data.EVENT_SCHEMA)
        E.sync_step(store, part, "1000-01-01 00:00:00", "2020-12-31 00:00:00", f"2021-01-0{i + 1} 00:00:00", i + 1, whole_input=True)
    assert rows(store.current(), "entity", "rev_id", "valid_from", "valid_to") == data.brute_timeline(raw)
    bad = store.versions().filter(F.col("row_start") >= F.col("row_end"))
    assert bad.count() == 0
    # what was believed after the first batch is still there
    first = rows(D.as_of(store.versions(), "2021-01-01 00:00:00"), "entity", "rev_id", "valid_from", "valid_to")
    assert first == data.brute_timeline(raw[:40])
    assert ev.count() == store.events().count()


# ---- cut-offs, ranges, state ---------------------------------------------------------------------

def test_cutoffs(spark, rows):
    d = datetime
    assert [str(c) for c in instants.sync_cutoffs(ts(data.START), ts(data.END), 12)] == data.CUTOFFS
    assert instants.sync_cutoffs(d(2021, 1, 1), d(2022, 1, 1), 0) == [d(2022, 1, 1)]
    assert instants.sync_cutoffs(d(2021, 1, 31), d(2021, 4, 1), 1) == [d(2021, 2, 28), d(2021, 3, 31), d(2021, 4, 1)]
    for start, end, m in ((d(2021, 1, 31), d(2021, 6, 15), 1), (ts(data.START), ts(data.END), 12), (d(2021, 1, 1), d(2021, 1, 2), 3), (d(2021, 1, 1), d(2022, 1, 1), 0)):
        bounds = spark.createDataFrame([(start, end)], "start timestamp_ntz, end timestamp_ntz")
        assert [r[0] for r in rows(instants.cutoff_rows(bounds, m), "cutoff")] == instants.sync_cutoffs(start, end, m)


def test_parse_instant(spark):
    good = {"2023-05-01": "2023-05-01", "2023-05-01T14:30": "2023-05-01 14:30:00", "2023-05-01 14:30:05": "2023-05-01 14:30:05",
            "2023-05-01T14:30:00Z": "2023-05-01 14:30:00", "2023-05-01T14:30:00+02:00": "2023-05-01 12:30:00",
            "2023-05-01T23:30:00-14:59": "2023-05-02 14:29:00", "2024-02-29": "2024-02-29", " 2023-05-01 ": "2023-05-01"}
    bad = {"": "required", None: "required", "x" * 41: "length", "2023-5-1": "format", "2023-05-01T14:30:00.5Z": "format", "2023-02-30": "calendar",
           "2023-13-01": "calendar", "2023-05-01T24:00": "calendar", "2023-05-01T10:60": "calendar", "2023-05-01T10:00+15:00": "offset",
           "2023-05-01T10:00+10:60": "offset", "0999-01-01": "range", "9999-01-01": "range", "now": "format"}
    df = spark.createDataFrame([(s,) for s in [*good, *bad]], "s string")
    got = {r["s"]: (r["instant"], r["error"]) for r in df.select("s", instants.parse_instant("s").alias("p")).select("s", "p.*").collect()}
    assert {s: got[s] for s in good} == {s: (ts(v), None) for s, v in good.items()}
    assert {s: got[s][1] for s in bad} == bad


def test_the_session_zone_plays_no_part(spark, rows):
    df = spark.createDataFrame([("2023-03-26T02:30:00Z",), ("\t2023-05-01\u00a0",), ("2023-05-01\n\n",)], "s string")
    days = spark.createDataFrame([(1, ts("2023-03-26 00:30:00")), (1, ts("2023-03-26 23:30:00"))], "entity bigint, ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [r[0]["instant"] for r in df.select(instants.parse_instant("s")).collect()]
        counted = rows(jobs.edit_counts(days, "1 day"), "day", "edits")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [ts("2023-03-26 02:30:00"), ts("2023-05-01"), ts("2023-05-01")]
    assert counted == [(ts("2023-03-26").date(), 2)]


def test_coverage_is_closed_on_both_ends(spark, rows):
    df = spark.createDataFrame([(ts(x),) for x in (data.START, data.END, "2014-12-31 23:59:59", "2019-01-01")], "t timestamp_ntz")
    assert [r[0] for r in df.select(instants.coverage_error("t", data.START, data.END)).collect()] == [None, None, "OUT_OF_COVERAGE", "OUT_OF_COVERAGE"]


def test_resume_ranges_and_state(spark, rows):
    ents = spark.createDataFrame([(1,), (2,), (3,)], "entity bigint")
    state = spark.createDataFrame([(2, ts("2022-01-01"), ts("2023-01-01"), 1), (3, ts("2021-01-01"), ts("2024-01-01"), 1)],
                                  "entity bigint, synced_from timestamp_ntz, synced_through timestamp_ntz, last_batch bigint")
    got = rows(E.resume_ranges(ents, state, "2021-01-01 00:00:00", "2024-01-01 00:00:00"))
    assert got == [(1, ts("2021-01-01"), ts("2024-01-01"), True), (2, ts("2021-01-01"), ts("2022-01-01"), True), (2, ts("2023-01-01"), ts("2024-01-01"), False)]
    up = E.state_upsert(state, ents.select("entity", F.lit("2021-06-01").cast("timestamp_ntz").alias("synced_from"), F.lit("2023-06-01").cast("timestamp_ntz").alias("synced_through")), 2)
    assert rows(up) == [(1, ts("2021-06-01"), ts("2023-06-01"), 2), (2, ts("2021-06-01"), ts("2023-06-01"), 2), (3, ts("2021-01-01"), ts("2024-01-01"), 2)]


def test_status():
    assert [E.run_status(3, n) for n in (0, 1, 3)] == ["succeeded", "partial", "failed"]


# ---- feed ----------------------------------------------------------------------------------------

def test_read_revisions_hides_what_is_hidden(spark, tmp_path):
    f = tmp_path / "feed.json"
    f.write_text("\n".join(data.feed_lines()))
    got = {r["rev_id"]: r for r in R.read_revisions(spark, str(f)).collect()}
    assert len(got) == 13 and got[31]["parent_rev_id"] is None and got[44]["parent_rev_id"] == 31
    assert got[44]["is_minor"] and got[44]["comment"] == "" and got[44]["editor"] == "ann"
    h = got[data.HIDDEN]
    assert (h["editor"], h["comment"], h["sha1"], h["editor_hidden"], h["comment_hidden"], h["content_hidden"]) == (None, None, None, True, True, True)
    assert got[63]["ts"] == ts("2016-03-04 14:14:21")


def test_read_curated_keeps_the_order(spark, tmp_path, rows):
    f = tmp_path / "curated.json"
    f.write_text('[{"title": "B", "domain": "x"},\n {"title": "A", "domain": "y"}]')
    assert rows(R.read_curated(spark, str(f))) == [(0, "B", "x"), (1, "A", "y")]


def test_slices_baseline_and_texts(spark, rows):
    ev = data.events(spark)
    assert rows(R.baseline(ev, data.START), "rev_id") == [(5,), (31,)]
    assert R.window_slice(ev, data.START, data.END).count() == 11
    at_start = ev.filter("rev_id = 44")
    merged = R.merge_slices(R.window_slice(at_start, "2015-02-11 07:45:10", data.END), R.baseline(at_start, "2015-02-11 07:45:10"))
    assert rows(merged, "rev_id", "is_baseline") == [(44, True)]
    texts = R.new_texts(ev, ev.limit(0))
    assert texts.count() == 11 and (47,) in rows(texts, "rev_id") and (70,) not in rows(texts, "rev_id")
    fetched = ev.filter("rev_id = 47").select("sha1", F.lit(True).alias("hidden_now"))
    status = dict(rows(R.with_content_status(ev, fetched), "rev_id", "content_status"))
    assert status[47] == status[70] == status[82] == "hidden" and status[95] == "available"


# ---- streams -------------------------------------------------------------------------------------

SCHEMA = "entity bigint, rev_id bigint, ts timestamp_ntz"


def clock(n):
    return f"2030-01-{n:02d} 00:00:00"


def test_stream_with_late_files_and_a_restart(spark, store, tmp_path, rows):
    landing, check = str(tmp_path / "in"), str(tmp_path / "ck")
    raw = [(e, r, t) for e, r, t, *_ in data.random_events(n=90, seed=10)]
    random.Random(3).shuffle(raw)
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        jobs.stream_sync(jobs.read_event_stream(spark, landing, schema, 1), store, check, clock).awaitTermination()

    for i in range(2):
        spark.createDataFrame(raw[i * 30:(i + 1) * 30], schema).coalesce(1).write.mode("append").parquet(landing)
    run()
    assert store.refresh() >= 2
    seen = store.versions().count()
    run()                                           # nothing new: nothing changes
    assert store.versions().count() == seen
    spark.createDataFrame(raw[60:], schema).coalesce(1).write.mode("append").parquet(landing)
    run()
    assert rows(store.current(), "entity", "rev_id", "valid_from", "valid_to") == data.brute_timeline([(*r, "a", 1) for r in raw])


def test_replayed_batch_changes_nothing(spark, store, tmp_path):
    landing = str(tmp_path / "in")
    data.events(spark).select("entity", "rev_id", "ts").coalesce(1).write.parquet(landing)
    schema = spark.createDataFrame([], SCHEMA).schema
    for attempt in ("a", "b"):                      # a lost checkpoint folder replays batch 0
        jobs.stream_sync(jobs.read_event_stream(spark, landing, schema), store, str(tmp_path / attempt), clock).awaitTermination()
    assert store.versions().count() == 12 and store.refresh() == 1


def test_stream_counts_add_up(spark, tmp_path, rows):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev = data.events(spark).select("entity", "rev_id", "ts")
    for half in ("rev_id < 60", "rev_id >= 60"):
        ev.filter(half).coalesce(1).write.mode("append").parquet(landing)
    stream = jobs.read_event_stream(spark, landing, ev.schema, 1)
    jobs.write_counts(jobs.edit_counts(stream, "4000 days"), out, str(tmp_path / "ck")).awaitTermination()
    from twinclock.operators.lookups import edits_per_month
    want = rows(edits_per_month(ev, "2000-01-01 00:00:00", "2030-01-01 00:00:00"))
    assert rows(jobs.monthly(spark, out)) == want


def test_lateness(spark, rows):
    state = spark.createDataFrame([(7, ts("2016-06-01"))], "entity bigint, synced_through timestamp_ntz")
    assert rows(jobs.lateness(data.events(spark), state)) == [(6, 9)]


def test_month_step_clamps():
    assert instants.month_step(datetime(2024, 1, 31), 1) == datetime(2024, 2, 29)
    assert instants.month_step(datetime(2023, 11, 30), 3) - timedelta(0) == datetime(2024, 2, 29)
