from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests import data
from tests.conftest import ts
from twinclock.operators import systime as D
from twinclock.operators import timelines as B
from twinclock.plans.reader import TemporalReader, lab, middle
from twinclock.session import new_table_path
from twinclock.sources.layout import VersionTable

MAX = datetime(2106, 2, 7, 6, 28, 15, 999999)
LOG = "entity bigint, rev_id bigint, ts timestamp_ntz, v string"


@pytest.fixture
def versions(spark):
    log = spark.createDataFrame([(1, 100, ts("2022-01-01"), "a"), (1, 200, ts("2022-02-01"), "b"), (1, 300, ts("2023-03-01"), "c")], LOG)
    return D.scd2_from_log(log)


def test_as_of_between_and_from_to(versions, rows):
    assert rows(D.as_of(versions, "2022-01-31 23:59:59"), "rev_id") == [(100,)]
    assert rows(D.as_of(versions, "2022-02-01 00:00:00"), "rev_id") == [(200,)]
    assert rows(D.as_of(versions, "2021-06-01 00:00:00"), "rev_id") == []
    a, b = "2022-01-15 00:00:00", "2023-03-01 00:00:00"
    assert rows(D.between(versions, a, b), "rev_id") == [(100,), (200,), (300,)]
    assert rows(D.from_to(versions, a, b), "rev_id") == [(100,), (200,)]


def test_current_and_superseded(versions, rows):
    assert rows(D.current(versions), "rev_id", "row_end") == [(300, MAX)]
    assert rows(D.superseded(versions), "rev_id") == [(100,), (200,)]
    assert rows(D.stop_versioning(versions)) == [(1, 300, "c")]
    assert rows(D.history_growth(versions.withColumn("size_bytes", F.lit(5)))) == [(2022, 1, 5), (2023, 1, 5)]


@pytest.mark.parametrize("max_rows", [None, 25])
def test_log_with_slices(spark, rows, max_rows):
    raw = data.random_events(seed=6)
    got = D.scd2_from_log(spark.createDataFrame(raw, data.EVENT_SCHEMA), max_rows=max_rows)
    want = [(e, r, a, MAX if z == data.INF else z) for e, r, a, z in data.brute_timeline(raw)]
    assert rows(got, "entity", "rev_id", "row_start", "row_end") == want


def brute_changes(raw):
    out = []
    visible = {r[1] for r in data.brute_timeline(raw)}
    for e in {r[0] for r in raw}:
        kept = []
        for r in sorted((r for r in raw if r[0] == e and r[1] in visible), key=lambda r: r[2]):
            if not kept or kept[-1][3] != r[3]:
                kept.append(r)
        out += [(e, r[1], r[3], r[2], kept[i + 1][2] if i + 1 < len(kept) else MAX) for i, r in enumerate(kept)]
    return sorted(out)


@pytest.mark.parametrize("max_rows", [None, 25])
def test_noops_make_no_version(spark, rows, max_rows):
    raw = data.random_events(seed=7)
    ev = spark.createDataFrame(raw, data.EVENT_SCHEMA).drop("size_bytes")
    assert rows(D.scd2_from_log(ev, keep_noops=False, max_rows=max_rows)) == brute_changes(raw)


def test_same_instant_insert_update_delete(spark, rows):
    log = spark.createDataFrame([(1, 1, ts("2024-01-01"), "1", "I"), (1, 2, ts("2024-01-01"), "2", "U"), (1, 3, ts("2024-01-01"), None, "D")], LOG + ", op string")
    assert rows(D.scd2_with_deletes(log), "v", "row_start", "row_end") == [("2", ts("2024-01-01"), ts("2024-01-01"))]


def test_delete_closes_and_reinsert_opens(spark, rows):
    log = spark.createDataFrame([(1, 1, ts("2024-01-01"), "1", "I"), (1, 2, ts("2024-02-01"), None, "D"), (1, 3, ts("2024-03-01"), "3", "I")], LOG + ", op string")
    assert rows(D.scd2_with_deletes(log), "v", "row_start", "row_end") == [("1", ts("2024-01-01"), ts("2024-02-01")), ("3", ts("2024-03-01"), MAX)]


def test_one_version_per_commit(spark, rows):
    log = spark.createDataFrame([(1, 1, 1, "10"), (1, 2, 2, "11"), (1, 3, 2, "12")], "entity bigint, rev_id bigint, commit_id int, v string")
    v = D.versions_per_commit(log)
    assert rows(v, "v", "commit_start", "commit_end") == [("10", 1, 2), ("12", 2, None)]
    assert rows(D.as_of_commit(v, 2), "v") == [("12",)] and rows(D.as_of_commit(v, 1), "v") == [("10",)]


@pytest.mark.parametrize("max_rows", [None, 1])
def test_untracked_columns_make_no_version(spark, rows, max_rows):
    log = spark.createDataFrame([(1, 1, ts("2024-01-01"), "a", 0), (1, 2, ts("2024-01-02"), "a", 1), (1, 3, ts("2024-01-03"), "b", 1)],
                                "entity bigint, rev_id bigint, ts timestamp_ntz, title string, views int")
    got = rows(D.scd2_tracking(log, ["title"], ["views"], max_rows), "title", "views", "row_start", "row_end")
    assert got == [("a", 1, ts("2024-01-01"), ts("2024-01-03")), ("b", 1, ts("2024-01-03"), MAX)]


def test_load_stamped_table_knows_nothing_of_the_past(spark):
    loaded = D.load_stamped(data.events(spark), "2019-10-01 00:00:00")
    assert D.as_of(loaded, "2016-01-01 00:00:00").count() == 0 and D.as_of(loaded, "2019-10-02 00:00:00").count() == 3


def test_rows_seconds_apart_and_beliefs(spark, rows):
    line = data.intervals(spark, [(1, 59, "2016-03-04 14:14:14", "2016-03-04 14:14:21"), (1, 63, "2016-03-04 14:14:21", "2017-05-05"),
                                  (1, 70, "2017-05-05", "9999-12-31 23:59:59")])
    assert rows(B.interval_at(line, "2016-03-04 14:14:20"), "rev_id") == [(59,)]
    assert rows(B.interval_at(line, "2016-03-04 14:14:21"), "rev_id") == [(63,)]
    v = D.start_versioning(line, "2019-01-01 00:00:00")
    assert D.believed_at(v, "2018-12-01 00:00:00", "2018-06-01 00:00:00").count() == 0
    assert rows(D.believed_at(v, "2019-01-01 00:00:00", "2018-06-01 00:00:00"), "rev_id") == [(70,)]


def test_reader_default_and_override(spark, versions):
    reader = TemporalReader(spark, "2000-01-01 00:00:00").register("reader_test", versions)
    assert reader.sql("select * from reader_test").count() == 0
    assert reader.all("reader_test").count() == 3 and reader.as_of("reader_test", "2022-02-01 00:00:00").count() == 1
    reader.set_default(None)
    assert [r["rev_id"] for r in reader.sql("select rev_id from reader_test").collect()] == [300]


def test_lab_bundle(spark, rows):
    from twinclock.plans.sync import backfill_beliefs
    ev = data.events(spark)
    line, mirror = B.build_timeline(ev), D.scd2_from_log(ev.select("entity", "rev_id", "ts"))
    out = lab(line, ev, backfill_beliefs(ev, data.CHECKPOINTS), mirror, data.CHECKPOINTS, data.START, data.END, "2018-01-01 00:00:00", 7)
    assert set(out) == {"app", "all", "as_of", "bitemporal", "between", "mirror_as_of", "mirror_between", "mirror_all"}
    assert rows(out["app"], "rev_id") == [(82,)] and rows(out["mirror_as_of"], "rev_id") == [(82,)]
    assert rows(out["bitemporal"], "knowledge", "rev_id") == [("first checkpoint", 47), ("now", 82)]
    assert out["all"].count() == 11 and rows(out["mirror_between"], "rev_id") == [(82,), (95,)]
    assert middle("2020-01-01 00:00:00", "2020-01-03 00:00:00") == "2020-01-02 00:00:00"


# ---- version table -------------------------------------------------------------------------------

@pytest.fixture
def retention(spark):
    log = spark.createDataFrame([(1, 101, ts("2021-03-01")), (2, 201, ts("2021-03-01")), (1, 102, ts("2022-03-01") ), (1, 103, ts("2023-03-01")),
                                 (2, 202, ts("2023-09-01")), (1, 104, ts("2024-03-01"))], "entity bigint, rev_id bigint, ts timestamp_ntz")
    table = VersionTable(spark, new_table_path(spark, "retention"))
    table.append(D.scd2_from_log(log))
    return table


def test_retention_by_year_and_by_cutoff(retention, rows):
    assert retention.all().count() == 6
    assert rows(retention.as_of("2022-06-01 00:00:00").filter("entity = 1"), "rev_id") == [(102,)]
    retention.drop_years_before(2023)
    assert rows(retention.all(), "rev_id") == [(102,), (103,), (104,), (201,), (202,)]
    retention.retain_since("2024-01-01 00:00:00")
    assert rows(retention.all(), "rev_id") == [(103,), (104,), (202,)]
    assert retention.current().count() == 2


def test_clean_up_rewrites_only_the_edge(retention, rows):
    retention.retain_since("2023-06-01 00:00:00")
    retention.clean_up()
    assert rows(retention._raw(), "rev_id") == [(103,), (104,), (201,), (202,)]
    retention.clean_up()
    assert rows(retention.all(), "rev_id") == [(103,), (104,), (201,), (202,)]


def test_as_of_reads_only_partitions_that_can_answer(retention):
    plan = retention.as_of("2023-06-01 00:00:00")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(end_year" in plan and ">= 2023)" in plan


@pytest.mark.parametrize("granularity", ["none", "year", "month"])
def test_layouts_agree(spark, rows, granularity):
    versions = D.scd2_from_log(data.events(spark).select("entity", "rev_id", "ts"))
    table = VersionTable(spark, new_table_path(spark, "layout"), granularity)
    table.append(versions)
    for s in ("2012-06-01 00:00:00", "2016-03-04 14:14:14", "2018-12-01 00:00:00"):
        assert rows(table.as_of(s)) == rows(D.as_of(versions, s))
    assert rows(table.between("2016-01-01 00:00:00", "2017-05-05 16:00:00")) == rows(D.between(versions, "2016-01-01 00:00:00", "2017-05-05 16:00:00"))
    assert rows(table.current()) == rows(D.current(versions))


def _scans(df):
    """Tables read by the plan; the few split points of hot keys do not count."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return sum("FileScan" in line and "hot-splits" not in line for line in lines)


@pytest.mark.parametrize("name", ["cross_check", "scd2_tracking", "neighbours", "noops"])
def test_a_hot_key_does_not_multiply_the_plan(spark, name, tmp_path):
    from twinclock.operators import lookups as L
    from twinclock.operators import timelines as B

    path = str(tmp_path / "log")
    spark.createDataFrame(data.random_events(), data.EVENT_SCHEMA).write.parquet(path)
    ev = spark.read.parquet(path)
    extra = [c for c in ev.columns if c not in ("entity", "rev_id", "ts")]
    line = D.scd2_from_log(ev).select("entity", "rev_id", F.col("row_start").alias("valid_from"), F.col("row_end").alias("valid_to"))
    line.write.parquet(path + "-line")
    line = spark.read.parquet(path + "-line")
    probes = line.select((F.col("rev_id") * 2).alias("probe_id"), "entity", F.col("valid_from").alias("t"))
    out, most = {
        "cross_check": lambda: (D.cross_check(line, D.start_versioning(ev.select("entity", "rev_id"), "2000-01-01 00:00:00"), probes, 40, "carry"), 5),
        "scd2_tracking": lambda: (D.scd2_tracking(ev, extra[:1], extra[1:], 40), 3),
        "neighbours": lambda: (L.neighbours(line, data.START, data.END, 40), 3),
        "noops": lambda: (D.scd2_from_log(ev, keep_noops=False, max_rows=40), 3)}[name]()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")   # whole folder names in the plan
    try:
        assert _scans(out) <= most
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
