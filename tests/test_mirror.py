import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import ts
from twinclock.operators import systime as D
from twinclock.session import new_table_path
from twinclock.sources.mirror import Mirror

LOG = "entity bigint, rev_id bigint, ts timestamp_ntz, op string, v string"
CUTS = ["2022-01-10", "2022-01-20", "2022-01-25", "2022-02-10"]


def random_log(seed, n=300):
    rnd = random.Random(seed)
    return [(rnd.randrange(25), i, ts(f"2022-{rnd.choice([1, 2]):02}-{rnd.randrange(1, 11):02}" if rnd.random() < .2 else f"2022-01-{rnd.randrange(1, 32):02}"),
             rnd.choice("UUUD"), rnd.choice("abc")) for i in range(n)]


def batches(raw):
    cuts = [ts("1970-01-01"), *[ts(c) for c in CUTS]]
    return [(cuts[i + 1], [r for r in raw if cuts[i] < r[2] <= cuts[i + 1]]) for i in range(len(CUTS))]


def test_batches_give_the_versions_of_the_whole_log(spark, rows):
    raw = random_log(2)
    mirror = Mirror(spark, new_table_path(spark, "mirror"), snapshot_every=2)
    done = []
    for n, (end, part) in enumerate(batches(raw), 1):
        assert mirror.apply(n, spark.createDataFrame(part, LOG), end)
        done += part
        want = D.scd2_with_deletes(spark.createDataFrame(done, LOG))
        assert rows(mirror.all(), *want.columns) == rows(want)
        assert rows(mirror.current(), *want.columns) == rows(D.current(want))
    assert rows(mirror.as_of("2022-01-15 00:00:00"), *want.columns) == rows(D.as_of(want, "2022-01-15 00:00:00"))
    assert rows(Mirror(spark, mirror.path).all(), *want.columns) == rows(want)      # opened again


def test_a_batch_writes_what_it_changed(spark):
    mirror = Mirror(spark, new_table_path(spark, "mirror"))
    first = [(e, e, ts("2022-01-01"), "U", "a") for e in range(500)]
    mirror.apply(1, spark.createDataFrame(first, LOG), "2022-01-10 00:00:00")
    fresh = [(e, 1000 + e, ts("2022-01-11"), "D" if e < 3 else "U", "b") for e in range(10)]
    mirror.apply(2, spark.createDataFrame(fresh, LOG), "2022-01-20 00:00:00")
    got = mirror.commits().filter("batch_id = 2").first()
    assert (got["changes"], got["opened"], got["closed"], got["gone"], got["carried"]) == (10, 7, 10, 3, 0)
    assert spark.read.parquet(f"{mirror.path}/versions").filter("batch_id = 2").count() == 20
    assert mirror.current().count() == 497


def test_repeated_and_interrupted_batches(spark, rows):
    raw = random_log(9)
    (e1, b1), (e2, b2), (e3, b3), _ = batches(raw)
    mirror = Mirror(spark, new_table_path(spark, "mirror"))
    mirror.apply(1, spark.createDataFrame(b1, LOG), e1)
    # an attempt at batch 2 that wrote other years and rows, and died before its commit row
    stray = mirror.current().withColumns({"gone": F.lit(False), "end_year": F.lit("1987"), "batch_id": F.lit(2)})
    for year in ("1987", "CURRENT"):
        stray.withColumn("end_year", F.lit(year)).write.mode("append").partitionBy("end_year", "batch_id").parquet(f"{mirror.path}/versions")
    want = D.scd2_with_deletes(spark.createDataFrame(b1, LOG))
    assert rows(Mirror(spark, mirror.path).all(), *want.columns) == rows(want)
    assert mirror.apply(2, spark.createDataFrame(b2, LOG), e2)
    assert not mirror.apply(2, spark.createDataFrame(b3, LOG), e3)
    mirror.apply(3, spark.createDataFrame(b3, LOG), e3)
    assert not mirror.apply(2, spark.createDataFrame(b2, LOG), e2)
    want = D.scd2_with_deletes(spark.createDataFrame(b1 + b2 + b3, LOG))
    assert rows(mirror.all(), *want.columns) == rows(want)


def test_empty_batches_and_refusals(spark, rows):
    mirror = Mirror(spark, new_table_path(spark, "mirror"), 2)
    none = spark.createDataFrame([], LOG)
    assert mirror.apply(1, none, "2022-01-01 00:00:00")
    with pytest.raises(ValueError, match="no versions"):
        mirror.all()
    one = [(1, 1, ts("2022-01-02"), "U", None), (2, 2, ts("2022-01-02"), "D", "x")]
    assert mirror.apply(2, spark.createDataFrame(one, LOG), "2022-01-05 00:00:00")
    assert mirror.apply(3, none, "2022-01-06 00:00:00")
    assert mirror.apply(4, none, "2022-01-07 00:00:00")
    assert rows(mirror.all(), "entity", "rev_id", "v") == [(1, 1, None)]
    late = spark.createDataFrame([(1, 3, ts("2022-01-07"), "U", "b")], LOG)
    with pytest.raises(ValueError, match="do not lie after"):
        mirror.apply(5, late, "2022-01-09 00:00:00")
    with pytest.raises(ValueError, match="not after"):
        mirror.apply(5, none, "2022-01-07 00:00:00")
    with pytest.raises(ValueError, match="follow"):
        mirror.apply(6, none, "2022-01-09 00:00:00")
    with pytest.raises(ValueError, match="without entity"):
        mirror.apply(5, spark.createDataFrame([(None, 3, ts("2022-01-08"), "U", "b")], LOG), "2022-01-09 00:00:00")
    with pytest.raises(ValueError, match="names of the mirror"):
        mirror.apply(5, none.withColumn("gone", F.lit(1)), "2022-01-09 00:00:00")
    assert rows(mirror.all(), "entity", "rev_id", "v") == [(1, 1, None)]
