import random
import re

import pytest

from tests.conftest import ts
from twinclock.session import new_table_path
from twinclock.sources.ordered import read_in_order, write_in_order

EV = "entity bigint, rev_id bigint, ts timestamp_ntz, v string"


def test_order_and_going_on(spark, rows):
    rnd = random.Random(5)
    # a third of the rows share one instant and one entity
    raw = [(0 if i % 3 == 0 else rnd.randrange(20), i, ts("2022-01-05") if i % 3 == 0 else ts(f"2022-01-{rnd.randrange(1, 28):02}"), "x") for i in range(900)]
    rnd.shuffle(raw)
    path = new_table_path(spark, "ordered")
    write_in_order(spark.createDataFrame(raw, EV).repartition(3), path, 100)
    want = [(p, e, r) for p, (_, r, e) in enumerate(sorted((t, r, e) for e, r, t, _ in raw), 1)]
    whole = read_in_order(spark, path)
    assert rows(whole, "place", "entity", "rev_id") == want
    sizes = rows(spark.read.parquet(f"{path}/bounds"), "part", "n")
    assert len(sizes) == 9 and max(n for _, n in sizes) < 300
    by_place = {(r): (t, r) for e, r, t, _ in raw}
    position = by_place[want[599][2]]
    later = read_in_order(spark, path, position)
    assert rows(later, "place", "entity", "rev_id") == want[600:]
    # earlier parts are not opened
    plan = later._jdf.queryExecution().executedPlan().toString()
    start = re.search(r"PartitionFilters: \[[^]]*part#\d+ >= (\d+)", plan)
    assert start and int(start[1]) >= 3
    assert rows(read_in_order(spark, path, ("2030-01-01 00:00:00", 0))) == []


def test_edges(spark, rows):
    path = new_table_path(spark, "ordered")
    write_in_order(spark.createDataFrame([(None, 1, None, "a"), (1, 1, ts("2022-01-01"), None), (1, 1, ts("2022-01-01"), None)], EV), path)
    assert rows(read_in_order(spark, path), "place", "entity", "v") == [(1, None, "a"), (2, 1, None), (3, 1, None)]
    empty = new_table_path(spark, "ordered")
    write_in_order(spark.createDataFrame([], EV), empty)
    assert rows(read_in_order(spark, empty)) == [] and rows(read_in_order(spark, empty, ("2022-01-01 00:00:00", 1))) == []
    with pytest.raises(ValueError, match="names of the order"):
        write_in_order(spark.createDataFrame([], EV + ", place int"), empty)
