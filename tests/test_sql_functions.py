from tests import data
from tests.conftest import ts
from twinclock.operators import lookups as L
from twinclock.operators import systime as D
from twinclock.operators import timelines as B
from twinclock.plans.reader import define_functions

PROBE = "probe_id bigint, entity bigint, t timestamp_ntz"


def some_probes(raw):
    """Every event instant of its entity and of another one, an instant before all, and one without an entity."""
    out = [(i * 2 + k, r[0] + k, r[2]) for i, r in enumerate(raw) for k in (0, 1)]
    return [*out, (100_001, raw[0][0], ts("1900-01-01")), (100_002, None, ts("2020-01-01")), (100_003, raw[0][0], None)]


def test_bucket_join_equals_the_join(spark, rows):
    raw = data.random_events(seed=3)
    line = B.build_timeline(spark.createDataFrame(raw, data.EVENT_SCHEMA))
    probes = spark.createDataFrame(some_probes(raw), PROBE)
    assert rows(L.revisions_at(line, probes, "bucket")) == rows(L.revisions_at(line, probes, "join"))
    none = probes.limit(0)
    assert rows(L.revisions_at(line, none, "bucket")) == []


def test_functions_and_lateral(spark, rows):
    raw = data.random_events(seed=4)
    events = spark.createDataFrame(raw, data.EVENT_SCHEMA)
    line = B.build_timeline(events)
    versions = D.start_versioning(line, "2030-01-01 00:00:00")
    define_functions(spark, line, versions, "t_")
    at = sorted(r[2] for r in raw)[len(raw) // 2]
    assert rows(spark.sql(f"SELECT * FROM t_rev_at(TIMESTAMP_NTZ '{at}')")) == rows(L.snapshot(line, at), "entity", "rev_id", "valid_from", "valid_to")
    assert rows(spark.sql(f"SELECT * FROM t_believed_at(TIMESTAMP_NTZ '2029-01-01 00:00:00', TIMESTAMP_NTZ '{at}')")) == []
    assert spark.sql("SELECT * FROM t_versions_between(TIMESTAMP_NTZ '2029-01-01', TIMESTAMP_NTZ '2031-01-01')").count() == line.count()
    probes = spark.createDataFrame(some_probes(raw), PROBE)
    got = spark.sql("SELECT p.probe_id, p.entity, p.t, r.rev_id FROM {p} p LEFT JOIN LATERAL t_rev_of(p.entity, p.t) r", p=probes)
    assert rows(got) == rows(L.revisions_at(line, probes, "join"), "probe_id", "entity", "t", "rev_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_trail_is_ordered(spark, rows):
    log = [(1, 10, ts("2022-01-03"), "c"), (1, 30, ts("2022-01-01"), "a"), (1, 20, ts("2022-01-02"), None), (2, 5, ts("2022-01-01"), "x")]
    versions = D.scd2_from_log(spark.createDataFrame(log, "entity bigint, rev_id bigint, ts timestamp_ntz, v string"))
    assert rows(D.trail(versions)) == [(1, "30 20 10", 3), (2, "5", 1)]
    assert rows(D.trail(versions, "v", ">")) == [(1, "a>c", 3), (2, "x", 1)]
