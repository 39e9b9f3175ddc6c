"""Queries for the measurement jobs."""

from pyspark.sql import functions as F

from twinclock.operators import measure as M
from twinclock.operators import systime as D
from twinclock.operators import timelines as B
from twinclock.operators.content import pick_by_size
from twinclock.plans.sync import backfill_beliefs
from twinclock.registry.app_time import probes_of
from twinclock.registry.core import query
from twinclock.registry.sql import CHECKPOINTS, END, EV, PROBES, START, SYS_MAX, UEV, beliefs, mirror, timeline
from twinclock.session import new_table_path

DRAW = "CAST('0x' || substr(md5({0} || '{1}'), 1, 8) AS BIGINT)"


@query("probe_workload", f"""WITH {EV}, e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS rk, count(*) OVER () AS total FROM (SELECT DISTINCT entity FROM ev)),
  w AS (SELECT date_diff('second', TIMESTAMP '{START}', TIMESTAMP '{END}') + 1 AS span),
  p AS (SELECT range AS probe_id FROM range(2000))
  SELECT probe_id, entity, TIMESTAMP '{START}' + to_seconds({DRAW.format('probe_id', 't42')} % span) AS t
  FROM p, w JOIN e ON rk = {DRAW.format('probe_id', 'e42')} % total""")
def _(t):
    return M.probe_workload(t.orders, 2000, START, END)


@query("strategy_agreement", f"""WITH {EV}, {PROBES} SELECT count(*) AS probes, CAST(0 AS BIGINT) AS join_differs, CAST(0 AS BIGINT) AS events_differs,
  CAST(0 AS BIGINT) AS mirror_differs FROM probes""")
def _(t):
    ev = t.orders
    return M.strategy_agreement(B.build_timeline(ev), ev, D.scd2_from_log(ev), probes_of(ev))


@query("strategy_agreement_bucket", f"""WITH {EV}, {PROBES} SELECT count(*) AS probes, CAST(0 AS BIGINT) AS join_differs, CAST(0 AS BIGINT) AS events_differs,
  CAST(0 AS BIGINT) AS mirror_differs, CAST(0 AS BIGINT) AS bucket_differs FROM probes""")
def _(t):
    ev = t.orders
    return M.strategy_agreement(B.build_timeline(ev), ev, D.scd2_from_log(ev), probes_of(ev), bucket=True)


# The same with every fifth event and every seventh version missing: SQL counts the answers that change.
@query("strategy_agreement_damaged", f"""WITH {EV}, {timeline()}, {PROBES},
  a AS (SELECT probe_id, p.entity, t, rev_id FROM probes p LEFT JOIN tl ON tl.entity = p.entity AND valid_from <= t AND t < valid_to),
  e AS (SELECT probe_id, max(struct_pack(ts := ts, rev_id := rev_id)).rev_id AS rev_id FROM probes p JOIN ev ON ev.entity = p.entity AND ts <= t AND ev.rev_id % 5 <> 0 GROUP BY probe_id)
  SELECT count(*) AS probes, CAST(0 AS BIGINT) AS join_differs, count(*) FILTER (a.rev_id IS DISTINCT FROM e.rev_id) AS events_differs,
         count(*) FILTER (a.rev_id % 7 = 0) AS mirror_differs FROM a LEFT JOIN e USING (probe_id)""")
def _(t):
    ev = t.orders
    return M.strategy_agreement(B.build_timeline(ev), ev.filter("rev_id % 5 <> 0"), D.scd2_from_log(ev).filter("rev_id % 7 <> 0"), probes_of(ev))


@query("scaled_copies", f"""WITH {EV}, {timeline()}, {mirror()} SELECT entity + k * (SELECT max(entity) + 1 FROM ev) AS entity, rev_id, size_bytes, status, priority, row_start, row_end
  FROM mi CROSS JOIN (SELECT unnest(range(4)) AS k)""")
def _(t):
    return M.scaled_copies(D.scd2_from_log(t.orders), 4)


POINT, EARLY, LATE, MONTH = "1998-06-01 00:00:00", "1996-06-01 00:00:00", "2001-06-01 00:00:00", ("1999-03-01 00:00:00", "1999-03-31 23:59:59")


def as_of_sql(s):
    return f"row_start <= TIMESTAMP '{s}' AND row_end > TIMESTAMP '{s}'"


READS = {
    "current_point": f"row_end = {SYS_MAX} AND entity = 7", "current_scan": f"row_end = {SYS_MAX}",
    "asof_point": f"{as_of_sql(POINT)} AND entity = 7", "asof_scan_early": as_of_sql(EARLY), "asof_scan_late": as_of_sql(LATE),
    "between_month": f"row_start <= TIMESTAMP '{MONTH[1]}' AND row_end > TIMESTAMP '{MONTH[0]}'", "all_scan": "true"}


@query("layout_answers", f"WITH {EV}, {timeline()}, {mirror()}, a AS (" + " UNION ALL ".join(
    f"SELECT '{q}' AS query, count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM mi WHERE {c}" for q, c in READS.items())
    + ") SELECT layout, a.* FROM a CROSS JOIN (VALUES ('none'), ('year'), ('month')) v(layout)")
def _(t):
    versions = D.scd2_from_log(t.orders).select("entity", "rev_id", "size_bytes", "row_start", "row_end")
    tables = M.build_layouts(versions, new_table_path(t.spark, "layouts"))
    return M.layout_answers(tables, M.layout_queries(7, POINT, EARLY, LATE, MONTH))


@query("table_counts", f"""WITH {EV}, {timeline()}, {mirror()}, {beliefs()}
  SELECT 'events' AS "table", count(*) AS rows, count(*) AS current, CAST(0 AS BIGINT) AS history FROM ev
  UNION ALL SELECT 'timeline', count(*), count(*) FILTER (WHERE row_end = {SYS_MAX}), count(*) FILTER (WHERE row_end < {SYS_MAX}) FROM bel
  UNION ALL SELECT 'mirror', count(*), count(*) FILTER (WHERE row_end = {SYS_MAX}), count(*) FILTER (WHERE row_end < {SYS_MAX}) FROM mi""")
def _(t):
    return M.table_counts({"events": t.orders, "timeline": backfill_beliefs(t.orders, CHECKPOINTS), "mirror": D.scd2_from_log(t.orders)})


@query("nearest_rank", """SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
  FROM events GROUP BY event_type""")
def _(t):
    return M.nearest_rank(t["events"], "event_type", "value")


@query("pick_by_size", f"""WITH {EV}, s AS (SELECT entity, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS revisions FROM ev GROUP BY entity),
  r AS (SELECT *, row_number() OVER (ORDER BY bytes, entity) - 1 AS rank, count(*) OVER () AS n FROM s)
  SELECT entity, bytes, revisions, rank FROM r WHERE rank IN (floor(0.1 * n), floor(0.3 * n), floor(0.5 * n), floor(0.7 * n), floor(0.9 * n))""")
def _(t):
    return pick_by_size(t.orders, [0.1, 0.3, 0.5, 0.7, 0.9])
