"""Queries on application time: sources, timelines, lookups."""

from pyspark.sql import functions as F

from twinclock.functions import instants
from twinclock.operators import lookups as L
from twinclock.operators import timelines as B
from twinclock.registry.core import query
from twinclock.registry.sql import END, EV, INF, PROBES, START, UEV, open_end, timeline, window_events
from twinclock.schema import null_if_open, ntz
from twinclock.sources import revisions as R
from twinclock.sources.adapters import Tables

T0 = "1998-06-01 00:00:00"
TL = f"WITH {EV}, {timeline()}"
ROWS = f"entity, rev_id, valid_from, {open_end('valid_to')} AS valid_to"


def shown(df):
    return df.withColumn("valid_to", null_if_open("valid_to"))


def probes_of(events):
    return (events.filter(F.col("ts") >= ntz(START))
            .select("entity", "rev_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
            .select((F.col("rev_id") * 2 + F.col("k")).alias("probe_id"), "entity",
                    (F.col("ts") - F.make_dt_interval(secs=F.col("k").cast("decimal(18,6)"))).alias("t")))


# ---- sources -------------------------------------------------------------------------------------

RAW = """raw AS (
  SELECT o_custkey AS page_id, o_orderkey AS revid, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey // 2 END AS parentid,
         o_orderdate AS ts, o_orderpriority AS usr, o_orderstatus = 'F' AS hid FROM orders)"""


def raw_revisions(t: Tables):
    """Orders as JSON lines in the shape of the feed."""
    o = t["orders"]
    hidden = F.col("o_orderstatus") == "F"
    feed = F.struct(
        F.col("o_orderkey").alias("revid"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0)).otherwise(F.floor(F.col("o_orderkey") / 2)).cast("bigint").alias("parentid"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("o_orderpriority").alias("user"), hidden.alias("userhidden"),
        F.when(~hidden, F.lit(None).cast("string")).otherwise(F.lit("gone")).alias("comment"), hidden.alias("commenthidden"),
        F.sha1(F.col("o_orderkey").cast("string")).alias("sha1"), hidden.alias("sha1hidden"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"))
    return o.select(F.col("o_custkey").alias("page_id"), F.to_json(feed).alias("json"))


@query("read_revisions", f"""WITH {RAW}
  SELECT page_id AS entity, revid AS rev_id, nullif(parentid, 0) AS parent_rev_id, ts,
         CASE WHEN NOT hid THEN usr END AS editor, hid AS editor_hidden,
         CASE WHEN NOT hid THEN '' END AS comment, hid AS comment_hidden, false AS is_minor,
         CASE WHEN NOT hid THEN sha1(CAST(revid AS VARCHAR)) END AS sha1, hid AS content_hidden FROM raw""")
def _(t):
    return R.parse_revisions(raw_revisions(t), "page_id", "json").select(
        "entity", "rev_id", "parent_rev_id", "ts", "editor", "editor_hidden", "comment", "comment_hidden",
        "is_minor", "sha1", "content_hidden")


@query("window_slice", f"WITH {EV} SELECT entity, rev_id, ts FROM ev WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{T0}'")
def _(t):
    return R.window_slice(t.orders, START, T0).select("entity", "rev_id", "ts")


@query("baseline", f"""WITH {EV} SELECT entity, rev_id, ts, status, true AS is_baseline FROM ev WHERE ts <= TIMESTAMP '{T0}'
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, rev_id DESC) = 1""")
def _(t):
    return R.baseline(t.orders, T0).select("entity", "rev_id", "ts", "status", "is_baseline")


@query("merge_slices", f"""WITH {EV}, b AS (
    SELECT rev_id FROM ev WHERE ts <= TIMESTAMP '{T0}'
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, rev_id DESC) = 1)
  SELECT entity, rev_id, ts, rev_id IN (SELECT rev_id FROM b) AS is_baseline FROM ev
  WHERE ts BETWEEN TIMESTAMP '{T0}' AND TIMESTAMP '{END}' OR rev_id IN (SELECT rev_id FROM b)""")
def _(t):
    ev = t.orders
    return R.merge_slices(R.baseline(ev, T0), R.window_slice(ev, T0, END)).select("entity", "rev_id", "ts", "is_baseline")


@query("new_events", f"""WITH {EV} SELECT entity, rev_id, ts FROM ev WHERE ts >= TIMESTAMP '{START}'
  AND rev_id NOT IN (SELECT rev_id FROM ev WHERE ts <= TIMESTAMP '{T0}' AND status <> 'P')""")
def _(t):
    stored = t.orders.filter((F.col("ts") <= ntz(T0)) & (F.col("status") != "P"))
    return R.new_events(t.orders.filter(F.col("ts") >= ntz(START)), stored).select("entity", "rev_id", "ts")


# ---- timelines -----------------------------------------------------------------------------------

@query("build_timeline", f"{TL} SELECT {ROWS} FROM tl")
def _(t):
    return shown(B.build_timeline(t.orders))


@query("build_timeline_dense", f"WITH {UEV}, {timeline('uev')} SELECT {ROWS} FROM tl")
def _(t):
    return shown(B.build_timeline(t.user_events))


@query("shadowed", f"{TL} SELECT entity, rev_id, ts FROM tl_rk WHERE rn > 1")
def _(t):
    return B.shadowed(t.orders)


OLD_TL = timeline(f"(SELECT * FROM ev WHERE ts <= TIMESTAMP '{T0}')", "cur")
PLAN = f"""WITH {EV}, {OLD_TL}, {timeline("ev", "tgt")}, plan AS (
  SELECT coalesce(c.entity, g.entity) AS entity, coalesce(c.rev_id, g.rev_id) AS rev_id,
         c.valid_from AS old_from, c.valid_to AS old_to, g.valid_from AS new_from, g.valid_to AS new_to,
         CASE WHEN c.rev_id IS NULL THEN 'insert' WHEN g.rev_id IS NULL THEN 'delete'
              WHEN g.valid_to < c.valid_to THEN 'trim' ELSE 'keep' END AS action
  FROM cur c FULL OUTER JOIN tgt g ON c.entity = g.entity AND c.rev_id = g.rev_id)"""


@query("plan_changes", f"""{PLAN} SELECT entity, rev_id, old_from, {open_end('old_to')} AS old_to, new_from,
  {open_end('new_to')} AS new_to, action FROM plan""")
def _(t):
    ev = t.orders
    plan = B.plan_changes(B.build_timeline(ev.filter(F.col("ts") <= ntz(T0))), ev)
    return plan.withColumns({"old_to": null_if_open("old_to"), "new_to": null_if_open("new_to")})


# Growth shows when events disappear: the plan against a history without the finished orders.
@query("refused_changes", f"""WITH {EV}, {timeline("ev", "cur")}, {timeline("(SELECT * FROM ev WHERE status <> 'F')", "tgt")}
  SELECT c.entity, c.rev_id, c.valid_to AS old_to, {open_end('g.valid_to')} AS new_to
  FROM cur c JOIN tgt g USING (entity, rev_id) WHERE g.valid_to > c.valid_to""")
def _(t):
    ev = t.orders
    bad = B.refused_changes(B.plan_changes(B.build_timeline(ev), ev.filter(F.col("status") != "F")))
    return bad.select("entity", "rev_id", "old_to", null_if_open("new_to").alias("new_to"))


@query("apply_plan", f"""{PLAN}
  SELECT entity, rev_id, old_from AS valid_from, {open_end('old_to')} AS valid_to, TIMESTAMP '{T0}' AS row_start,
         CASE WHEN action IN ('trim', 'delete') THEN TIMESTAMP '{END}' END AS row_end FROM plan WHERE old_from IS NOT NULL
  UNION ALL
  SELECT entity, rev_id, new_from, {open_end('new_to')}, TIMESTAMP '{END}', NULL FROM plan WHERE action IN ('trim', 'insert')""")
def _(t):
    from twinclock.operators.systime import start_versioning
    ev = t.orders
    now = B.build_timeline(ev.filter(F.col("ts") <= ntz(T0)))
    out = B.apply_plan(start_versioning(now, T0), B.plan_changes(now, ev), END)
    return shown(out).withColumn("row_end", F.when(F.col("row_end") < ntz("2100-01-01"), F.col("row_end")))


P1, P2 = "1998-03-01 00:00:00", "1998-09-01 00:00:00"
HIT = f"valid_from < TIMESTAMP '{P2}' AND valid_to > TIMESTAMP '{P1}'"


@query("delete_for_portion", f"""{TL} SELECT {ROWS} FROM (
  SELECT * FROM tl WHERE NOT ({HIT})
  UNION ALL SELECT entity, rev_id, valid_from, TIMESTAMP '{P1}' FROM tl WHERE {HIT} AND valid_from < TIMESTAMP '{P1}'
  UNION ALL SELECT entity, rev_id, TIMESTAMP '{P2}', valid_to FROM tl WHERE {HIT} AND valid_to > TIMESTAMP '{P2}') x""")
def _(t):
    return shown(B.delete_for_portion(B.build_timeline(t.orders), P1, P2))


@query("update_for_portion", f"""WITH {EV}, {timeline()}, n AS (
    SELECT tl.*, status FROM tl JOIN ev USING (entity, rev_id)), h AS (SELECT *, {HIT} AND status = 'O' AS hit FROM n)
  SELECT {ROWS}, status FROM (
  SELECT entity, rev_id, valid_from, valid_to, status FROM h WHERE NOT hit
  UNION ALL SELECT entity, rev_id, valid_from, TIMESTAMP '{P1}', status FROM h WHERE hit AND valid_from < TIMESTAMP '{P1}'
  UNION ALL SELECT entity, rev_id, greatest(valid_from, TIMESTAMP '{P1}'), least(valid_to, TIMESTAMP '{P2}'), 'held' FROM h WHERE hit
  UNION ALL SELECT entity, rev_id, TIMESTAMP '{P2}', valid_to, status FROM h WHERE hit AND valid_to > TIMESTAMP '{P2}') x""")
def _(t):
    ev = t.orders
    rows = B.build_timeline(ev).join(ev.select("entity", "rev_id", "status"), ["entity", "rev_id"])
    return shown(B.update_for_portion(rows, P1, P2, {"status": F.lit("held")}, F.col("status") == "O"))


@query("interval_at", f"{TL} SELECT {ROWS} FROM tl WHERE valid_from <= TIMESTAMP '{P1}' AND TIMESTAMP '{P1}' < valid_to")
def _(t):
    return shown(B.interval_at(B.build_timeline(t.orders), P1))


# A damaged timeline: open orders lose their last day, finished ones run two days over, P ones are reversed.
DAMAGED = f"""dm AS (
  SELECT entity, rev_id, valid_from,
         CASE WHEN valid_to = {INF} THEN valid_to WHEN status = 'O' THEN valid_to - INTERVAL 1 DAY
              WHEN status = 'F' THEN valid_to + INTERVAL 2 DAY ELSE valid_from END AS valid_to
  FROM tl JOIN ev USING (entity, rev_id)),
dn AS (SELECT *, lead(valid_from) OVER (PARTITION BY entity ORDER BY valid_from, rev_id) AS next_from,
              max(valid_to) OVER (PARTITION BY entity ORDER BY valid_from, rev_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_to
       FROM dm)"""


def damaged(t):
    ev = t.orders
    rows = B.build_timeline(ev).join(ev.select("entity", "rev_id", "status"), ["entity", "rev_id"])
    bad_end = (F.when(F.col("valid_to") == ntz("9999-12-31 23:59:59"), F.col("valid_to"))
               .when(F.col("status") == "O", F.col("valid_to") - F.expr("interval 1 day"))
               .when(F.col("status") == "F", F.col("valid_to") + F.expr("interval 2 day"))
               .otherwise(F.col("valid_from")))
    return rows.withColumn("valid_to", bad_end).drop("status")


@query("timeline_problems", f"""WITH {EV}, {timeline()}, {DAMAGED}
  SELECT entity, rev_id, 'empty' AS problem FROM dn WHERE valid_from >= valid_to
  UNION ALL SELECT entity, rev_id, 'overlap' FROM dn WHERE valid_to > next_from
  UNION ALL SELECT entity, rev_id, 'gap' FROM dn WHERE valid_to < next_from""")
def _(t):
    return B.timeline_problems(damaged(t))


@query("overlapping_rows", f"""WITH {EV}, {timeline()}, {DAMAGED}
  SELECT entity, rev_id, valid_from, {open_end('covered_to')} AS covered_to FROM dn WHERE covered_to > valid_from""")
def _(t):
    return B.overlapping_rows(damaged(t)).select(
        "entity", "rev_id", "valid_from", null_if_open("covered_to").alias("covered_to"))


@query("empty_rows", f"WITH {EV}, {timeline()}, {DAMAGED} SELECT entity, rev_id, valid_from FROM dm WHERE valid_from >= valid_to")
def _(t):
    return B.empty_rows(damaged(t)).select("entity", "rev_id", "valid_from")


# Older events learned later: only the part after T0 is stored, then everything before it arrives.
@query("earlier_start_extension", f"""WITH {EV}, {timeline(f"(SELECT * FROM ev WHERE ts > TIMESTAMP '{T0}')", "cur")}, {timeline("ev", "tgt")}
  SELECT g.entity, g.rev_id, g.valid_from, {open_end('g.valid_to')} AS valid_to,
         CASE WHEN c.rev_id IS NULL THEN 'insert' WHEN g.valid_to < c.valid_to THEN 'trim' ELSE 'keep' END AS action
  FROM tgt g LEFT JOIN cur c USING (entity, rev_id)""")
def _(t):
    ev = t.orders
    late = ev.filter(F.col("ts") <= ntz(T0))
    stored = ev.filter(F.col("ts") > ntz(T0))
    plan = B.plan_changes(B.build_timeline(stored), stored.unionByName(late))
    return plan.select("entity", "rev_id", F.col("new_from").alias("valid_from"),
                       null_if_open("new_to").alias("valid_to"), "action")


# Finished orders arrive last, so they fall between stored intervals and split them.
@query("middle_insertion", f"""WITH {EV}, {timeline("(SELECT * FROM ev WHERE status <> 'F')", "cur")}, {timeline("ev", "tgt")}
  SELECT coalesce(c.entity, g.entity) AS entity, coalesce(c.rev_id, g.rev_id) AS rev_id,
         CASE WHEN c.rev_id IS NULL THEN 'insert' WHEN g.rev_id IS NULL THEN 'delete' ELSE 'trim' END AS action,
         {open_end('c.valid_to')} AS old_to, {open_end('g.valid_to')} AS new_to
  FROM cur c FULL OUTER JOIN tgt g ON c.entity = g.entity AND c.rev_id = g.rev_id
  WHERE c.rev_id IS NULL OR g.rev_id IS NULL OR g.valid_to < c.valid_to""")
def _(t):
    ev = t.orders
    plan = B.plan_changes(B.build_timeline(ev.filter(F.col("status") != "F")), ev)
    return plan.filter(F.col("action") != "keep").select(
        "entity", "rev_id", "action", null_if_open("old_to").alias("old_to"), null_if_open("new_to").alias("new_to"))


# ---- lookups -------------------------------------------------------------------------------------

LIVE = f"valid_from <= TIMESTAMP '{T0}' AND valid_to > TIMESTAMP '{T0}'"


@query("snapshot_as_of", f"""WITH {EV}, {timeline()}
  SELECT c_mktsegment AS segment, n_name AS nation, {ROWS} FROM tl JOIN customer ON c_custkey = entity
  JOIN nation ON n_nationkey = c_nationkey WHERE {LIVE}""")
def snapshot_as_of(t):
    """Flagship: the state of every customer at one instant with the customer's segment and nation."""
    state = L.snapshot_of_events(t.orders, T0)
    people = t["customer"].select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    # nation is a fixed list of 25 rows; the size-checked broadcast is left to the optimiser
    nations = t["nation"].select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return shown(state.join(people, "entity").join(nations, "c_nationkey").drop("c_nationkey"))


@query("revision_at", f"""WITH {EV}, {timeline()}
  SELECT {ROWS}, ts, size_bytes, status, priority FROM tl JOIN ev USING (entity, rev_id) WHERE {LIVE}""")
def _(t):
    return shown(L.revision_at(B.build_timeline(t.orders), t.orders, T0))


PROBED = f"WITH {EV}, {timeline()}, {PROBES}"


@query("revisions_at", f"""{PROBED} SELECT probe_id, p.entity, t, rev_id, valid_from, {open_end('valid_to')} AS valid_to
  FROM probes p LEFT JOIN tl ON tl.entity = p.entity AND valid_from <= t AND t < valid_to""")
def _(t):
    return shown(L.revisions_at(B.build_timeline(t.orders), probes_of(t.orders)))


# One probe per nation and order priority: a set whose size does not grow with the order table.
SMALL = f"""sp AS (SELECT row_number() OVER (ORDER BY c_nationkey) AS probe_id, min(c_custkey) AS entity, TIMESTAMP '{T0}' AS t
  FROM customer GROUP BY c_nationkey)"""


@query("revisions_at_small_probes", f"""WITH {EV}, {timeline()}, {SMALL}
  SELECT sp.entity, t, rev_id, valid_from, {open_end('valid_to')} AS valid_to
  FROM sp LEFT JOIN tl ON tl.entity = sp.entity AND valid_from <= t AND t < valid_to""")
def _(t):
    probes = (t["customer"].groupBy("c_nationkey").agg(F.min("c_custkey").alias("entity"))
              .select(F.col("c_nationkey").cast("bigint").alias("probe_id"), "entity", ntz(T0).alias("t")))
    return shown(L.revisions_at(B.build_timeline(t.orders), probes, "join")).drop("probe_id")


@query("snapshot", f"{TL} SELECT {ROWS} FROM tl WHERE {LIVE}")
def _(t):
    return shown(L.snapshot(B.build_timeline(t.orders), T0))


@query("latest_before", f"""{PROBED}, hits AS (
    SELECT probe_id, p.entity, t, rev_id, valid_from FROM probes p LEFT JOIN tl ON tl.entity = p.entity AND valid_from <= t
    QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY valid_from DESC) = 1)
  SELECT * FROM hits""")
def _(t):
    return L.latest_before(t.orders, probes_of(t.orders))


@query("overlapping", f"{TL} SELECT {ROWS} FROM tl WHERE valid_from <= TIMESTAMP '{P2}' AND valid_to > TIMESTAMP '{P1}'")
def _(t):
    return shown(L.overlapping(B.build_timeline(t.orders), P1, P2))


@query("overlapping_count", f"""{TL} SELECT entity, count(*) AS n FROM tl
  WHERE valid_from <= TIMESTAMP '{P2}' AND valid_to > TIMESTAMP '{P1}' GROUP BY entity""")
def _(t):
    return L.overlapping_count(B.build_timeline(t.orders), P1, P2)


@query("history_page", f"""{TL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY valid_from DESC) - 1 AS position,
    count(*) OVER (PARTITION BY entity) AS total FROM tl WHERE valid_from <= TIMESTAMP '{END}' AND valid_to > TIMESTAMP '{START}')
  SELECT {ROWS}, total, position FROM o WHERE position >= 5 AND position < 10""")
def _(t):
    return shown(L.history_page(B.build_timeline(t.orders), START, END, page=2, size=5))


@query("edits_between", f"""WITH {EV} SELECT entity, count(*) AS edits FROM ev
  WHERE ts > TIMESTAMP '{P1}' AND ts <= TIMESTAMP '{P2}' GROUP BY entity""")
def _(t):
    return L.edits_between(t.orders, P1, P2)


@query("edits_per_month", f"""WITH {EV} SELECT entity, strftime(ts, '%Y-%m') AS month, count(*) AS edits FROM ev
  WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1, 2""")
def _(t):
    return L.edits_per_month(t.orders, START, END)


@query("month_series", f"""WITH {EV}, m AS (
    SELECT unnest(generate_series(TIMESTAMP '1993-11-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS m),
  c AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM ev WHERE ts BETWEEN TIMESTAMP '1993-11-05' AND TIMESTAMP '{END}' GROUP BY 1)
  SELECT strftime(m, '%Y-%m') AS month, least(m + INTERVAL 1 MONTH - INTERVAL 1 SECOND, TIMESTAMP '{END}') AS last_second,
         coalesce(n, 0) AS edits FROM m LEFT JOIN c ON c.month = strftime(m, '%Y-%m')""")
def _(t):
    return L.month_series(t.orders, "1993-11-05 00:00:00", END)


@query("timeline_bounds", f"""{TL}, s AS (SELECT entity, min(valid_from) AS first_from, count(*) AS intervals FROM tl GROUP BY entity),
  c AS (SELECT entity, count(*) AS revisions FROM ev GROUP BY entity) SELECT * FROM s FULL JOIN c USING (entity)""")
def _(t):
    return L.timeline_bounds(B.build_timeline(t.orders), t.orders)


@query("neighbours", f"""{TL} SELECT {ROWS},
    CASE WHEN valid_from - INTERVAL 1 SECOND >= TIMESTAMP '{START}' THEN lag(rev_id) OVER w END AS previous_rev,
    CASE WHEN valid_to <= TIMESTAMP '{END}' THEN lead(rev_id) OVER w END AS next_rev
  FROM tl WINDOW w AS (PARTITION BY entity ORDER BY valid_from)""")
def _(t):
    return shown(L.neighbours(B.build_timeline(t.orders), START, END))


@query("not_yet_created", f"""{TL}, p AS (SELECT c_custkey AS entity, TIMESTAMP '1996-02-01' AS t FROM customer),
  b AS (SELECT entity, min(valid_from) AS ff FROM tl GROUP BY entity)
  SELECT p.entity AS probe_id, p.entity, t, rev_id, valid_from, {open_end('valid_to')} AS valid_to,
         CASE WHEN rev_id IS NULL THEN ff END AS first_from, rev_id IS NULL AND ff IS NOT NULL AS not_yet_created
  FROM p LEFT JOIN tl ON tl.entity = p.entity AND valid_from <= t AND t < valid_to LEFT JOIN b ON b.entity = p.entity""")
def _(t):
    line = B.build_timeline(t.orders)
    probes = t["customer"].select(F.col("c_custkey").alias("probe_id"), F.col("c_custkey").alias("entity"),
                                  ntz("1996-02-01 00:00:00").alias("t"))
    return shown(L.with_creation(L.revisions_at(line, probes), L.timeline_bounds(line, t.orders)))


@query("live_in_year", f"""{TL} SELECT {ROWS} FROM tl WHERE valid_from <= TIMESTAMP '1998-12-31 23:59:59'
  AND valid_to > TIMESTAMP '1998-01-01 00:00:00'""")
def _(t):
    return shown(L.live_in_year(B.build_timeline(t.orders), T0))


@query("totals_at", f"""{TL} SELECT count(*) AS entities, CAST(sum(size_bytes) AS BIGINT) AS bytes
  FROM tl JOIN ev USING (entity, rev_id) WHERE {LIVE}""")
def _(t):
    return L.totals_at(t.orders, T0)


@query("decorated", f"""{TL} SELECT {ROWS}, valid_to = {INF} AS open_ended, strftime(valid_from, '%Y-%m-%dT%H:%M:%SZ') AS valid_from_iso,
    CASE WHEN valid_to < {INF} THEN strftime(valid_to, '%Y-%m-%dT%H:%M:%SZ') END AS valid_to_iso,
    '/revision/' || rev_id AS permalink FROM tl""")
def _(t):
    return L.decorated(B.build_timeline(t.orders), "/revision/")


# Two instants per customer; in every second nation they come in the wrong order.
@query("compare", f"""{TL}, p AS (SELECT c_custkey AS pair_id, c_custkey AS entity, c_nationkey >= 12 AS swapped,
    TIMESTAMP '{P1}' AS a, TIMESTAMP '{P2}' AS b FROM customer)
  SELECT pair_id, p.entity, a, b, swapped, x.rev_id AS rev_a, y.rev_id AS rev_b,
         CASE WHEN x.rev_id IS NOT NULL AND y.rev_id IS NOT NULL THEN x.rev_id = y.rev_id END AS same_revision,
         CASE WHEN x.rev_id IS NULL OR y.rev_id IS NULL THEN 'NO_REVISION' WHEN x.rev_id = y.rev_id THEN 'SAME_REVISION' ELSE 'OK' END AS status,
         (SELECT count(*) FROM ev WHERE ev.entity = p.entity AND ts > a AND ts <= b) AS edits_between
  FROM p LEFT JOIN tl x ON x.entity = p.entity AND x.valid_from <= a AND a < x.valid_to
  LEFT JOIN tl y ON y.entity = p.entity AND y.valid_from <= b AND b < y.valid_to""")
def _(t):
    swap = F.col("c_nationkey") >= 12
    pairs = t["customer"].select(F.col("c_custkey").alias("pair_id"), F.col("c_custkey").alias("entity"),
                                 F.when(swap, ntz(P2)).otherwise(ntz(P1)).alias("a"),
                                 F.when(swap, ntz(P1)).otherwise(ntz(P2)).alias("b"))
    out = L.compare(B.build_timeline(t.orders), t.orders, pairs)
    return out.withColumn("edits_between", F.coalesce("edits_between", F.lit(0)))


@query("revision_density", f"WITH {EV} SELECT entity, count(*) AS revisions, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM ev GROUP BY entity")
def _(t):
    return L.revision_density(t.orders)


# ---- scalar functions ----------------------------------------------------------------------------

@query("parse_instant", """WITH s AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS p FROM orders)
  SELECT id, CASE substr(p, 1, 1) WHEN '1' THEN ts WHEN '2' THEN ts + INTERVAL 14 HOUR + INTERVAL 30 MINUTE
                  WHEN '3' THEN ts + INTERVAL 5 HOUR - INTERVAL 2 HOUR - INTERVAL 30 MINUTE END AS instant,
         CASE substr(p, 1, 1) WHEN '4' THEN 'format' WHEN '5' THEN 'calendar' END AS error FROM s""")
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (F.when(F.col("o_orderpriority").startswith("1"), day)
            .when(F.col("o_orderpriority").startswith("2"), F.concat(day, F.lit("T14:30")))
            .when(F.col("o_orderpriority").startswith("3"), F.concat(day, F.lit(" 05:00:00+02:30")))
            .when(F.col("o_orderpriority").startswith("4"), F.concat(day, F.lit("T05:00:00.5Z")))
            .otherwise(F.concat(F.substring(day, 1, 5), F.lit("02-30"))))
    parsed = instants.parse_instant(text)
    return t["orders"].select(F.col("o_orderkey").alias("id"), parsed["instant"].alias("instant"), parsed["error"].alias("error"))


@query("within_coverage", f"""WITH {EV} SELECT entity, rev_id, CASE WHEN ts NOT BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{T0}'
  THEN 'OUT_OF_COVERAGE' END AS error FROM ev""")
def _(t):
    return t.orders.select("entity", "rev_id", instants.coverage_error("ts", START, T0).alias("error"))


@query("add_months", f"WITH {EV} SELECT entity, rev_id, ts + INTERVAL 13 MONTH AS shifted FROM ev")
def _(t):
    return t.orders.select("entity", "rev_id", instants.add_months("ts", 13).alias("shifted"))
