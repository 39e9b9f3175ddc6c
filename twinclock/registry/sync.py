"""Queries on the incremental sync, in batches and as a stream."""

from pyspark.sql import functions as F

from twinclock.functions import instants
from twinclock.operators import timelines as B
from twinclock.plans import sync as E
from twinclock.registry.app_time import T0, shown
from twinclock.registry.core import query
from twinclock.registry.sql import (CHECKPOINTS, COMMITS, CUTOFFS, DOC, END, EV, INF, START, SYS_MAX, beliefs, open_end,
                                    timeline, window_events)
from twinclock.schema import ntz, null_if_open
from twinclock.session import new_table_path
from twinclock.sources import revisions as R
from twinclock.sources.store import Store
from twinclock.streaming import jobs

BROWS = f"entity, rev_id, valid_from, {open_end('valid_to')} AS valid_to, row_start, row_end"
WIN = f"WITH {EV}, {window_events()}, {beliefs('win')}"


@query("sync_cutoffs", f"""WITH b AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders),
  s AS (SELECT a, z, unnest(range(1, 200)) AS k FROM b),
  c AS (SELECT a, z, a + to_months(CAST(k * 7 AS INTEGER)) AS cutoff FROM s), u AS (
  SELECT cutoff FROM c WHERE cutoff <= z - INTERVAL 1 DAY UNION ALL SELECT z FROM b)
  SELECT CAST(row_number() OVER (ORDER BY cutoff) AS INTEGER) AS step, cutoff FROM u""")
def _(t):
    bounds = t.orders.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return instants.cutoff_rows(bounds, 7).select("step", "cutoff")


# One step: everything up to the second cut-off is stored, the third year arrives.
OLD, NEW = CUTOFFS[1], CUTOFFS[2]
STEP = f"""WITH {EV}, {timeline(f"(SELECT * FROM ev WHERE ts <= TIMESTAMP '{OLD}')", "cur")},
  {timeline(f"(SELECT * FROM ev WHERE ts <= TIMESTAMP '{NEW}')", "tgt")}, plan AS (
  SELECT coalesce(c.entity, g.entity) AS entity, coalesce(c.rev_id, g.rev_id) AS rev_id, c.valid_to AS old_to, g.valid_to AS new_to,
         CASE WHEN c.rev_id IS NULL THEN 'insert' WHEN g.rev_id IS NULL THEN 'delete' WHEN g.valid_to < c.valid_to THEN 'trim' ELSE 'keep' END AS action
  FROM cur c FULL JOIN tgt g ON c.entity = g.entity AND c.rev_id = g.rev_id)"""


def one_step(t):
    ev = t.orders
    now = B.build_timeline(ev.filter(F.col("ts") <= ntz(OLD)))
    is_open = F.col("valid_to") == ntz("9999-12-31 23:59:59")
    fresh = ev.filter((F.col("ts") > ntz(OLD)) & (F.col("ts") <= ntz(NEW)))
    return E.step_plan(now.filter(is_open), now.filter(~is_open), fresh)


@query("sync_step", f"""{STEP} SELECT entity, rev_id, action, {open_end('old_to')} AS old_to, {open_end('new_to')} AS new_to
  FROM plan WHERE action <> 'keep'""")
def _(t):
    return one_step(t).filter(F.col("action") != "keep").select(
        "entity", "rev_id", "action", null_if_open("old_to").alias("old_to"), null_if_open("new_to").alias("new_to"))


@query("run_metrics", f"""{STEP}, w AS (SELECT * FROM ev WHERE ts BETWEEN TIMESTAMP '{OLD}' AND TIMESTAMP '{NEW}'),
  c AS (SELECT count(*) AS seen, count(*) FILTER (WHERE ts > TIMESTAMP '{OLD}') AS inserted, count(*) FILTER (WHERE ts = TIMESTAMP '{OLD}') AS skipped FROM w),
  p AS (SELECT count(*) FILTER (WHERE action = 'trim') AS trims, count(*) FILTER (WHERE action = 'delete') AS deletes,
               count(*) FILTER (WHERE action = 'insert') AS inserts FROM plan)
  SELECT *, inserted - inserts + deletes AS shadowed FROM c, p""")
def _(t):
    ev = t.orders
    seen = R.window_slice(ev, OLD, NEW)
    return E.run_metrics(seen, ev.filter(F.col("ts") <= ntz(OLD)), one_step(t))


@query("run_sync", f"{WIN} SELECT {BROWS} FROM bel")
def _(t):
    return shown(synced(t).versions())


@query("run_sync_history", f"{WIN} SELECT {BROWS} FROM bel WHERE row_end < {SYS_MAX}")
def _(t):
    return shown(synced(t).history())


@query("checkpoints", f"""WITH {EV}, c AS (SELECT unnest([{', '.join(f"TIMESTAMP '{c}'" for c in CUTOFFS)}]) AS synced_through,
    unnest([{', '.join(f"TIMESTAMP '{c}'" for c in COMMITS)}]) AS completed_at)
  SELECT row_number() OVER (ORDER BY synced_through) AS batch_id, CAST(1 AS BIGINT) AS run_id, synced_through, completed_at,
         (SELECT count(DISTINCT entity) FROM ev) AS entities_synced FROM c""")
def _(t):
    return E.checkpoint_report(synced(t))


@query("run_sync_retention", f"{WIN} SELECT {BROWS} FROM bel WHERE row_end >= TIMESTAMP '{COMMITS[3]}'")
def _(t):
    store = synced(t)
    store.retain_since(COMMITS[3])
    return shown(store.versions())


def synced(t) -> Store:
    store = Store(t.spark, new_table_path(t.spark, "sync"))
    E.run_sync(store, t.orders.select("entity", "rev_id", "ts", "size_bytes"), START, CHECKPOINTS)
    return store


# Customers of nations 0-7 were never synced, 8-15 were up to T0, the others from 1997 to the end.
STATE = f"""st AS (SELECT c_custkey AS entity, CASE WHEN c_nationkey < 16 THEN TIMESTAMP '{START}' ELSE TIMESTAMP '{CUTOFFS[0]}' END AS synced_from,
    CASE WHEN c_nationkey < 16 THEN TIMESTAMP '{T0}' ELSE TIMESTAMP '{END}' END AS synced_through FROM customer WHERE c_nationkey >= 8)"""


def state_of(t):
    early = F.col("c_nationkey") < 16
    return t["customer"].filter("c_nationkey >= 8").select(
        F.col("c_custkey").alias("entity"),
        F.when(early, ntz(START)).otherwise(ntz(CUTOFFS[0])).alias("synced_from"),
        F.when(early, ntz(T0)).otherwise(ntz(END)).alias("synced_through"))


@query("resume_ranges", f"""WITH {STATE}, c AS (SELECT c_custkey AS entity FROM customer)
  SELECT entity, TIMESTAMP '{START}' AS "from", TIMESTAMP '{END}' AS "to", true AS want_baseline FROM c WHERE entity NOT IN (SELECT entity FROM st)
  UNION ALL SELECT entity, TIMESTAMP '{START}', synced_from, true FROM st WHERE synced_from > TIMESTAMP '{START}'
  UNION ALL SELECT entity, synced_through, TIMESTAMP '{END}', false FROM st WHERE synced_through < TIMESTAMP '{END}'""")
def _(t):
    people = t["customer"].select(F.col("c_custkey").alias("entity"))
    return E.resume_ranges(people, state_of(t), START, END)


@query("events_to_read", f"""WITH {EV}, {STATE}, b AS (SELECT rev_id FROM ev WHERE ts <= TIMESTAMP '{START}'
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, rev_id DESC) = 1),
  j AS (SELECT ev.entity, rev_id, ts, synced_from, synced_through, rev_id IN (SELECT rev_id FROM b)
               AND (synced_from IS NULL OR synced_from > TIMESTAMP '{START}') AS is_baseline FROM ev LEFT JOIN st USING (entity))
  SELECT entity, rev_id, ts, is_baseline FROM j WHERE ts <= TIMESTAMP '{END}' AND (is_baseline
    OR synced_from IS NULL AND ts >= TIMESTAMP '{START}'
    OR synced_from > TIMESTAMP '{START}' AND ts BETWEEN TIMESTAMP '{START}' AND synced_from
    OR synced_through < TIMESTAMP '{END}' AND ts >= synced_through)""")
def _(t):
    return E.events_to_read(t.orders.select("entity", "rev_id", "ts"), state_of(t), START, END)


@query("state_upsert", f"""WITH {STATE}, c AS (SELECT c_custkey AS entity, TIMESTAMP '{T0}' AS a, TIMESTAMP '{T0}' AS z FROM customer)
  SELECT c.entity, least(coalesce(synced_from, a), a) AS synced_from, greatest(coalesce(synced_through, z), z) AS synced_through,
         CAST(7 AS BIGINT) AS last_batch FROM c LEFT JOIN st USING (entity)""")
def _(t):
    state = state_of(t).withColumn("last_batch", F.lit(3).cast("bigint"))
    done = t["customer"].select(F.col("c_custkey").alias("entity"), ntz(T0).alias("synced_from"), ntz(T0).alias("synced_through"))
    return E.state_upsert(state, done, 7)


# Low-quality documents arrive with the digest of another text.
BAD = f"""{DOC}, q AS (SELECT doc.*, CASE WHEN quality = 0 AND toxic = 1 THEN sha1(text || '.') ELSE sha1 END AS digest
    FROM doc LEFT JOIN labels ON doc_id = rev_id)"""


def with_digests(t):
    quality = t["labels"].select(F.col("doc_id").alias("rev_id"), "quality", "toxic")
    bad = (F.col("quality") == 0) & (F.col("toxic") == 1)
    return (t.documents.join(quality, "rev_id", "left")
            .withColumn("sha1", F.when(bad, F.sha1(F.concat("text", F.lit(".")))).otherwise(F.col("sha1"))))


@query("digest_mismatches", f"WITH {BAD} SELECT entity, rev_id FROM q WHERE digest <> sha1(text)")
def _(t):
    return E.digest_mismatches(with_digests(t)).select("entity", "rev_id")


# An entity is a language of a source here, so that some fail and some go on.
@query("failure_isolation", f"""WITH {BAD}, k AS (SELECT entity || '/' || lang AS e, rev_id, digest <> sha1(text) AS bad FROM q)
  SELECT e AS entity, rev_id FROM k WHERE e NOT IN (SELECT e FROM k WHERE bad)""")
def _(t):
    ev = with_digests(t).withColumn("entity", F.concat_ws("/", "entity", "lang"))
    good, _ = E.split_failed(ev, E.digest_mismatches(ev))
    return good.select("entity", "rev_id")


@query("run_status", f"""WITH {BAD}, k AS (SELECT lang, entity || '/' || lang AS e, digest <> sha1(text) AS bad FROM q),
  g AS (SELECT lang, count(DISTINCT e) AS total, count(DISTINCT CASE WHEN bad THEN e END) AS failed FROM k GROUP BY lang)
  SELECT lang, total, failed, CASE WHEN failed = 0 THEN 'succeeded' WHEN failed < total THEN 'partial' ELSE 'failed' END AS status FROM g""")
def _(t):
    ev = with_digests(t).withColumn("entity", F.concat_ws("/", "entity", "lang"))
    bad = F.sha1("text") != F.col("sha1")
    per_entity = ev.groupBy("lang", "entity").agg(F.max(bad).alias("bad"))
    totals = per_entity.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if("bad").alias("failed"))
    return totals.withColumn("status", E.run_status_of(F.col("failed"), F.col("total")))


# A run with texts: some documents that are shown carry the digest of another text, and fail their entity; hidden ones fail nothing.
@query("run_sync_texts", f"""WITH {DOC}, k AS (SELECT doc.*, entity || '/' || lang AS e, NOT hidden AND coalesce(quality, 1) = 0 AND rev_id % 3 = 0 AS bad FROM doc LEFT JOIN labels ON doc_id = rev_id)
  SELECT e AS entity, rev_id, CASE WHEN hidden THEN 'hidden' ELSE 'available' END AS content_status FROM k WHERE e NOT IN (SELECT e FROM k WHERE bad)""")
def _(t):
    store = Store(t.spark, new_table_path(t.spark, "texts"), "STRING")
    E.run_sync(store, shown_and_hidden(t), "2019-12-31 00:00:00", [("2100-01-01 00:00:00", "2100-01-02 00:00:00")])
    return store.events().select("entity", "rev_id", "content_status")


@query("run_sync_failures", f"""WITH {DOC}, k AS (SELECT doc.*, entity || '/' || lang AS e, NOT hidden AND coalesce(quality, 1) = 0 AND rev_id % 3 = 0 AS bad FROM doc LEFT JOIN labels ON doc_id = rev_id)
  SELECT e AS entity, 'digest mismatch, revision ' || min(rev_id) AS reason FROM k WHERE bad GROUP BY e""")
def _(t):
    store = Store(t.spark, new_table_path(t.spark, "failures"), "STRING")
    E.run_sync(store, shown_and_hidden(t), "2019-12-31 00:00:00", [("2100-01-01 00:00:00", "2100-01-02 00:00:00")])
    return store.runs().filter("entity is not null").select("entity", "reason")


def shown_and_hidden(t):
    quality = t["labels"].select(F.col("doc_id").alias("rev_id"), "quality")
    bad = ~F.col("hidden") & (F.coalesce("quality", F.lit(1)) == 0) & (F.col("rev_id") % 3 == 0)
    return (t.documents.join(quality, "rev_id", "left")
            .withColumns({"entity": F.concat_ws("/", "entity", "lang"), "content_hidden": F.col("hidden"),
                          "sha1": F.when(bad | F.col("hidden"), F.sha1(F.concat("text", F.lit(".")))).otherwise(F.col("sha1"))})
            .drop("quality"))


@query("backfill_beliefs", f"WITH {EV}, {beliefs()} SELECT {BROWS} FROM bel")
def _(t):
    return shown(E.backfill_beliefs(t.orders, CHECKPOINTS))


@query("backfill_beliefs_window", f"{WIN} SELECT {BROWS} FROM bel")
def _(t):
    ev = t.orders.select("entity", "rev_id", "ts")
    win = R.merge_slices(R.window_slice(ev, START, END), R.baseline(ev, START))
    return shown(E.backfill_beliefs(win, CHECKPOINTS))


@query("new_texts", f"""WITH {DOC}, old AS (SELECT DISTINCT sha1 FROM doc WHERE lang = 'en'),
  n AS (SELECT sha1, ts, rev_id, entity FROM doc WHERE NOT hidden
        QUALIFY row_number() OVER (PARTITION BY sha1 ORDER BY ts, rev_id) = 1)
  SELECT * FROM n WHERE sha1 NOT IN (SELECT sha1 FROM old)""")
def _(t):
    docs = t.documents.withColumn("content_hidden", F.col("hidden"))
    return R.new_texts(docs, docs.filter("lang = 'en'"))


@query("content_status", f"""WITH {DOC}, f AS (SELECT DISTINCT sha1, length(text) < 400 AS hidden_now FROM doc)
  SELECT entity, rev_id, CASE WHEN NOT hidden AND NOT hidden_now THEN 'available' ELSE 'hidden' END AS content_status,
         CASE WHEN NOT hidden AND NOT hidden_now THEN sha1 END AS sha1 FROM doc JOIN f USING (sha1)""")
def _(t):
    docs = t.documents.withColumn("content_hidden", F.col("hidden"))
    fetched = docs.groupBy("sha1").agg(F.max(F.length("text") < 400).alias("hidden_now"))
    return R.with_content_status(docs, fetched).select("entity", "rev_id", "content_status", "sha1")


# ---- streams -------------------------------------------------------------------------------------

def order_stream(t):
    raw = jobs.read_event_stream(t.spark, f"{t.folder}/order[s].parquet", t["orders"].schema)
    return raw.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("rev_id"), F.col("o_orderdate").alias("ts"))


@query("stream_sync", f"WITH {EV}, {timeline()} SELECT entity, rev_id, valid_from, {open_end('valid_to')} AS valid_to FROM tl")
def _(t):
    store = Store(t.spark, new_table_path(t.spark, "stream"))
    jobs.stream_sync(order_stream(t), store, new_table_path(t.spark, "checkpoint"),
                     lambda n: f"2002-01-{n:02d} 00:00:00").awaitTermination()
    return shown(store.current()).drop("row_start", "row_end")


# The finished orders are the late part: they arrive in a second batch and correct the first one's beliefs.
@query("stream_late_events", f"""WITH {EV}, {timeline("(SELECT * FROM ev WHERE status <> 'F')", "one")}, {timeline("ev", "two")},
  p AS (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.rev_id, b.rev_id) AS rev_id, coalesce(a.valid_from, b.valid_from) AS valid_from,
               a.valid_to AS old_to, b.valid_to AS new_to, a.rev_id IS NOT NULL AS was, b.rev_id IS NOT NULL AS is_now,
               a.valid_to IS NOT DISTINCT FROM b.valid_to AS same
        FROM one a FULL JOIN two b ON a.entity = b.entity AND a.rev_id = b.rev_id)
  SELECT entity, rev_id, valid_from, {open_end('old_to')} AS valid_to, TIMESTAMP '2002-01-01' AS row_start,
         CASE WHEN same THEN {SYS_MAX} ELSE TIMESTAMP '2002-01-02' END AS row_end FROM p WHERE was
  UNION ALL SELECT entity, rev_id, valid_from, {open_end('new_to')}, TIMESTAMP '2002-01-02', {SYS_MAX} FROM p WHERE is_now AND NOT same""")
def _(t):
    landing = new_table_path(t.spark, "landing")
    checkpoint = new_table_path(t.spark, "checkpoint")
    store = Store(t.spark, new_table_path(t.spark, "late"))
    ev = t.orders
    for part in (F.col("status") != "F", F.col("status") == "F"):
        ev.filter(part).select("entity", "rev_id", "ts").write.mode("append").parquet(landing)
        stream = jobs.read_event_stream(t.spark, landing, ev.select("entity", "rev_id", "ts").schema)
        jobs.stream_sync(stream, store, checkpoint, lambda n: f"2002-01-{n:02d} 00:00:00").awaitTermination()
    return shown(store.versions())


# A stream and batch runs write one store in turn; nothing of either is lost.
@query("stream_after_run_sync", f"WITH {EV}, {timeline()} SELECT entity, rev_id, valid_from, {open_end('valid_to')} AS valid_to FROM tl")
def _(t):
    landing, checkpoint, path = (new_table_path(t.spark, n) for n in ("landing", "checkpoint", "mixed"))
    store = Store(t.spark, path)
    ev = t.orders.select("entity", "rev_id", "ts")

    def stream(part, year):
        ev.filter(part).write.mode("append").parquet(landing)
        jobs.stream_sync(jobs.read_event_stream(t.spark, landing, ev.schema), store, checkpoint, lambda n: f"{year}-01-{n:02d} 00:00:00").awaitTermination()

    years = F.year("ts")
    E.run_sync(store, ev.filter(years < 1995), "1900-01-01 00:00:00", [("1994-01-01 00:00:00", "2002-01-01 00:00:00"), ("1995-01-01 00:00:00", "2002-01-02 00:00:00")])
    stream((years >= 1995) & (years < 1997), 2003)
    E.run_sync(store, ev.filter(years < 1998), "1900-01-01 00:00:00", [("1998-01-01 00:00:00", "2004-01-01 00:00:00")], run_id=2)
    stream(years >= 1998, 2005)
    return shown(store.current()).drop("row_start", "row_end")


@query("stream_lateness", f"""WITH {EV}, {STATE} SELECT count(*) FILTER (WHERE ts < synced_through) AS late, count(*) AS seen FROM ev JOIN st USING (entity)""")
def _(t):
    return jobs.lateness(t.orders, state_of(t))


@query("stream_edit_counts", f"WITH {EV} SELECT entity, strftime(ts, '%Y-%m') AS month, count(*) AS edits FROM ev GROUP BY 1, 2")
def _(t):
    path = new_table_path(t.spark, "counts")
    counts = jobs.edit_counts(order_stream(t), "3650 days")   # one file, and its days span all years
    jobs.write_counts(counts, path, new_table_path(t.spark, "checkpoint")).awaitTermination()
    return jobs.monthly(t.spark, path)


# Finished orders come in a second batch. Those more than 30 days behind the first are dropped by the stream, and counted.
@query("stream_edit_counts_corrected", f"""WITH {EV}, w AS (SELECT max(ts) - INTERVAL 30 DAY AS mark FROM ev WHERE status <> 'F')
  SELECT entity, strftime(ts, '%Y-%m') AS month, count(*) AS edits,
         count(*) FILTER (WHERE status = 'F' AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT mark FROM w)) AS missed FROM ev GROUP BY 1, 2""")
def _(t):
    landing, path, checkpoint = (new_table_path(t.spark, n) for n in ("landing", "counts", "checkpoint"))
    ev = t.orders.select("entity", "rev_id", "ts", "status")
    for part in (F.col("status") != "F", F.col("status") == "F"):
        ev.filter(part).drop("status").write.mode("append").parquet(landing)
        stream = jobs.read_event_stream(t.spark, landing, ev.drop("status").schema)
        jobs.write_counts(jobs.edit_counts(stream, "30 days"), path, checkpoint).awaitTermination()
    days = jobs.corrected(jobs.newest_days(t.spark, path), ev)
    return days.groupBy("entity", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("edits").alias("edits"), F.sum("missed").alias("missed"))
