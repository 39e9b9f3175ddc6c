"""Queries on system time and on both clocks."""

from pyspark.sql import functions as F

from twinclock.operators import lookups as L
from twinclock.operators import systime as D
from twinclock.operators import timelines as B
from twinclock.plans import sync
from twinclock.plans.reader import TemporalReader, lab
from twinclock.registry.app_time import P1, P2, T0, probes_of, shown
from twinclock.registry.core import query
from twinclock.registry.sql import (CHECKPOINTS, COMMITS, CUTOFFS, DOC, END, EV, INF, PROBES, START, SYS_MAX, beliefs, mirror,
                                    open_end, timeline)
from twinclock.schema import ntz, null_if_open

MI = f"WITH {EV}, {timeline()}, {mirror()}"
MROWS = "entity, rev_id, size_bytes, status, priority, row_start, row_end"
BEL = f"WITH {EV}, {beliefs()}"
BROWS = f"entity, rev_id, valid_from, {open_end('valid_to')} AS valid_to, row_start, row_end"
S = COMMITS[2]


def mirror_of(t):
    return D.scd2_from_log(t.orders)


def beliefs_of(t):
    return sync.backfill_beliefs(t.orders, CHECKPOINTS)


@query("scd2_from_log", f"{MI} SELECT {MROWS} FROM mi")
def _(t):
    return mirror_of(t)


@query("system_as_of", f"{MI} SELECT {MROWS} FROM mi WHERE row_start <= TIMESTAMP '{T0}' AND row_end > TIMESTAMP '{T0}'")
def _(t):
    return D.as_of(mirror_of(t), T0)


@query("system_between", f"{MI} SELECT {MROWS} FROM mi WHERE row_start <= TIMESTAMP '{P2}' AND row_end > TIMESTAMP '{P1}'")
def _(t):
    return D.between(mirror_of(t), P1, P2)


@query("system_from_to", f"{MI} SELECT {MROWS} FROM mi WHERE row_start < TIMESTAMP '{P2}' AND row_end > TIMESTAMP '{P1}'")
def _(t):
    return D.from_to(mirror_of(t), P1, P2)


@query("system_all", f"{MI} SELECT {MROWS}, row_end = {SYS_MAX} AS is_current FROM mi")
def _(t):
    return D.all_versions(mirror_of(t))


@query("system_current", f"{MI} SELECT {MROWS} FROM mi WHERE row_end = {SYS_MAX}")
def _(t):
    return D.current(mirror_of(t))


@query("believed_at", f"""{BEL} SELECT {BROWS} FROM bel WHERE row_start <= TIMESTAMP '{S}' AND row_end > TIMESTAMP '{S}'
  AND valid_from <= TIMESTAMP '{T0}' AND valid_to > TIMESTAMP '{T0}'""")
def _(t):
    return shown(D.believed_at(beliefs_of(t), S, T0))


@query("timeline_believed_at", f"{BEL} SELECT {BROWS} FROM bel WHERE row_start <= TIMESTAMP '{S}' AND row_end > TIMESTAMP '{S}'")
def _(t):
    return shown(D.as_of(beliefs_of(t), S))


KNOWN = f"""{BEL}, {PROBES}, k AS (
  SELECT probe_id, p.entity, t, b.rev_id AS then_rev, n.rev_id AS now_rev, b.rev_id IS NOT DISTINCT FROM n.rev_id AS agrees
  FROM probes p
  LEFT JOIN bel b ON b.entity = p.entity AND b.row_start <= TIMESTAMP '{S}' AND b.row_end > TIMESTAMP '{S}' AND b.valid_from <= t AND t < b.valid_to
  LEFT JOIN bel n ON n.entity = p.entity AND n.row_end = {SYS_MAX} AND n.valid_from <= t AND t < n.valid_to)"""


@query("known_then_and_now", f"{KNOWN} SELECT * FROM k")
def _(t):
    return D.known_then_and_now(beliefs_of(t), probes_of(t.orders), S)


@query("known_then_and_now_summary", f"""{KNOWN} SELECT count(*) AS probes, count(*) FILTER (WHERE NOT agrees) AS differing FROM k""")
def _(t):
    return D.known_then_and_now(beliefs_of(t), probes_of(t.orders), S).agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(~F.col("agrees")).alias("differing"))


@query("superseded_beliefs", f"{BEL} SELECT {BROWS} FROM bel WHERE row_end < {SYS_MAX}")
def _(t):
    return shown(D.superseded(beliefs_of(t)))


@query("history_growth", f"""{MI} SELECT CAST(year(row_end) AS INTEGER) AS year_closed, count(*) AS row_versions, CAST(sum(size_bytes) AS BIGINT) AS bytes
  FROM mi WHERE row_end < {SYS_MAX} GROUP BY 1""")
def _(t):
    return D.history_growth(mirror_of(t))


@query("audit_trail", f"{MI} SELECT {MROWS} FROM mi WHERE entity = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    one = t["customer"].filter("c_mktsegment = 'BUILDING'").agg(F.min("c_custkey")).first()[0]
    return D.audit_trail(version_table(t).all(), F.col("entity") == F.lit(one))   # the filter reaches the scan


@query("default_as_of_reader", f"""{MI} SELECT status, count(*) AS n FROM mi
  WHERE row_start <= TIMESTAMP '{T0}' AND row_end > TIMESTAMP '{T0}' GROUP BY status""")
def _(t):
    reader = TemporalReader(t.spark, default_as_of=T0).register("order_state", mirror_of(t))
    return reader.sql("SELECT status, count(*) AS n FROM order_state GROUP BY status")


@query("reader_explicit_range", f"""{MI} SELECT status, count(*) AS n FROM mi
  WHERE row_start <= TIMESTAMP '{P2}' AND row_end > TIMESTAMP '{P1}' GROUP BY status""")
def _(t):
    reader = TemporalReader(t.spark, default_as_of=T0).register("order_log", mirror_of(t))
    return reader.between("order_log", P1, P2).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("cross_check", f"""WITH {EV}, {timeline()}, {mirror()}, {PROBES}
  SELECT probe_id, p.entity, t, a.rev_id AS app_rev, m.rev_id AS mirror_rev, a.rev_id IS NOT DISTINCT FROM m.rev_id AS agrees
  FROM probes p LEFT JOIN tl a ON a.entity = p.entity AND a.valid_from <= t AND t < a.valid_to
  LEFT JOIN mi m ON m.entity = p.entity AND m.row_start <= t AND t < m.row_end""")
def _(t):
    return D.cross_check(B.build_timeline(t.orders), mirror_of(t), probes_of(t.orders))


# Priority 5 orders stand for deletes.
DELETES = f"""WITH {EV}, lg AS (SELECT *, CASE WHEN priority = '5-LOW' THEN 'D' ELSE 'U' END AS op FROM ev),
  g AS (SELECT entity, ts, max(CASE WHEN op <> 'D' THEN rev_id END) AS rev_id, arg_max(op, rev_id) AS last_op FROM lg GROUP BY entity, ts),
  n AS (SELECT *, lead(ts) OVER (PARTITION BY entity ORDER BY ts) AS nx FROM g)
  SELECT n.entity, n.rev_id, e.status, n.ts AS row_start, CASE WHEN last_op = 'D' THEN n.ts ELSE coalesce(nx, {SYS_MAX}) END AS row_end
  FROM n JOIN ev e ON e.rev_id = n.rev_id"""


def change_log(t):
    return t.orders.select("entity", "rev_id", "ts", "status",
                           F.when(F.col("priority") == "5-LOW", "D").otherwise("U").alias("op"))


@query("scd2_with_deletes", DELETES)
def _(t):
    return D.scd2_with_deletes(change_log(t))


def mirror_in_batches(t):
    """Three batches up to these instants; the second is sent again after it and after the third."""
    from twinclock.session import new_table_path
    from twinclock.sources.mirror import Mirror
    table, log, after = Mirror(t.spark, new_table_path(t.spark, "mirror"), snapshot_every=2), change_log(t), None
    parts = []
    for end in (CUTOFFS[0], CUTOFFS[1], "9999-12-31 23:59:59"):
        part = log.filter(F.col("ts") <= ntz(end))
        parts.append((part if after is None else part.filter(F.col("ts") > ntz(after)), end))
        after = end
    for n in (1, 2, 2, 3, 2):
        table.apply(n, *parts[n - 1])
    return table


@query("mirror_apply_changes", DELETES)
def _(t):
    return mirror_in_batches(t).all()


@query("mirror_apply_changes_as_of", f"SELECT * FROM ({DELETES}) WHERE row_start <= TIMESTAMP '{T0}' AND row_end > TIMESTAMP '{T0}'")
def _(t):
    return mirror_in_batches(t).as_of(T0)


def trail_sql(upper):
    return f"""{MI} SELECT entity, string_agg(CAST(rev_id AS VARCHAR), ' ' ORDER BY row_start, rev_id) AS revisions, count(*) AS versions FROM mi
  WHERE row_start {upper} TIMESTAMP '{P2}' AND row_end > TIMESTAMP '{P1}' GROUP BY entity"""


@query("system_between_trail", trail_sql("<="))
def _(t):
    return D.trail(D.between(mirror_of(t), P1, P2))


@query("system_from_to_trail", trail_sql("<"))
def _(t):
    return D.trail(D.from_to(mirror_of(t), P1, P2))


# ---- every event in one order across entities ----------------------------------------------------

IN_ORDER = f"WITH {EV}, o AS (SELECT row_number() OVER (ORDER BY ts, rev_id, entity) AS place, * FROM ev)"


def ordered_events(t, after=None):
    from twinclock.session import new_table_path
    from twinclock.sources.ordered import read_in_order, write_in_order
    path = new_table_path(t.spark, "ordered")
    write_in_order(t.orders, path, 4000)
    return read_in_order(t.spark, path, after).select("place", "entity", "rev_id", "ts", "size_bytes")


@query("ordered_events", f"{IN_ORDER} SELECT place, entity, rev_id, ts, size_bytes FROM o")
def _(t):
    return ordered_events(t)


@query("ordered_events_after", f"""{IN_ORDER} SELECT place, entity, rev_id, ts, size_bytes FROM o
  WHERE ts > TIMESTAMP '{T0}' OR (ts = TIMESTAMP '{T0}' AND rev_id > 1000)""")
def _(t):
    return ordered_events(t, (T0, 1000))


# ---- the same questions as SQL text --------------------------------------------------------------

def functions_of(t):
    from twinclock.plans.reader import define_functions
    define_functions(t.spark, B.build_timeline(t.orders), beliefs_of(t))
    return t.spark


@query("sql_rev_at", f"WITH {EV}, {timeline()} SELECT entity, rev_id, valid_from FROM tl WHERE valid_from <= TIMESTAMP '{T0}' AND valid_to > TIMESTAMP '{T0}'")
def _(t):
    return functions_of(t).sql(f"SELECT entity, rev_id, valid_from FROM rev_at(TIMESTAMP_NTZ '{T0}')")


@query("sql_believed_at", f"""{BEL} SELECT entity, rev_id, valid_from FROM bel WHERE row_start <= TIMESTAMP '{S}' AND row_end > TIMESTAMP '{S}'
  AND valid_from <= TIMESTAMP '{T0}' AND valid_to > TIMESTAMP '{T0}'""")
def _(t):
    return functions_of(t).sql(f"SELECT entity, rev_id, valid_from FROM believed_at(TIMESTAMP_NTZ '{S}', TIMESTAMP_NTZ '{T0}')")


@query("sql_rev_of_lateral", f"""WITH {EV}, {timeline()}, {PROBES} SELECT probe_id, p.entity, t, rev_id
  FROM probes p LEFT JOIN tl ON tl.entity = p.entity AND valid_from <= t AND t < valid_to""")
def _(t):
    spark = functions_of(t)
    return spark.sql("SELECT p.probe_id, p.entity, p.t, r.rev_id FROM {probes} p LEFT JOIN LATERAL rev_of(p.entity, p.t) r",
                     probes=probes_of(t.orders))


# A month of an entity's orders is one commit.
COMMIT = """cm AS (SELECT *, CAST(year(ts) * 12 + month(ts) AS INTEGER) AS commit_id FROM ev),
  cr AS (SELECT entity, commit_id AS commit_start, max(rev_id) AS rev_id FROM cm GROUP BY entity, commit_id),
  cv AS (SELECT c.*, e.status, lead(commit_start) OVER (PARTITION BY c.entity ORDER BY commit_start) AS commit_end
         FROM cr c JOIN ev e USING (rev_id))"""


def commit_log(t):
    return t.orders.select("entity", "rev_id", "status", (F.year("ts") * 12 + F.month("ts")).alias("commit_id"))


@query("versions_per_commit", f"WITH {EV}, {COMMIT} SELECT entity, rev_id, status, commit_start, commit_end FROM cv")
def _(t):
    return D.versions_per_commit(commit_log(t))


@query("as_of_commit", f"""WITH {EV}, {COMMIT} SELECT entity, rev_id, status, commit_start, commit_end FROM cv
  WHERE commit_start <= {1998 * 12 + 6} AND (commit_end IS NULL OR commit_end > {1998 * 12 + 6})""")
def _(t):
    return D.as_of_commit(D.versions_per_commit(commit_log(t)), 1998 * 12 + 6)


CHANGES = f"""v AS (SELECT entity, rev_id, ts, status, size_bytes, lag(status) OVER w AS before,
    row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY entity ORDER BY ts, rev_id)),
  g AS (SELECT *, sum(CASE WHEN rn = 1 OR status <> before THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, rev_id) AS ver FROM v),
  f AS (SELECT entity, ver, min(ts) AS ts, arg_min(rev_id, rn) AS rev_id, min(status) AS status, arg_max(size_bytes, rn) AS size_bytes
        FROM g GROUP BY entity, ver),
  h AS (SELECT *, lead(ts) OVER (PARTITION BY entity ORDER BY ver) AS nx FROM f)
  SELECT entity, rev_id, status, size_bytes, ts AS row_start, coalesce(nx, {SYS_MAX}) AS row_end FROM h WHERE nx IS NULL OR nx > ts"""


@query("scd2_tracking", f"WITH {EV}, {CHANGES}")
def _(t):
    return D.scd2_tracking(t.orders, ["status"], ["size_bytes"])


@query("scd2_without_noops", f"""WITH {EV}, {timeline()}, w AS (
    SELECT t.entity, t.rev_id, valid_from AS ts, status FROM tl t JOIN ev USING (entity, rev_id)),
  c AS (SELECT * FROM w QUALIFY lag(status) OVER (PARTITION BY entity ORDER BY ts) IS NULL
        OR status <> lag(status) OVER (PARTITION BY entity ORDER BY ts))
  SELECT entity, rev_id, status, ts AS row_start, coalesce(lead(ts) OVER (PARTITION BY entity ORDER BY ts), {SYS_MAX}) AS row_end FROM c""")
def _(t):
    return D.scd2_from_log(t.orders.select("entity", "rev_id", "ts", "status"), keep_noops=False)


@query("start_versioning", f"""SELECT c_custkey, c_mktsegment, TIMESTAMP '{T0}' AS row_start, {SYS_MAX} AS row_end FROM customer""")
def _(t):
    return D.start_versioning(t["customer"].select("c_custkey", "c_mktsegment"), T0)


@query("stop_versioning", f"{MI} SELECT entity, rev_id, size_bytes, status, priority FROM mi WHERE row_end = {SYS_MAX}")
def _(t):
    return D.stop_versioning(mirror_of(t))


# Loaded after the fact: the load-stamped table knows nothing as of T0, the events do.
@query("load_stamped", f"""WITH {EV}, {timeline()},
  n AS (SELECT entity, rev_id FROM ev QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, rev_id DESC) = 1),
  a AS (SELECT entity, rev_id FROM tl WHERE valid_from <= TIMESTAMP '{T0}' AND valid_to > TIMESTAMP '{T0}')
  SELECT n.entity, n.rev_id AS loaded_rev, CAST(NULL AS BIGINT) AS as_of_load, a.rev_id AS as_of_event FROM n LEFT JOIN a USING (entity)""")
def _(t):
    loaded = D.load_stamped(t.orders, END)
    past = D.as_of(loaded, T0).select("entity", F.col("rev_id").alias("as_of_load"))
    true = L.snapshot_of_events(t.orders, T0).select("entity", F.col("rev_id").alias("as_of_event"))
    return (loaded.select("entity", F.col("rev_id").alias("loaded_rev"))
            .join(past, "entity", "left").join(true, "entity", "left"))


@query("retention_cutoff", f"{MI} SELECT {MROWS} FROM mi WHERE row_end >= TIMESTAMP '{T0}'")
def _(t):
    return D.keep_since(mirror_of(t), T0)


@query("live_counts_per_year", f"""WITH {EV}, {timeline()}, {mirror()}, y AS (SELECT unnest(range(1996, 2002)) AS y),
  a AS (SELECT y, count(*) AS n FROM y JOIN tl ON valid_from < make_date(y + 1, 1, 1) AND valid_to > make_date(y, 1, 1) GROUP BY y),
  b AS (SELECT y, count(*) AS n FROM y JOIN mi ON row_start < make_date(y + 1, 1, 1) AND row_end > make_date(y, 1, 1) GROUP BY y)
  SELECT CAST(y AS INTEGER) AS year, a.n AS app_rows, b.n AS mirror_rows, a.n = b.n AS agrees FROM a JOIN b USING (y)""")
def _(t):
    return D.live_counts_per_year(B.build_timeline(t.orders), mirror_of(t), 1996, 2001)


@query("dataset_statistics", f"""{BEL}, {DOC}, tx AS (SELECT DISTINCT text FROM doc WHERE NOT hidden)
  SELECT (SELECT count(DISTINCT entity) FROM ev) AS entities, (SELECT count(*) FROM ev) AS revisions,
         (SELECT count(*) FROM tx) AS texts, (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM tx) AS raw_bytes,
         (SELECT count(*) FROM bel WHERE row_end < {SYS_MAX}) AS history_rows""")
def _(t):
    from twinclock.operators.content import distinct_texts
    return D.dataset_statistics(t.orders, distinct_texts(t.documents).select("byte_length"), beliefs_of(t))


def lab_part(key):
    def run(t):
        bundle = lab(B.build_timeline(t.orders), t.orders, beliefs_of(t), mirror_of(t), CHECKPOINTS, START, END, t=T0)
        out = bundle[key]
        return shown(out) if "valid_to" in out.columns else out
    return run


query("lab_bitemporal", f"""{BEL} SELECT 'now' AS knowledge, entity, rev_id, valid_from, {open_end('valid_to')} AS valid_to FROM bel
  WHERE row_end = {SYS_MAX} AND valid_from <= TIMESTAMP '{T0}' AND valid_to > TIMESTAMP '{T0}'
  UNION ALL SELECT 'first checkpoint', entity, rev_id, valid_from, {open_end('valid_to')} FROM bel
  WHERE row_start <= TIMESTAMP '{COMMITS[0]}' AND row_end > TIMESTAMP '{COMMITS[0]}'
  AND valid_from <= TIMESTAMP '{T0}' AND valid_to > TIMESTAMP '{T0}'""")(lab_part("bitemporal"))

query("lab_between", f"""{BEL} SELECT {BROWS} FROM bel WHERE row_start <= TIMESTAMP '{COMMITS[-1]}'
  AND row_end > TIMESTAMP '{COMMITS[0]}'""")(lab_part("between"))

query("lab_mirror_between", f"""{MI} SELECT {MROWS} FROM mi WHERE row_start <= TIMESTAMP '1998-12-31 23:59:59'
  AND row_end > TIMESTAMP '1998-01-01 00:00:00'""")(lab_part("mirror_between"))


# ---- version tables on disk ----------------------------------------------------------------------

@query("version_table_roundtrip", f"{MI} SELECT {MROWS} FROM mi")
def _(t):
    return version_table(t).all()


@query("version_table_current", f"{MI} SELECT {MROWS} FROM mi WHERE row_end = {SYS_MAX}")
def _(t):
    return version_table(t).current()


@query("version_table_as_of", f"{MI} SELECT {MROWS} FROM mi WHERE row_start <= TIMESTAMP '{T0}' AND row_end > TIMESTAMP '{T0}'")
def _(t):
    return version_table(t).as_of(T0)


@query("version_table_between", f"{MI} SELECT {MROWS} FROM mi WHERE row_start <= TIMESTAMP '{P2}' AND row_end > TIMESTAMP '{P1}'")
def _(t):
    return version_table(t).between(P1, P2)


@query("version_table_year", f"{MI} SELECT {MROWS} FROM mi WHERE year(row_end) = 1998")
def _(t):
    return version_table(t).partition("1998")


@query("version_table_append", f"""{MI} SELECT {MROWS} FROM mi""")
def _(t):
    """Explicit history: closed versions first, the current ones appended later."""
    from twinclock.session import new_table_path
    from twinclock.sources.layout import VersionTable
    rows = mirror_of(t)
    table = VersionTable(t.spark, new_table_path(t.spark, "append"))
    table.append(D.superseded(rows))
    table.append(D.current(rows))
    return table.all()


@query("version_table_counts", f"""{MI} SELECT CASE WHEN row_end = {SYS_MAX} THEN 'CURRENT' ELSE CAST(year(row_end) AS VARCHAR) END AS end_year,
  count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM mi GROUP BY 1""")
def _(t):
    return version_table(t).partition_counts("size_bytes")


@query("version_table_retention", f"{MI} SELECT {MROWS} FROM mi WHERE row_end >= TIMESTAMP '{T0}'")
def _(t):
    table = version_table(t)
    table.retain_since(T0)
    return table.all()


@query("version_table_drop_years", f"{MI} SELECT {MROWS} FROM mi WHERE row_end >= TIMESTAMP '1998-01-01'")
def _(t):
    table = version_table(t)
    table.drop_years_before(1998)
    return table.all()


# Retention at T0: the partitions below it are gone for every reader, and the one it cuts through is cut.
@query("version_table_year_after_retention", f"{MI} SELECT {MROWS} FROM mi WHERE year(row_end) IN (1997, 1998) AND row_end >= TIMESTAMP '{T0}'")
def _(t):
    table = version_table(t)
    table.retain_since(T0)
    return table.partition("1997").unionByName(table.partition("1998"))


@query("version_table_counts_after_retention", f"""{MI} SELECT CASE WHEN row_end = {SYS_MAX} THEN 'CURRENT' ELSE CAST(year(row_end) AS VARCHAR) END AS end_year,
  count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM mi WHERE row_end >= TIMESTAMP '{T0}' GROUP BY 1""")
def _(t):
    table = version_table(t)
    table.retain_since(T0)
    table.clean_up()
    return table.partition_counts("size_bytes")


def version_table(t):
    from twinclock.session import new_table_path
    from twinclock.sources.layout import VersionTable
    table = VersionTable(t.spark, new_table_path(t.spark, "mirror"))
    table.append(mirror_of(t))
    return table
