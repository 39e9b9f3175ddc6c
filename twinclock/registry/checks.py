"""Queries for the quality checks: on sound tables, and on tables damaged on purpose."""

from pyspark.sql import functions as F

from twinclock.operators import quality as V
from twinclock.operators import systime as D
from twinclock.operators import timelines as B
from twinclock.operators.content import distinct_texts
from twinclock.plans.sync import backfill_beliefs
from twinclock.registry import core, titles
from twinclock.registry.app_time import DAMAGED, damaged
from twinclock.registry.core import query
from twinclock.registry.sql import (CHECKPOINTS, COMMITS, CUTOFFS, DOC, END, EV, INF, START, SYS_MAX, beliefs, mirror,
                                    timeline)
from twinclock.registry.titles import ART, RECORDS
from twinclock.schema import ntz
from twinclock.sources.revisions import baseline


def report(ctes: str, *checks: tuple[str, str, str, str]) -> str:
    """SQL twin: one SELECT per check."""
    rows = [f"SELECT '{n}' AS name, '{level}' AS level, {ok} AS ok, {detail} AS detail" for n, level, ok, detail in checks]
    return f"WITH {ctes}\n" + "\nUNION ALL ".join(rows)


def bad(name: str, level: str, count: str, what: str) -> tuple:
    return name, level, f"({count}) = 0", f"({count}) || ' {what}'"


# ---- curated list and catalogue ------------------------------------------------------------------

PROBLEMS = """pe AS (SELECT position, requested_title AS t, domain AS d, min(position) OVER (PARTITION BY lower(trim(requested_title))) AS first FROM {src}),
    pb AS (SELECT count(*) FILTER (WHERE t IS NULL OR trim(t) = '') + count(*) FILTER (WHERE d IS NULL OR trim(d) = '')
             + count(*) FILTER (WHERE t IS NOT NULL AND first < position) AS n FROM pe)"""

@query("check_curated", report(
    f"{RECORDS}, sm AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'error') AS error,"
    " count(*) FILTER (WHERE status IN ('resolved', 'redirect')) AS usable, count(DISTINCT page_id) FILTER (WHERE status IN ('resolved', 'redirect')) AS pages FROM fin),"
    f" {PROBLEMS.format(src='u')}",
    ("curated list valid", "error", "(SELECT sum(n) = 0 FROM pb)", "(SELECT n FROM sm) || ' entries, ' || (SELECT sum(n) FROM pb) || ' problems'"),
    bad("resolution keeps titles, order and domains", "error",
        "SELECT count(*) FROM u FULL JOIN fin f USING (position) WHERE u.requested_title IS DISTINCT FROM f.requested_title OR u.domain IS DISTINCT FROM f.domain", "entries differ"),
    ("all titles resolved", "warn", "(SELECT missing + error = 0 FROM sm)", "(SELECT usable || ' usable, ' || missing || ' missing, ' || error || ' errors' FROM sm)"),
    ("no page twice among usable titles", "error", "(SELECT usable = pages FROM sm)", "(SELECT usable || ' usable, ' || pages || ' pages' FROM sm)")))
def _(t):
    feed = titles.feed(t)
    records = titles.C.mark_duplicates(titles.C.classify(*feed))
    return V.curated_checks(feed[0].withColumnRenamed("requested_title", "title"), records)


# The list as it came back damaged: blog pages lost their domain, French ones their title, every 40th row is gone.
@query("check_curated_damaged", report(
    f"""{RECORDS}, de AS (SELECT position, CASE WHEN requested_title LIKE '%/fr/%' THEN ' ' ELSE requested_title END AS requested_title,
      CASE WHEN requested_title LIKE '%//blog.%' THEN NULL ELSE domain END AS domain FROM u WHERE position % 40 <> 7), {PROBLEMS.format(src='de')},
    sm AS (SELECT count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'error') AS error,
      count(*) FILTER (WHERE status IN ('resolved', 'redirect')) AS usable, count(DISTINCT page_id) FILTER (WHERE status IN ('resolved', 'redirect')) AS pages FROM rec)""",
    ("curated list valid", "error", "(SELECT sum(n) = 0 FROM pb)", "(SELECT count(*) FROM de) || ' entries, ' || (SELECT sum(n) FROM pb) || ' problems'"),
    bad("resolution keeps titles, order and domains", "error",
        """SELECT count(*) FROM de FULL JOIN rec r ON r.position = de.position WHERE de.position IS NULL OR r.position IS NULL
             OR de.requested_title IS DISTINCT FROM r.requested_title OR de.domain IS DISTINCT FROM r.domain""", "entries differ"),
    ("all titles resolved", "warn", "(SELECT missing + error = 0 FROM sm)", "(SELECT usable || ' usable, ' || missing || ' missing, ' || error || ' errors' FROM sm)"),
    ("no page twice among usable titles", "error", "(SELECT usable = pages FROM sm)", "(SELECT usable || ' usable, ' || pages || ' pages' FROM sm)")))
def _(t):
    feed = titles.feed(t)
    entries = feed[0].filter("position % 40 <> 7").select(
        "position", F.when(F.col("requested_title").like("%/fr/%"), " ").otherwise(F.col("requested_title")).alias("title"),
        F.when(~F.col("requested_title").like("%//blog.%"), F.col("domain")).alias("domain"))
    return V.curated_checks(entries, titles.C.classify(*feed))   # duplicates not marked: pages come twice


@query("check_catalogue", report(
    f"{ART}, own2 AS (SELECT page_id FROM art WHERE status IN ('resolved', 'redirect') AND page_id IS NOT NULL GROUP BY page_id HAVING count(*) > 1)",
    ("every curated title has a row", "error", "(SELECT count(*) FROM art) = (SELECT count(*) FROM customer)",
     "(SELECT count(*) FROM art) || ' rows for ' || (SELECT count(*) FROM customer) || ' titles'"),
    bad("articles match the resolution", "error", "SELECT count(*) FROM art WHERE domain = 'EUROPE' AND status = 'missing'", "differ"),
    bad("usable articles are complete", "error", "SELECT count(*) FROM art WHERE status IN ('resolved', 'redirect') AND (page_id IS NULL OR url IS NULL)", "incomplete"),
    bad("no page with two owners", "error", "SELECT count(*) FROM own2", "pages owned twice")))
def _(t):
    arts = titles.articles(t)
    manifest = arts.withColumn("status", F.when((F.col("domain") == "EUROPE") & (F.col("status") == "missing"), "redirect")
                               .otherwise(F.col("status")))
    return V.catalogue_checks(t["customer"], manifest, arts)


# Articles of AFRICA were lost.
@query("check_catalogue_damaged", report(
    f"{ART}, lost AS (SELECT * FROM art WHERE domain <> 'AFRICA'), own2 AS (SELECT page_id FROM lost WHERE status IN ('resolved', 'redirect') AND page_id IS NOT NULL GROUP BY page_id HAVING count(*) > 1)",
    ("every curated title has a row", "error", "(SELECT count(*) FROM lost) = (SELECT count(*) FROM customer)",
     "(SELECT count(*) FROM lost) || ' rows for ' || (SELECT count(*) FROM customer) || ' titles'"),
    bad("articles match the resolution", "error", "SELECT count(*) FROM art WHERE domain = 'AFRICA'", "differ"),
    bad("usable articles are complete", "error", "SELECT count(*) FROM lost WHERE status IN ('resolved', 'redirect') AND (page_id IS NULL OR url IS NULL)", "incomplete"),
    bad("no page with two owners", "error", "SELECT count(*) FROM own2", "pages owned twice")))
def _(t):
    arts = titles.articles(t)
    return V.catalogue_checks(t["customer"], arts, arts.filter("domain <> 'AFRICA'"))


# ---- events --------------------------------------------------------------------------------------

# Documents of the first month are outside the window unless they are the baseline of their source.
WINDOW = ("2020-01-05 00:00:00", "2030-01-01 00:00:00")
DOCS = f"""{DOC}, bl AS (SELECT rev_id FROM doc WHERE ts <= TIMESTAMP '{WINDOW[0]}' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, rev_id DESC) = 1),
  dv AS (SELECT doc.*, rev_id IN (SELECT rev_id FROM bl) AS is_baseline, CASE WHEN hidden THEN 'hidden' ELSE 'available' END AS content_status FROM doc)"""


def doc_events(t):
    docs = t.documents
    first = baseline(docs.select("entity", "rev_id", "ts"), WINDOW[0]).select("rev_id", "is_baseline")
    return (docs.join(first, "rev_id", "left").withColumns({
        "is_baseline": F.coalesce("is_baseline", F.lit(False)),
        "content_status": F.when(F.col("hidden"), "hidden").otherwise("available"),
        "sha1": F.when(~F.col("hidden"), F.col("sha1"))}))


@query("check_events", report(
    DOCS,
    ("revision count", "warn", "(SELECT count(*) > 0 FROM dv)",
     """(SELECT count(*) || ' revisions of ' || count(DISTINCT entity) || ' entities, ' || count(*) FILTER (WHERE NOT hidden) || ' with text, '
        || count(*) FILTER (WHERE hidden) || ' hidden, ' || count(*) FILTER (WHERE is_baseline) || ' baselines, '
        || CAST(min(ts) AS VARCHAR) || ' to ' || CAST(max(ts) AS VARCHAR) FROM dv)"""),
    bad("revision ids are unique", "error", "SELECT count(*) - count(DISTINCT rev_id) FROM dv", "repeated"),
    bad("events lie inside the window", "error", f"SELECT count(*) FROM dv WHERE NOT is_baseline AND ts NOT BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}'", "outside")))
def _(t):
    return V.event_checks(doc_events(t), *WINDOW)


# Customers of ASIA are unknown to the catalogue, and finished orders have lost their texts.
@query("check_references", report(
    f"{ART}, {EV}, known AS (SELECT * FROM art WHERE domain <> 'ASIA')",
    bad("events reference an entity", "error", "SELECT count(*) FROM ev WHERE entity NOT IN (SELECT article_id FROM known)", "orphans"),
    bad("available events have a text", "error", "SELECT count(*) FROM ev WHERE status = 'F'", "without text"),
    bad("usable entities have events", "warn", "SELECT count(*) FROM known WHERE status IN ('resolved', 'redirect') AND article_id NOT IN (SELECT entity FROM ev)", "without events")))
def _(t):
    ev = t.orders.withColumns({"sha1": F.sha1(F.col("rev_id").cast("string")), "content_status": F.lit("available")})
    texts = ev.filter("status <> 'F'").select("sha1")
    return V.reference_checks(ev, titles.articles(t).filter("domain <> 'ASIA'"), texts)


# ---- timeline ------------------------------------------------------------------------------------

def timeline_rows(src: str) -> list[tuple]:
    return [
        ("valid_from before valid_to", "error", f"(SELECT count(*) = 0 FROM {src} WHERE valid_from >= valid_to)",
         f"(SELECT count(*) FILTER (WHERE valid_from >= valid_to) || ' bad of ' || count(*) FROM {src})"),
        bad("no overlaps", "error", f"SELECT count(*) FROM {src} WHERE valid_to > next_from", "overlaps"),
        bad("no gaps", "error", f"SELECT count(*) FROM {src} WHERE valid_to < next_from", "gaps"),
        ("only the last interval is open", "error",
         f"(SELECT count(*) = 0 FROM {src} WHERE (next_from IS NULL) <> (valid_to = {INF}))",
         f"""(SELECT count(*) FILTER (WHERE next_from IS NULL AND valid_to <> {INF}) || ' last not open, '
             || count(*) FILTER (WHERE next_from IS NOT NULL AND valid_to = {INF}) || ' open not last' FROM {src})"""),
        bad("valid_to is the next valid_from", "error", f"SELECT count(*) FROM {src} WHERE valid_to <> next_from", "mismatches")]


@query("check_timeline", report(
    f"{EV}, {timeline()}, tn AS (SELECT *, lead(valid_from) OVER (PARTITION BY entity ORDER BY valid_from) AS next_from FROM tl)", *timeline_rows("tn")))
def _(t):
    return V.timeline_checks(B.build_timeline(t.orders))


@query("check_timeline_damaged", report(f"{EV}, {timeline()}, {DAMAGED}", *timeline_rows("dn")))
def _(t):
    return V.timeline_checks(damaged(t))


def timeline_event_rows(line: str, ev: str) -> list[tuple]:
    return [
        bad("valid_from is the event''s instant", "error",
            f"SELECT count(*) FROM {line} l JOIN {ev} e USING (rev_id) WHERE l.valid_from <> e.ts OR l.entity <> e.entity", "mismatches"),
        ("every event is on the timeline or shadowed", "error",
         f"(SELECT count(*) = 0 FROM {ev} WHERE rev_id NOT IN (SELECT rev_id FROM {line}) AND rev_id NOT IN (SELECT rev_id FROM tl_rk WHERE rn > 1))",
         f"""(SELECT count(*) FROM {ev} WHERE rev_id NOT IN (SELECT rev_id FROM {line}) AND rev_id NOT IN (SELECT rev_id FROM tl_rk WHERE rn > 1)) || ' unaccounted, '
             || (SELECT count(*) FROM {ev} WHERE rev_id NOT IN (SELECT rev_id FROM {line})) || ' shadowed'"""),
        ("every entity has a state at the window start", "warn",
         f"(SELECT max(f) <= TIMESTAMP '{START}' FROM (SELECT min(valid_from) AS f FROM {line} GROUP BY entity))",
         f"(SELECT count(*) || ' entities, ' || count(*) FILTER (WHERE f > TIMESTAMP '{START}') || ' created later' FROM (SELECT min(valid_from) AS f FROM {line} GROUP BY entity))")]


@query("check_timeline_events", report(f"{EV}, {timeline()}", *timeline_event_rows("tl", "ev")))
def _(t):
    return V.timeline_event_checks(B.build_timeline(t.orders), t.orders, START)


# Every 11th interval starts a day late, every 13th is missing.
@query("check_timeline_events_damaged", report(
    f"""{EV}, {timeline()}, dl AS (SELECT entity, rev_id, CASE WHEN rev_id % 11 = 0 THEN valid_from + INTERVAL 1 DAY ELSE valid_from END AS valid_from, valid_to
      FROM tl WHERE rev_id % 13 <> 0)""", *timeline_event_rows("dl", "ev")))
def _(t):
    late = F.when(F.col("rev_id") % 11 == 0, F.col("valid_from") + F.expr("interval 1 day")).otherwise(F.col("valid_from"))
    return V.timeline_event_checks(B.build_timeline(t.orders).filter("rev_id % 13 <> 0").withColumn("valid_from", late), t.orders, START)


# ---- system time ---------------------------------------------------------------------------------

def version_rows(versions: str, now: str, ev: str) -> list[tuple]:
    return [
        ("row_start before row_end", "error", f"(SELECT count(*) = 0 FROM {versions} WHERE row_start >= row_end)",
         f"(SELECT count(*) FILTER (WHERE row_end = {SYS_MAX}) || ' current, ' || count(*) FILTER (WHERE row_end < {SYS_MAX}) || ' superseded' FROM {versions})"),
        ("current rows are the versions without end", "error", f"(SELECT count(*) FROM {now}) = (SELECT count(*) FROM {versions} WHERE row_end = {SYS_MAX})",
         f"(SELECT count(*) FROM {now}) || ' and ' || (SELECT count(*) FROM {versions} WHERE row_end = {SYS_MAX})"),
        bad("history references events", "error", f"SELECT count(*) FROM {versions} WHERE rev_id NOT IN (SELECT rev_id FROM {ev})", "orphans")]


# The events without the P orders: beliefs about those are orphans.
@query("check_versions", report(f"{EV}, {beliefs()}, np AS (SELECT * FROM ev WHERE status <> 'P'), cu AS (SELECT * FROM bel WHERE row_end = {SYS_MAX})",
                                *version_rows("bel", "cu", "np")))
def _(t):
    versions = backfill_beliefs(t.orders, CHECKPOINTS)
    return V.version_checks(versions, D.current(versions), t.orders.filter("status <> 'P'"))


# Every 9th version ends where it starts, and every 17th current row is missing.
@query("check_versions_damaged", report(
    f"""{EV}, {beliefs()}, dv AS (SELECT rev_id, row_start, CASE WHEN rev_id % 9 = 0 THEN row_start ELSE row_end END AS row_end FROM bel),
      cu AS (SELECT * FROM bel WHERE row_end = {SYS_MAX} AND rev_id % 17 <> 0)""", *version_rows("dv", "cu", "ev")))
def _(t):
    versions = backfill_beliefs(t.orders, CHECKPOINTS)
    broken = versions.withColumn("row_end", F.when(F.col("rev_id") % 9 == 0, F.col("row_start")).otherwise(F.col("row_end")))
    return V.version_checks(broken, D.current(versions).filter("rev_id % 17 <> 0"), t.orders)


@query("check_checkpoints", report(
    f"""{EV}, c AS (SELECT year(ts) - 1994 AS batch_id, CASE WHEN year(ts) = 1999 THEN min(ts) ELSE max(ts) END AS completed_at FROM ev GROUP BY year(ts)),
    l AS (SELECT *, lag(completed_at) OVER (ORDER BY batch_id) AS before FROM c)""",
    ("checkpoints are ordered", "error", "(SELECT count(*) = 0 FROM l WHERE completed_at < before)", "(SELECT count(*) || ' checkpoints' FROM l)")))
def _(t):
    year = F.year("ts")
    log = (t.orders.groupBy((year - 1994).alias("batch_id"))
           .agg(F.when(F.first(year) == 1999, F.min("ts")).otherwise(F.max("ts")).alias("completed_at")))
    return V.checkpoint_checks(log)


@query("check_state", report(
    f"""{ART}, {EV}, st AS (SELECT entity, min(ts) AS synced_from, CASE WHEN min(status) = 'O' THEN TIMESTAMP '{START}' ELSE max(ts) END AS synced_through FROM ev GROUP BY entity),
    u AS (SELECT synced_through FROM art LEFT JOIN st ON entity = article_id WHERE status IN ('resolved', 'redirect'))""",
    ("usable entities are synced to the window end", "warn", "(SELECT count(*) = 0 FROM u WHERE synced_through IS NULL OR synced_through < TIMESTAMP '2001-07-01')",
     "(SELECT count(*) FILTER (WHERE synced_through IS NULL OR synced_through < TIMESTAMP '2001-07-01') || ' of ' || count(*) || ' behind' FROM u)"),
    bad("synced ranges are ordered", "error", "SELECT count(*) FROM st WHERE synced_from > synced_through", "reversed")))
def _(t):
    state = t.orders.groupBy("entity").agg(
        F.min("ts").alias("synced_from"),
        F.when(F.min("status") == "O", ntz(START)).otherwise(F.max("ts")).alias("synced_through"))
    return V.state_checks(titles.articles(t), state, "2001-07-01 00:00:00")


# ---- texts ---------------------------------------------------------------------------------------

@query("check_texts", report(
    f"{DOCS}, tx AS (SELECT DISTINCT text FROM doc WHERE NOT hidden)",
    ("texts match their digest", "error", "(SELECT count(*) = 0 FROM tx WHERE text LIKE '%!%')",
     "(SELECT count(*) FILTER (WHERE text LIKE '%!%') || ' damaged of ' || count(*) FROM tx)"),
    bad("a text is available exactly with a digest", "error", "SELECT count(*) FROM dv WHERE hidden", "violations")))
def _(t):
    stored = distinct_texts(t.documents).withColumn("text", F.regexp_replace("text", "!", "?"))
    # hidden revisions that kept their digest break the rule
    return V.text_checks(stored, doc_events(t).withColumn("sha1", F.coalesce("sha1", F.lit("kept"))))


AGREEMENT = f"""pr AS (SELECT rev_id, entity, valid_from - to_seconds(k) AS t FROM tl CROSS JOIN (VALUES (0), (1)) v(k) WHERE valid_from >= TIMESTAMP '{START}'),
  an AS (SELECT pr.rev_id, pr.t, a.rev_id AS app, m.rev_id AS mirror FROM pr LEFT JOIN tl a ON a.entity = pr.entity AND a.valid_from <= pr.t AND pr.t < a.valid_to
         LEFT JOIN {{mirror}} m ON m.entity = pr.entity AND m.row_start <= pr.t AND m.row_end > pr.t)"""
AGREES = ("timeline and mirror agree", "error", "(SELECT count(*) = 0 FROM an WHERE app IS DISTINCT FROM mirror)",
          "(SELECT count(*) FILTER (WHERE app IS DISTINCT FROM mirror) || ' of ' || count(*) || ' probes differ' FROM an)")


@query("check_agreement", report(f"{EV}, {timeline()}, {mirror()}, {AGREEMENT.format(mirror='mi')}", AGREES))
def _(t):
    return V.agreement_check(B.build_timeline(t.orders), D.scd2_from_log(t.orders), START)


# The mirror has lost every seventh version.
@query("check_agreement_damaged", report(f"{EV}, {timeline()}, {mirror()}, m7 AS (SELECT * FROM mi WHERE rev_id % 7 <> 0), {AGREEMENT.format(mirror='m7')}", AGREES))
def _(t):
    return V.agreement_check(B.build_timeline(t.orders), D.scd2_from_log(t.orders).filter("rev_id % 7 <> 0"), START)


# One validation run over all checks; its twin adds up the twins of the groups.
ALL = ["check_curated", "check_catalogue", "check_events", "check_references", "check_timeline", "check_timeline_events", "check_versions",
       "check_checkpoints", "check_state", "check_texts", "check_agreement"]


@query("quality_report", "WITH r AS (" + " UNION ALL ".join(f"SELECT * FROM ({core.ORACLES[n]})" for n in ALL) + """)
  SELECT count(*) AS checks, count(*) FILTER (WHERE NOT ok AND level = 'error') AS failed_errors, count(*) FILTER (WHERE NOT ok AND level = 'warn') AS failed_warnings,
         count(*) FILTER (WHERE NOT ok AND level = 'error') = 0 AS ok FROM r""")
def _(t):
    return V.overall(V.together(*[core.QUERIES[n](t.spark, t.folder) for n in ALL]))
