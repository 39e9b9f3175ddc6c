"""Quality checks. Each group aggregates its tables once and gives rows (name, level, ok, detail).

A failed check of level error fails the whole report, one of level warn is only shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock.operators import catalog as C
from twinclock.operators import timelines as B
from twinclock.operators.content import damaged_texts
from twinclock.operators.slices import Scan
from twinclock.operators.systime import cross_check
from twinclock.schema import infinity, ntz, system_max

ERROR, WARN = "error", "warn"


def _report(one_row: DataFrame, *checks: tuple[str, str, Column, Column]) -> DataFrame:
    """Turn one row of aggregates into one row per check."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(level).alias("level"),
                              F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))
                     for n, level, ok, detail in checks])
    return one_row.select(F.explode(rows).alias("c")).select("c.*")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("0")) for p in parts])


def _bad(name: str, level: str, count: str, what: str) -> tuple:
    n = F.coalesce(F.col(count), F.lit(0))
    return name, level, n == 0, _text(n, f" {what}")


def _merge(*one_rows: DataFrame) -> DataFrame:
    """Several single-row aggregates side by side."""
    out = one_rows[0]
    for o in one_rows[1:]:
        out = out.unionByName(o, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def together(*reports: DataFrame) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def overall(report: DataFrame) -> DataFrame:
    failed = F.count_if(~F.col("ok") & (F.col("level") == ERROR))
    return report.agg(F.count(F.lit(1)).alias("checks"), failed.alias("failed_errors"),
                      F.count_if(~F.col("ok") & (F.col("level") == WARN)).alias("failed_warnings"), (failed == 0).alias("ok"))


def curated_checks(entries: DataFrame, records: DataFrame, expected: int | None = None) -> DataFrame:
    """Curated list and its resolution. ``records`` carry position, requested_title, domain, status, page_id."""
    problems = _count(C.curated_problems(entries), "problems")
    n = _count(entries, "n")
    e = entries.select("position", F.col("title").alias("want_title"), F.col("domain").alias("want_domain"), F.lit(True).alias("wanted"))
    r = records.select("position", "requested_title", "domain", F.lit(True).alias("present"))
    moved = e.join(r, "position", "full_outer").filter(
        F.col("wanted").isNull() | F.col("present").isNull()
        | ~F.col("want_title").eqNullSafe(F.col("requested_title")) | ~F.col("want_domain").eqNullSafe(F.col("domain")))
    pages = records.filter(C.usable()).agg(F.count("page_id").alias("owned"), F.count_distinct("page_id").alias("pages"))
    row = _merge(problems, n, _count(moved, "moved"), C.status_summary(records), pages)
    right_size = F.lit(True) if expected is None else F.col("n") == expected
    return _report(
        row,
        ("curated list valid", ERROR, (F.col("problems") == 0) & right_size, _text(F.col("n"), " entries, ", F.col("problems"), " problems")),
        _bad("resolution keeps titles, order and domains", ERROR, "moved", "entries differ"),
        ("all titles resolved", WARN, F.col("missing") + F.col("error") == 0,
         _text(F.col("usable"), " usable, ", F.col("missing"), " missing, ", F.col("error"), " errors")),
        ("no page twice among usable titles", ERROR, F.col("owned") == F.col("pages"),
         _text(F.col("owned"), " usable, ", F.col("pages"), " pages")))


def catalogue_checks(curated: DataFrame, records: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles against the curated titles and the resolution records, and their own rules."""
    curated_n, rows_n = _count(curated, "curated"), _count(articles, "rows")
    have = articles.select("requested_title", F.col("status").alias("have"))
    differ = (records.select("requested_title", "status").join(have, "requested_title", "left")
              .filter(~F.col("status").eqNullSafe(F.col("have"))))
    own = articles.agg(
        F.count_if(C.usable()).alias("usable"),
        F.count_if(C.usable() & (F.col("page_id").isNull() | F.col("url").isNull())).alias("incomplete"))
    row = _merge(curated_n, rows_n, _count(differ, "differ"), own, _count(C.pages_with_two_owners(articles), "twice"))
    return _report(
        row,
        ("every curated title has a row", ERROR, F.col("rows") == F.col("curated"),
         _text(F.col("rows"), " rows for ", F.col("curated"), " titles")),
        _bad("articles match the resolution", ERROR, "differ", "differ"),
        _bad("usable articles are complete", ERROR, "incomplete", "incomplete"),
        _bad("no page with two owners", ERROR, "twice", "pages owned twice"))


def event_checks(events: DataFrame, start, end) -> DataFrame:
    """Counts, range, unique ids and the window. Events carry is_baseline and content_status."""
    per_entity = events.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"),
        F.count_if(F.col("content_status") == "available").alias("available"), F.count_if(F.col("content_status") == "hidden").alias("hidden"),
        F.count_if("is_baseline").alias("baselines"),
        F.count_if(~F.col("is_baseline") & ~F.col("ts").between(ntz(start), ntz(end))).alias("outside"))
    totals = per_entity.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("entities"), F.min("a").alias("a"), F.max("z").alias("z"),
        *[F.sum(c).alias(c) for c in ("available", "hidden", "baselines", "outside")])
    repeated = events.groupBy("rev_id").count().filter(F.col("count") > 1)
    row = _merge(totals, _count(repeated, "repeated"))
    return _report(
        row,
        ("revision count", WARN, F.col("n") > 0,
         _text(F.col("n"), " revisions of ", F.col("entities"), " entities, ", F.col("available"), " with text, ",
               F.col("hidden"), " hidden, ", F.col("baselines"), " baselines, ", F.col("a"), " to ", F.col("z"))),
        _bad("revision ids are unique", ERROR, "repeated", "repeated"),
        _bad("events lie inside the window", ERROR, "outside", "outside"))


def reference_checks(events: DataFrame, articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Events point to entities and texts that exist; usable entities have events.

    Keys of the anti joins may be hot on the events' side only, which the skew join can split.
    """
    ids = articles.select(F.col("article_id").alias("entity"))
    orphans = events.select("entity").join(ids, "entity", "left_anti")
    textless = (events.filter("content_status = 'available'").select("sha1").join(texts.select("sha1"), "sha1", "left_anti"))
    idle = (articles.filter(C.usable()).select(F.col("article_id").alias("entity"))
            .join(events.select("entity").distinct(), "entity", "left_anti"))
    row = _merge(_count(orphans, "orphans"), _count(textless, "textless"), _count(idle, "idle"))
    return _report(
        row,
        _bad("events reference an entity", ERROR, "orphans", "orphans"),
        _bad("available events have a text", ERROR, "textless", "without text"),
        _bad("usable entities have events", WARN, "idle", "without events"))


def timeline_checks(timeline: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Interval rules from one scan of the timeline."""
    nxt = F.col("next_from")
    row = B.with_next_interval(timeline, max_rows).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("valid_from") >= F.col("valid_to")).alias("empty"),
        F.count_if(F.col("valid_to") > nxt).alias("overlaps"),
        F.count_if(F.col("valid_to") < nxt).alias("gaps"),
        F.count_if(nxt.isNull() & (F.col("valid_to") != infinity())).alias("last_closed"),
        F.count_if(nxt.isNotNull() & (F.col("valid_to") == infinity())).alias("open_inside"),
        F.count_if(F.col("valid_to") != nxt).alias("broken"))
    return _report(
        row,
        ("valid_from before valid_to", ERROR, F.col("empty") == 0, _text(F.col("empty"), " bad of ", F.col("n"))),
        _bad("no overlaps", ERROR, "overlaps", "overlaps"),
        _bad("no gaps", ERROR, "gaps", "gaps"),
        ("only the last interval is open", ERROR, (F.col("last_closed") == 0) & (F.col("open_inside") == 0),
         _text(F.col("last_closed"), " last not open, ", F.col("open_inside"), " open not last")),
        _bad("valid_to is the next valid_from", ERROR, "broken", "mismatches"))


def timeline_event_checks(timeline: DataFrame, events: DataFrame, start, max_rows: int | None = None) -> DataFrame:
    """The timeline against the events it was made from."""
    ev = events.select("rev_id", F.col("entity").alias("of"), "ts")
    mismatch = timeline.join(ev, "rev_id").filter((F.col("valid_from") != F.col("ts")) | (F.col("entity") != F.col("of")))
    off = events.select("entity", "rev_id", "ts").join(timeline.select("rev_id"), "rev_id", "left_anti")
    unaccounted = off.join(B.shadowed(events, max_rows).select("rev_id"), "rev_id", "left_anti")
    late = (timeline.groupBy("entity").agg(F.min("valid_from").alias("first"))
            .agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("first") > ntz(start)).alias("late")))
    row = _merge(_count(mismatch, "mismatch"), _count(off, "off"), _count(unaccounted, "unaccounted"), late)
    return _report(
        row,
        _bad("valid_from is the event's instant", ERROR, "mismatch", "mismatches"),
        ("every event is on the timeline or shadowed", ERROR, F.col("unaccounted") == 0,
         _text(F.col("unaccounted"), " unaccounted, ", F.col("off"), " shadowed")),
        ("every entity has a state at the window start", WARN, F.col("late") == 0,
         _text(F.col("entities"), " entities, ", F.col("late"), " created later")))


def version_checks(versions: DataFrame, current: DataFrame, events: DataFrame) -> DataFrame:
    """System time: order of bounds, current rows, references."""
    v = versions.agg(
        F.count_if(F.col("row_end") == system_max()).alias("current"), F.count_if(F.col("row_end") < system_max()).alias("history"),
        F.count_if(F.col("row_start") >= F.col("row_end")).alias("bad"))
    orphans = versions.select("rev_id").join(events.select("rev_id"), "rev_id", "left_anti")
    row = _merge(v, _count(current, "now"), _count(orphans, "orphans"))
    return _report(
        row,
        ("row_start before row_end", ERROR, F.col("bad") == 0, _text(F.col("current"), " current, ", F.col("history"), " superseded")),
        ("current rows are the versions without end", ERROR, F.col("now") == F.col("current"), _text(F.col("now"), " and ", F.col("current"))),
        _bad("history references events", ERROR, "orphans", "orphans"))


def checkpoint_checks(checkpoints: DataFrame) -> DataFrame:
    """Commits are ordered in system time. The commit log has one row per batch and is one group here."""
    log = checkpoints.withColumn("log", F.lit(1))
    row = (Scan(log, "log", ["batch_id"]).lag("completed_at", "before").result()
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("completed_at") < F.col("before")).alias("back")))
    return _report(row, ("checkpoints are ordered", ERROR, F.col("back") == 0, _text(F.col("n"), " checkpoints")))


def state_checks(articles: DataFrame, state: DataFrame, end, runs: DataFrame | None = None) -> DataFrame:
    """Usable entities are synced to the window end; their ranges, and the windows of ``runs`` if given, are ordered."""
    s = state.select(F.col("entity").alias("article_id"), "synced_from", "synced_through")
    behind = F.col("synced_through").isNull() | (F.col("synced_through") < ntz(end))
    row = (articles.filter(C.usable()).select("article_id").join(s, "article_id", "left")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(behind).alias("behind")))
    reversed_ = state.filter(F.col("synced_from") > F.col("synced_through")).select(F.lit(1).alias("k"))
    if runs is not None:
        reversed_ = reversed_.unionByName(runs.filter(F.col("window_start") >= F.col("window_end")).select(F.lit(1).alias("k")))
    wrong = _count(reversed_, "reversed")
    return _report(
        _merge(row, wrong),
        ("usable entities are synced to the window end", WARN, F.col("behind") == 0, _text(F.col("behind"), " of ", F.col("n"), " behind")),
        _bad("synced ranges are ordered", ERROR, "reversed", "reversed"))


def text_checks(texts: DataFrame, events: DataFrame) -> DataFrame:
    """All stored texts against their digests, and the status rule of events."""
    wrong_status = events.filter((F.col("content_status") == "available") != F.col("sha1").isNotNull())
    row = _merge(_count(texts, "n"), _count(damaged_texts(texts), "bad"), _count(wrong_status, "status"))
    return _report(
        row,
        ("texts match their digest", ERROR, F.col("bad") == 0, _text(F.col("bad"), " damaged of ", F.col("n"))),
        _bad("a text is available exactly with a digest", ERROR, "status", "violations"))


def agreement_check(timeline: DataFrame, mirror: DataFrame, start, max_rows: int | None = None, strategy: str = "carry") -> DataFrame:
    """Timeline and mirror give the same answer at every boundary and a second before it; ``strategy`` as in
    ``cross_check``."""
    probes = (timeline.filter(F.col("valid_from") >= ntz(start))
              .select("entity", "rev_id", "valid_from", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
              .select((F.col("rev_id") * 2 + F.col("k")).alias("probe_id"), "entity",
                      (F.col("valid_from") - F.make_dt_interval(secs=F.col("k").cast("decimal(18,6)"))).alias("t")))
    row = cross_check(timeline, mirror, probes, max_rows, strategy).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("agrees")).alias("differ"))
    return _report(row, ("timeline and mirror agree", ERROR, F.col("differ") == 0,
                         _text(F.col("differ"), " of ", F.col("n"), " probes differ")))
