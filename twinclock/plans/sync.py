"""Incremental sync: from events to bitemporal beliefs, step by step or in one pass."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock.operators import timelines as B
from twinclock.operators.slices import find_hot
from twinclock.operators.content import distinct_texts
from twinclock.schema import infinity, ntz, system_max
from twinclock.session import materialise
from twinclock.sources import revisions as R
from twinclock.sources.store import Store, opened


# ---- pure steps ----------------------------------------------------------------------------------

def resume_ranges(entities: DataFrame, state: DataFrame, start, cutoff) -> DataFrame:
    """What is still to be read per entity: rows (entity, from, to, want_baseline), bounds included.

    Without state the whole window; otherwise the part before the synced range and the part after it. The
    boundary second is read again on purpose, known revisions drop out later.
    """
    s, c = ntz(start), ntz(cutoff)
    known = entities.select("entity").join(state, "entity", "left")
    none = F.col("synced_from").isNull()

    def span(a: Column, b: Column, baseline: Column) -> Column:
        return F.struct(a.alias("from"), b.alias("to"), baseline.alias("want_baseline"))

    ranges = F.array_compact(F.array(
        F.when(none, span(s, c, F.lit(True))),
        F.when(~none & (s < F.col("synced_from")), span(s, F.col("synced_from"), F.lit(True))),
        F.when(~none & (F.col("synced_through") < c), span(F.col("synced_through"), c, F.lit(False)))))
    return known.select("entity", F.explode(ranges).alias("r")).select("entity", "r.*")


def read_from(entities: DataFrame, state: DataFrame, start) -> str | None:
    """The earliest instant that any of ``entities`` still has to be read from, if all of them were synced from the
    start on; else None: some need their whole window and a baseline."""
    s = ntz(start)
    row = (entities.select("entity").join(state, "entity", "left").agg(
        F.count_if(F.col("synced_from").isNull() | (F.col("synced_from") > s)).alias("whole"),
        F.min("synced_through").cast("string").alias("through")).first())
    return row["through"] if row["whole"] == 0 else None


def events_to_read(events: DataFrame, state: DataFrame, start, cutoff, entities: DataFrame | None = None) -> DataFrame:
    """Events inside the resume ranges, plus baselines where wanted, flagged.

    With ``entities`` (all that are to be synced) the earliest instant still to be read reaches the scan of the events, and
    baselines are only looked for where an entity needs one.

    The events meet one row per entity (its synced range and its baseline), so nothing multiplies, and a hot
    entity can be split by the skew join. Only that narrow per-entity table is aggregated, never whole events.
    """
    s, c = ntz(start), ntz(cutoff)
    since = None if entities is None else read_from(entities, state, start)
    if since is not None:
        ranges = state.select("entity", "synced_through")
        return (events.filter((F.col("ts") >= ntz(since)) & (F.col("ts") <= c)).join(ranges, "entity")
                .filter((F.col("ts") >= F.col("synced_through")) & (F.col("synced_through") < c))
                .drop("synced_through").withColumn("is_baseline", F.lit(False)))
    first = (events.filter(F.col("ts") <= s).groupBy("entity")
             .agg(F.max(F.struct("ts", "rev_id")).alias("b")).select("entity", F.col("b.rev_id").alias("baseline")))
    per_entity = first.join(state.select("entity", "synced_from", "synced_through"), "entity", "full_outer")
    seen = events.filter(F.col("ts") <= c).join(per_entity, "entity", "left")
    back = F.col("synced_from").isNull() | (s < F.col("synced_from"))
    is_baseline = back & F.coalesce(F.col("rev_id") == F.col("baseline"), F.lit(False))
    wanted = (
        is_baseline
        | ((F.col("ts") >= s) & F.col("synced_from").isNull())
        | ((s < F.col("synced_from")) & F.col("ts").between(s, F.col("synced_from")))
        | ((F.col("ts") >= F.col("synced_through")) & (F.col("synced_through") < c)))
    return (seen.withColumn("is_baseline", is_baseline).filter(wanted)
            .drop("baseline", "synced_from", "synced_through"))


def state_upsert(state: DataFrame, synced: DataFrame, batch_id: int) -> DataFrame:
    """Widen the synced range of the entities in ``synced`` (entity, synced_from, synced_through)."""
    rows = state.unionByName(synced.withColumn("last_batch", F.lit(batch_id).cast("bigint")))
    return rows.groupBy("entity").agg(
        F.min("synced_from").alias("synced_from"), F.max("synced_through").alias("synced_through"),
        F.max("last_batch").alias("last_batch"))


def digest_mismatches(events: DataFrame) -> DataFrame:
    """Events whose text does not hash to the digest the feed reports."""
    return events.filter(F.col("sha1").isNotNull() & F.col("text").isNotNull() & (F.sha1("text") != F.col("sha1")))


def split_failed(events: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that proceed, entities that fail): one bad event fails its entity's whole step."""
    failed = bad.select("entity").distinct()
    return events.join(failed, "entity", "left_anti"), failed


def run_status(total: int, failed: int) -> str:
    return "succeeded" if failed == 0 else "partial" if failed < total else "failed"


def run_status_of(failed: Column, total: Column) -> Column:
    return F.when(failed == 0, "succeeded").when(failed < total, "partial").otherwise("failed")


def late_entities(open_rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entities with a fresh event before the start of their open interval."""
    heads = open_rows.select("entity", F.col("valid_from").alias("head"))
    return (fresh.groupBy("entity").agg(F.min("ts").alias("first")).join(heads, "entity")
            .filter(F.col("first") < F.col("head")).select("entity"))


def step_plan(open_rows: DataFrame, settled_rows: DataFrame | None, fresh: DataFrame,
              max_rows: int | None = None) -> DataFrame:
    """Timeline changes caused by the fresh events (entity, rev_id, ts).

    In the usual case all fresh events of an entity come after its open interval begins, and that interval is
    the only one touched. Closed intervals are read only for entities with a late event; pass None for
    ``settled_rows`` where there is none.
    """
    cols = ["entity", "rev_id", "valid_from", "valid_to"]
    touched = fresh.select("entity").distinct()
    current = open_rows.select(*cols).join(touched, "entity", "left_semi")
    # an entity has one open row: without closed intervals only fresh events can make it hot
    hot = find_hot(fresh.select("entity", "ts", "rev_id"), ["entity"], ["ts", "rev_id"], max_rows) if settled_rows is None else "find"
    if settled_rows is not None:
        late = late_entities(open_rows, fresh)
        current = current.unionByName(settled_rows.select(*cols).join(late, "entity", "left_semi"))
    known = current.select("entity", "rev_id", F.col("valid_from").alias("ts"))
    return B.plan_changes(current, known.unionByName(fresh.select("entity", "rev_id", "ts")), max_rows, hot)


def _plan_counts() -> list[Column]:
    return [F.count_if(F.col("action") == a).alias(n) for a, n in
            (("trim", "trims"), ("delete", "deletes"), ("insert", "inserts"))]


def plan_metrics(plan: DataFrame) -> DataFrame:
    return plan.agg(*_plan_counts())


def run_metrics(events: DataFrame, stored: DataFrame, plan: DataFrame) -> DataFrame:
    """Counters of one step as a single row."""
    flagged = events.join(stored.select("rev_id", F.lit(True).alias("known")), "rev_id", "left")
    new = F.col("known").isNull()
    counts = flagged.agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(new).alias("inserted"), F.count_if(~new).alias("skipped"))
    parts = counts.unionByName(plan_metrics(plan), allowMissingColumns=True)
    total = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    # a fresh event without an interval was shadowed on arrival, a deleted interval by a fresh event
    return total.withColumn("shadowed", F.col("inserted") - F.col("inserts") + F.col("deletes"))


# ---- whole history in one pass -------------------------------------------------------------------

def step_of(ts: str, cutoffs: list[str]) -> Column:
    """1-based index of the first cut-off at or after ``ts``; null stays null."""
    steps = F.array(*[ntz(c) for c in cutoffs])
    return F.when(F.col(ts).isNotNull(), F.size(F.filter(steps, lambda c: c < F.col(ts))) + 1)


def backfill_beliefs(events: DataFrame, checkpoints: list[tuple[str, str]], max_rows: int | None = None) -> DataFrame:
    """All beliefs of a chronological sync, computed at once.

    ``checkpoints`` are (synced_through, completed_at). An interval is first believed at the step of its own
    start; if its successor came in a later step it was believed open-ended until then.
    """
    cutoffs = [c for c, _ in checkpoints]
    commits = F.array(*[ntz(s) for _, s in checkpoints])
    line = B.build_timeline(events.filter(F.col("ts") <= ntz(cutoffs[-1])), max_rows)
    line = line.withColumn("next", F.when(F.col("valid_to") < infinity(), F.col("valid_to")))
    line = line.withColumns({"s1": step_of("valid_from", cutoffs), "s2": step_of("next", cutoffs)})
    at1, at2 = F.element_at(commits, F.col("s1")), F.get(commits, F.col("s2") - 1)

    def belief(end: Column, since: Column, until: Column) -> Column:
        return F.struct(end.alias("valid_to"), since.alias("row_start"), until.alias("row_end"))

    later = F.col("s2") > F.col("s1")
    beliefs = F.when(later, F.array(belief(infinity(), at1, at2), belief(F.col("next"), at2, system_max()))) \
        .otherwise(F.array(belief(F.col("valid_to"), at1, system_max())))
    return line.select("entity", "rev_id", "valid_from", F.explode(beliefs).alias("b")) \
        .select("entity", "rev_id", "valid_from", "b.*")


# ---- against the store ---------------------------------------------------------------------------

def sync_step(store: Store, events: DataFrame, start, cutoff, completed_at, batch_id: int, run_id: int = 1,
              skip: DataFrame | None = None, whole_input: bool = False, entities: DataFrame | None = None,
              epoch: tuple[str, int] | None = None) -> dict:
    """One step for all entities as batch ``batch_id``; the commit row makes it visible.

    ``events`` may carry sha1 and text: a new event whose shown text does not fit its digest then fails the entity's step
    and nothing else; hidden and already stored events fail nothing. ``entities``: all that are to be synced; without it
    the events are read for them. ``whole_input`` takes the given events as they are (a micro-batch) instead of reading
    resume ranges, and leaves the synced ranges alone. ``epoch``: the stream and its micro-batch that the batch holds.
    """
    store.begin(batch_id)
    if epoch is not None:
        row = store.spark.range(1).coalesce(1).select(F.lit(epoch[0]).alias("stream"), F.lit(epoch[1]).cast("bigint").alias("epoch"))
        store.write("epochs", batch_id, row)
    state = store.state()
    read = events if whole_input else events_to_read(events, state, start, cutoff, entities)
    if "is_baseline" not in read.columns:
        read = read.withColumn("is_baseline", F.lit(False))
    if skip is not None:
        read = read.join(skip, "entity", "left_anti")
    # the input is read once: everything below starts from this table
    read = materialise(read, "sync-read")
    span = read.agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("a"),
                    F.max("ts").cast("string").alias("b")).first()
    stored = store.events("rev_id BIGINT, ts TIMESTAMP_NTZ")
    # only stored events inside the span being read can be known already: the bounds reach the scan
    fresh = read if stored is None or not span["n"] else R.new_events(
        read, stored.filter(F.col("ts").between(ntz(span["a"]), ntz(span["b"]))))
    failed = None
    if {"sha1", "text"} <= set(read.columns):
        shown = fresh.filter(~F.coalesce("content_hidden", F.lit(False))) if "content_hidden" in fresh.columns else fresh
        # written once, so that no later reader of the batch has to hash the texts again
        bad = digest_mismatches(shown).groupBy("entity").agg(F.concat(F.lit("digest mismatch, revision "), F.min("rev_id").cast("string")).alias("reason"))
        failed = store.write("failed", batch_id, bad)
        seen = read.join(failed, "entity", "left_anti").count()
        fresh = fresh.join(failed, "entity", "left_anti")
    else:
        seen = span["n"]
    has_text = "text" in fresh.columns
    if has_text and "sha1" in fresh.columns and "content_status" not in fresh.columns:
        hidden = F.coalesce(F.col("content_hidden"), F.lit(False)) if "content_hidden" in fresh.columns else F.lit(False)
        available = F.col("text").isNotNull() & F.col("sha1").isNotNull() & ~hidden
        fresh = fresh.withColumn("content_status", F.when(available, "available").otherwise("hidden"))
    fresh_events = store.write("events", batch_id, fresh.drop("text").sortWithinPartitions("ts"))
    counters = {"seen": seen}
    if has_text:
        carriers = fresh.filter(F.col("sha1").isNotNull() & F.col("text").isNotNull())
        if "content_hidden" in fresh.columns:
            carriers = carriers.filter(~F.col("content_hidden"))
        old = store.texts("sha1 STRING")
        if old is not None:
            carriers = carriers.join(old.select("sha1"), "sha1", "left_anti")
        # with its first carrier, as packs and look-ups of the store want it
        added = store.write("texts", batch_id, distinct_texts(carriers))
        t = added.agg(F.count(F.lit(1)).alias("n"), F.sum("byte_length").alias("b")).first()
        counters |= {"texts": t["n"], "raw_bytes": t["b"]}

    # without a late event the closed intervals, nearly all of the timeline, are not read at all
    fresh_keys = fresh_events.select("entity", "rev_id", "ts")
    settled = None if late_entities(store.open_rows(), fresh_keys).isEmpty() else store.settled_rows()
    # the plan feeds the writes and the counters: computed once, kept in the shared folder
    plan = store.write("plans", batch_id, step_plan(store.open_rows(), settled, fresh_keys))
    ends = F.col("action").isin("trim", "delete")
    m = plan.agg(*_plan_counts(), F.count_if(ends & (F.col("old_to") < infinity())).alias("unsettled"),
                 F.count_if(F.col("action") == "refused").alias("refused")).first()
    if m["refused"]:
        B.assert_plan_allowed(plan)
    done = (entities if entities is not None else events).select("entity").distinct()
    for out in (skip, failed):
        if out is not None:
            done = done.join(out, "entity", "left_anti")
    if whole_input:
        done = done.limit(0)
    synced = done.select("entity", ntz(start).alias("synced_from"), ntz(cutoff).alias("synced_through"))
    # independent folders: written side by side, so that one's stragglers do not hold up the others
    with ThreadPoolExecutor(4) as pool:
        writes = [pool.submit(w) for w in _writes(store, plan, batch_id, completed_at, settled if m["unsettled"] else None)]
        new_state = store.write("state", batch_id, state_upsert(state, synced, batch_id))
        for w in writes:
            w.result()

    inserted = fresh_events.count()
    counters |= {"inserted": inserted, "skipped": counters["seen"] - inserted,
                 "trims": m["trims"], "deletes": m["deletes"], "inserts": m["inserts"], "unsettled": m["unsettled"],
                 "shadowed": inserted - m["inserts"] + m["deletes"],
                 "entities_total": fresh_keys.select("entity").distinct().count() if whole_input
                 else new_state.filter(F.col("last_batch") == batch_id).count(),
                 "entities_failed": failed.count() if failed is not None else 0}
    store.commit(batch_id, cutoff, completed_at, run_id, **counters)
    return counters | {"failed": failed}


def _writes(store: Store, plan: DataFrame, batch_id: int, at, settled: DataFrame | None) -> list[Callable]:
    """Writers of what the plan changes: superseded beliefs, closed intervals, and the open rows it began.

    ``settled`` is given only where the plan takes closed intervals back.
    """
    cols = ["entity", "rev_id", "valid_from", "valid_to"]
    before = plan.filter(F.col("action").isin("trim", "delete")).select(
        "entity", "rev_id", F.col("old_from").alias("valid_from"), F.col("old_to").alias("valid_to"))
    after = plan.filter(F.col("action").isin("trim", "insert")).select(
        "entity", "rev_id", F.col("new_from").alias("valid_from"), F.col("new_to").alias("valid_to"))
    open_rows = store.open_rows()
    was_open = before.filter(F.col("valid_to") == infinity()).select("entity", "rev_id")
    gone = open_rows.join(was_open, ["entity", "rev_id"], "left_semi")
    if settled is not None:
        was_settled = before.filter(F.col("valid_to") < infinity())
        taken_back = store.write("unsettled", batch_id, settled.join(was_settled.select(*cols), cols, "left_semi"))
        gone = gone.unionByName(taken_back)
    # beliefs formed at this very instant were never visible
    gone = gone.filter(F.col("row_start") < ntz(at))
    closed = opened(after.filter(F.col("valid_to") < infinity()), at)
    now_open = opened(after.filter(F.col("valid_to") == infinity()), at)
    into = "open"
    if store.is_snapshot(batch_id):
        still_open = open_rows.join(was_open, ["entity", "rev_id"], "left_anti")
        into, now_open = "open_all", still_open.unionByName(now_open)
    return [lambda: store.write_history(batch_id, at, gone.withColumn("row_end", ntz(at))),
            lambda: store.write("settled", batch_id, closed),
            lambda: store.write(into, batch_id, now_open)]


def run_sync(store: Store, events: DataFrame, start, checkpoints: list[tuple[str, str]], run_id: int = 1) -> str:
    """Ordered steps, each committed before the next. The loop is over steps; all entities go in parallel. The run log says
    running from the start, and failed if a step raises."""
    if checkpoints and not str(start) < str(checkpoints[-1][0]):
        raise ValueError(f"run window {start} .. {checkpoints[-1][0]} is empty")
    end = checkpoints[-1][0] if checkpoints else start
    store.log_run(run_id, start, end, "running", None)
    try:
        status, failed = _steps(store, events, start, checkpoints, run_id)
    except Exception:
        store.log_run(run_id, start, end, "failed", None)
        raise
    store.log_run(run_id, start, end, status, failed)
    return status


def _steps(store: Store, events: DataFrame, start, checkpoints: list[tuple[str, str]], run_id: int) -> tuple[str, DataFrame | None]:
    failed: DataFrame | None = None
    n_failed = 0
    total = 0
    entities = materialise(events.select("entity").distinct(), "sync-entities")   # read once for all steps
    for cutoff, completed_at in checkpoints:
        c = sync_step(store, events, start, cutoff, completed_at, store.last_batch() + 1, run_id, failed, entities=entities)
        total = max(total, c["entities_total"] + c["entities_failed"])
        n_failed += c["entities_failed"]
        if c["entities_failed"]:   # a failed entity would only fail again in the later steps of this run
            failed = c["failed"] if failed is None else failed.unionByName(c["failed"])
    return run_status(total, n_failed), failed


def checkpoint_report(store: Store) -> DataFrame:
    """Commit log in order, with the knowledge horizon each checkpoint reached."""
    return (store.commits().select("batch_id", "run_id", "synced_through", "completed_at",
                                   F.col("entities_total").alias("entities_synced")).orderBy("batch_id"))
