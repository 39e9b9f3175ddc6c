"""Application time: building, checking and changing validity timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock.operators.slices import Scan
from twinclock.schema import TIMELINE, infinity, ntz, system_max


def _next_event(events: DataFrame, max_rows: int | None, hot) -> DataFrame:
    """(entity, rev_id, ts, next_ts) in (ts, rev_id) order; only the three key columns are shuffled."""
    return Scan(events.select("entity", "rev_id", "ts"), "entity", ["ts", "rev_id"], max_rows, hot).lead("ts", "next_ts").result()


def build_timeline(events: DataFrame, max_rows: int | None = None, hot="find") -> DataFrame:
    """A at T1, B at T2, C at T3 become A [T1,T2), B [T2,T3), C [T3,inf).

    ``hot`` takes the result of ``slices.find_hot`` where the caller has it already.

    One window does both jobs: in (ts, rev_id) order the next row of a shadowed event has the same ts, and
    the next row of a visible event starts the next interval.
    """
    return (_next_event(events, max_rows, hot).filter(F.col("next_ts").isNull() | (F.col("next_ts") > F.col("ts")))
            .select("entity", "rev_id", F.col("ts").alias("valid_from"),
                    F.coalesce("next_ts", infinity()).alias("valid_to")))


def shadowed(events: DataFrame, max_rows: int | None = None, hot="find") -> DataFrame:
    """Events replaced by a higher rev_id of the same entity in the same second."""
    return _next_event(events, max_rows, hot).filter(F.col("next_ts") == F.col("ts")).drop("next_ts")


def plan_changes(current: DataFrame, events: DataFrame, max_rows: int | None = None, hot="find") -> DataFrame:
    """Compare the stored timeline with the one the events imply, one row per revision.

    ``action`` is keep, insert, trim, delete, or refused where an interval would move or grow. The join key
    is (entity, rev_id), unique on both sides, so a hot entity spreads over all tasks.
    """
    target = build_timeline(events, max_rows, hot)
    old = current.select("entity", "rev_id", F.col("valid_from").alias("old_from"), F.col("valid_to").alias("old_to"))
    new = target.select("entity", "rev_id", F.col("valid_from").alias("new_from"), F.col("valid_to").alias("new_to"))
    action = (
        F.when(F.col("old_from").isNull(), "insert")
        .when(F.col("new_from").isNull(), "delete")
        .when((F.col("old_from") != F.col("new_from")) | (F.col("new_to") > F.col("old_to")), "refused")
        .when(F.col("new_to") < F.col("old_to"), "trim")
        .otherwise("keep"))
    return old.join(new, ["entity", "rev_id"], "full_outer").withColumn("action", action)


def refused_changes(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("action") == "refused")


def assert_plan_allowed(plan: DataFrame) -> None:
    """Raise before any write when an interval would move or grow."""
    bad = refused_changes(plan).limit(1).collect()
    if bad:
        r = bad[0]
        raise ValueError(
            f"timeline of entity {r['entity']}: revision {r['rev_id']} would change from "
            f"[{r['old_from']}, {r['old_to']}) to [{r['new_from']}, {r['new_to']})")


def new_beliefs(plan: DataFrame, at) -> DataFrame:
    """Row versions that start at system time ``at``."""
    return (plan.filter(F.col("action").isin("insert", "trim"))
            .select("entity", "rev_id", F.col("new_from").alias("valid_from"), F.col("new_to").alias("valid_to"),
                    ntz(at).alias("row_start"), system_max().alias("row_end")))


def apply_plan(versions: DataFrame, plan: DataFrame, at) -> DataFrame:
    """All row versions after the plan: changed rows end at ``at`` and stay as history."""
    changed = plan.filter(F.col("action").isin("trim", "delete")).select(
        "entity", "rev_id", F.col("old_from").alias("valid_from"), F.lit(True).alias("ends"))
    closed = (versions.join(changed, ["entity", "rev_id", "valid_from"], "left")
              .withColumn("row_end", F.when(F.col("ends") & (F.col("row_end") == system_max()), ntz(at))
                          .otherwise(F.col("row_end"))).drop("ends"))
    # a belief formed and given up at one instant was never visible
    closed = closed.filter(F.col("row_start") < F.col("row_end"))
    return closed.unionByName(new_beliefs(plan, at))


def delete_for_portion(df: DataFrame, start, end, condition: Column | None = None,
                       period=("valid_from", "valid_to")) -> DataFrame:
    """Remove [start, end) from matching intervals; each leaves zero, one or two remnants."""
    return _portion(df, start, end, condition, period, {}, keep_middle=False)


def update_for_portion(df: DataFrame, start, end, changes: dict[str, Column], condition: Column | None = None,
                       period=("valid_from", "valid_to")) -> DataFrame:
    """Set columns inside [start, end) only, splitting an interval into up to three."""
    return _portion(df, start, end, condition, period, changes, keep_middle=True)


def _portion(df, start, end, condition, period, changes, keep_middle):
    lo, hi = period
    kind = df.schema[lo].dataType
    start, end = (x if isinstance(x, Column) else F.lit(str(x)).cast(kind) for x in (start, end))
    hit = (F.col(lo) < end) & (F.col(hi) > start)
    if condition is not None:
        hit = hit & condition

    def piece(a, b, middle=False):
        return F.struct(a.alias("a"), b.alias("b"), F.lit(middle).alias("m"))

    pieces = [piece(F.col(lo), F.least(F.col(hi), start)), piece(F.greatest(F.col(lo), end), F.col(hi))]
    if keep_middle:
        pieces.insert(1, piece(F.greatest(F.col(lo), start), F.least(F.col(hi), end), True))
    # an interval is either kept whole or replaced by its non-empty pieces
    parts = F.when(F.coalesce(hit, F.lit(False)), F.filter(F.array(*pieces), lambda p: p["a"] < p["b"])) \
        .otherwise(F.array(piece(F.col(lo), F.col(hi))))
    out = df.withColumn("__p", F.explode(parts))
    values = []
    for c in df.columns:
        if c == lo:
            values.append(F.col("__p.a").alias(c))
        elif c == hi:
            values.append(F.col("__p.b").alias(c))
        elif c in changes:
            values.append(F.when(F.col("__p.m"), changes[c]).otherwise(F.col(c)).alias(c))
        else:
            values.append(F.col(c))
    return out.select(*values)


def interval_at(timeline: DataFrame, t) -> DataFrame:
    return timeline.filter((F.col("valid_from") <= ntz(t)) & (ntz(t) < F.col("valid_to")))


def with_next_interval(timeline: DataFrame, max_rows: int | None = None, hot="find") -> DataFrame:
    """Timeline rows with ``next_from``, the start of the entity's next interval."""
    return (Scan(timeline.select(*TIMELINE), "entity", ["valid_from", "rev_id"], max_rows, hot)
            .lead("valid_from", "next_from").result())


def timeline_problems(timeline: DataFrame, max_rows: int | None = None, hot="find") -> DataFrame:
    """One row per problem: empty, overlap (with the next interval) or gap (before it)."""
    nxt = F.col("next_from")
    problems = F.array_compact(F.array(
        F.when(F.col("valid_from") >= F.col("valid_to"), "empty"),
        F.when(F.col("valid_to") > nxt, "overlap"),
        F.when(F.col("valid_to") < nxt, "gap")))
    return (with_next_interval(timeline, max_rows, hot)
            .select("entity", "rev_id", F.explode(problems).alias("problem")))


def overlapping_rows(timeline: DataFrame, max_rows: int | None = None, hot="find") -> DataFrame:
    """Rows that start before some earlier interval of the entity has ended; touching is allowed."""
    return (Scan(timeline.select(*TIMELINE), "entity", ["valid_from", "rev_id"], max_rows, hot)
            .max_before("valid_to", "covered_to").result()
            .filter(F.col("covered_to") > F.col("valid_from")))


def empty_rows(timeline: DataFrame) -> DataFrame:
    return timeline.filter(F.col("valid_from") >= F.col("valid_to"))
