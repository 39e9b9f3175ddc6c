"""Application time: questions asked of a timeline or straight of the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock.operators.slices import Scan
from twinclock.operators.timelines import interval_at
from twinclock.schema import PAGE_SIZE, infinity, ntz, null_if_open


def revision_at(timeline: DataFrame, events: DataFrame, t, entity=None) -> DataFrame:
    """The revision valid at ``t`` with its event attributes, for one entity or for all."""
    rows = interval_at(timeline, t)
    if entity is not None:
        rows = rows.filter(F.col("entity") == F.lit(entity))
        events = events.filter(F.col("entity") == F.lit(entity))
    return rows.join(events, ["entity", "rev_id"])


def snapshot(timeline: DataFrame, t) -> DataFrame:
    """State of every entity at ``t``: a filter, no join."""
    return interval_at(timeline, t)


def snapshot_of_events(events: DataFrame, t, *attributes: str) -> DataFrame:
    """Same answer as ``snapshot(build_timeline(events), t)`` in one aggregation.

    Without a window nothing is sorted across tasks and partial aggregation meets a hot entity on the map
    side, so this is the form for a single instant over a large event table.
    """
    before = F.when(F.col("ts") <= ntz(t), F.struct("ts", "rev_id", *attributes))
    after = F.when(F.col("ts") > ntz(t), F.col("ts"))
    rows = events.groupBy("entity").agg(F.max(before).alias("now"), F.min(after).alias("valid_to"))
    return (rows.filter(F.col("now").isNotNull())
            .select("entity", "now.rev_id", F.col("now.ts").alias("valid_from"),
                    F.coalesce("valid_to", infinity()).alias("valid_to"),
                    *[F.col(f"now.{a}").alias(a) for a in attributes]))


def revisions_at(timeline: DataFrame, probes: DataFrame, strategy: str = "carry",
                 max_rows: int | None = None) -> DataFrame:
    """Answer many (entity, t) probes at once; unanswered probes keep nulls.

    ``carry``  probes and intervals of an entity are sorted together and the last interval is carried to the
               probes after it: one shuffle, linear work, hot entities cut into slices.
    ``join``   equi join on the entity with the interval test as residual, at any size; whether one side is broadcast
               is left to the optimiser. Work grows as probes x intervals of an entity.
    ``bucket`` each interval is repeated for the months it covers, as far as there are probes, and joined on (entity, month).
               A giant entity falls into as many keys as months; a probe meets the intervals of its month only.
    """
    if strategy == "carry":
        return _carry(timeline, probes, max_rows)
    if strategy == "bucket":
        return _by_month(timeline, probes)
    if strategy != "join":
        raise ValueError("strategy is carry, join or bucket")
    rows = timeline.select("entity", "rev_id", "valid_from", "valid_to")
    wanted = probes.select("probe_id", "entity", "t")
    found = (rows.join(wanted, "entity")
             .filter((F.col("valid_from") <= F.col("t")) & (F.col("t") < F.col("valid_to")))
             .select("probe_id", "rev_id", "valid_from", "valid_to"))
    return wanted.join(found, "probe_id", "left")


def _by_month(timeline: DataFrame, probes: DataFrame) -> DataFrame:
    def month(at: Column) -> Column:
        return F.year(at) * 12 + F.month(at)

    wanted = probes.select("probe_id", "entity", "t")
    span = wanted.agg(F.min(month(F.col("t"))).alias("lo"), F.max(month(F.col("t"))).alias("hi")).first()
    if span["lo"] is None:
        lo, hi = 1, 0
    else:
        lo, hi = span["lo"], span["hi"]
    first = F.greatest(month(F.col("valid_from")), F.lit(lo))
    # half-open: an interval that ends at a month's first instant does not reach into it
    last = F.least(month(F.col("valid_to") - F.expr("interval 1 microsecond")), F.lit(hi))
    rows = (timeline.filter((first <= last) & (F.col("valid_from") < F.col("valid_to")))
            .select("entity", "rev_id", "valid_from", "valid_to", F.explode(F.sequence(first, last)).alias("month")))
    found = (wanted.withColumn("month", month(F.col("t"))).join(rows, ["entity", "month"])
             .filter((F.col("valid_from") <= F.col("t")) & (F.col("t") < F.col("valid_to")))
             .select("probe_id", "rev_id", "valid_from", "valid_to"))
    return wanted.join(found, "probe_id", "left")


def latest_before(events: DataFrame, probes: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Last event with ts <= t per probe, without intervals; highest rev_id wins a tie."""
    rows = events.select("entity", "rev_id", F.col("ts").alias("valid_from"), infinity().alias("valid_to"))
    return _carry(rows, probes, max_rows).drop("valid_to")


def _carry(rows: DataFrame, probes: DataFrame, max_rows: int | None) -> DataFrame:
    return answers_of({"found": rows}, probes, max_rows).select("probe_id", "entity", "t", "found.*")


def answers_of(timelines: dict[str, DataFrame], probes: DataFrame, max_rows: int | None = None, events: DataFrame | None = None) -> DataFrame:
    """Answers of several timelines to the same probes in one scan.

    One struct column (rev_id, valid_from, valid_to) per name, null where nothing was valid; with ``events`` also ``n``,
    the number of events with ts <= t. The probes are shuffled once, however many timelines are asked, and the order
    (instant, interval before probe, id) is total, so a hot instant is cut like any other run of rows.
    """
    known = "struct<rev_id:bigint,valid_from:timestamp_ntz,valid_to:timestamp_ntz>"
    wanted = probes.select(F.col("probe_id").cast("bigint"), "entity", "t")

    def rows(df, at, is_probe, tie, probe, c, **found):
        return df.select("entity", F.col(at).alias("at"), F.lit(is_probe).alias("is_probe"), tie.cast("bigint").alias("tie"), probe.cast("bigint").alias("probe_id"),
                         c.cast("bigint").alias("c"), *[found.get(n, F.lit(None)).cast(known).alias(n) for n in timelines])

    none = F.lit(None)
    # at equal instants an interval start sorts before a probe: intervals are closed on the left
    both = rows(wanted, "t", True, F.col("probe_id"), F.col("probe_id"), F.lit(0))
    for name, line in timelines.items():
        both = both.unionByName(rows(line, "valid_from", False, F.col("rev_id"), none, F.lit(0), **{name: F.struct("rev_id", "valid_from", "valid_to")}))
    if events is not None:
        per_instant = events.groupBy("entity", "ts").agg(F.count(F.lit(1)).alias("events"))
        both = both.unionByName(rows(per_instant, "ts", False, none, none, F.col("events")))
    scan = Scan(both, "entity", ["at", "is_probe", "tie"], max_rows)
    for name in timelines:
        scan.last_known(name, f"last_{name}")
    if events is not None:
        scan.running_sum("c", "n")
    return scan.result().filter("is_probe").select("probe_id", "entity", F.col("at").alias("t"), *(["n"] if events is not None else []), *[
        F.when(F.col("at") < F.col(f"last_{n}.valid_to"), F.col(f"last_{n}")).alias(n) for n in timelines])


def overlapping(timeline: DataFrame, start, end) -> DataFrame:
    """Intervals touching [start, end]; the upper bound counts, as in a closed range."""
    return timeline.filter((F.col("valid_from") <= ntz(end)) & (F.col("valid_to") > ntz(start)))


def overlapping_count(timeline: DataFrame, start, end) -> DataFrame:
    return overlapping(timeline, start, end).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def history_page(timeline: DataFrame, start, end, page: int = 1, size: int = PAGE_SIZE,
                 max_rows: int | None = None) -> DataFrame:
    """Page of every entity's overlapping intervals, newest first, with its position and the entity's total."""
    if page < 1:
        raise ValueError("page must be 1 or more")
    # counted from both ends in one scan, so neither totals nor a join on the entity are needed
    scan = (Scan(overlapping(timeline, start, end), "entity", ["valid_from", "rev_id"], max_rows)
            .running_sum(F.lit(1), "nth").running_sum(F.lit(1), "left", backward=True))
    first = (page - 1) * size
    numbered = scan.result().withColumns({"total": F.col("nth") + F.col("left") - 1, "position": F.col("left") - 1})
    return numbered.filter((F.col("position") >= first) & (F.col("position") < first + size)).drop("nth", "left")


def edits_between(events: DataFrame, start, end) -> DataFrame:
    """Events in (start, end] per entity; shadowed ones count."""
    return (events.filter((F.col("ts") > ntz(start)) & (F.col("ts") <= ntz(end)))
            .groupBy("entity").agg(F.count(F.lit(1)).alias("edits")))


def month_of(ts) -> Column:
    return F.date_format(F.to_date(ts), "yyyy-MM")


def edits_per_month(events: DataFrame, start, end) -> DataFrame:
    return (events.filter((F.col("ts") >= ntz(start)) & (F.col("ts") <= ntz(end)))
            .groupBy("entity", month_of("ts").alias("month")).agg(F.count(F.lit(1)).alias("edits")))


def month_series(events: DataFrame, start, end) -> DataFrame:
    """Edits of all entities per month of the coverage, empty months as zero.

    ``last_second`` is the last second of the month, clipped to the coverage end.
    """
    first = F.trunc(F.to_date(ntz(start)), "month")
    months = (events.sparkSession.range(1)
              .select(F.explode(F.sequence(first, F.to_date(ntz(end)), F.expr("interval 1 month"))).alias("m"))
              .select(month_of("m").alias("month"),
                      F.least(F.add_months("m", 1).cast("timestamp_ntz") - F.expr("interval 1 second"), ntz(end))
                      .alias("last_second")))
    counts = (events.filter((F.col("ts") >= ntz(start)) & (F.col("ts") <= ntz(end)))
              .groupBy(month_of("ts").alias("month")).agg(F.count(F.lit(1)).alias("edits")))
    # one row per month of the coverage on both sides
    return months.join(counts, "month", "left").withColumn("edits", F.coalesce("edits", F.lit(0)))


def timeline_bounds(timeline: DataFrame, events: DataFrame) -> DataFrame:
    spans = timeline.groupBy("entity").agg(F.min("valid_from").alias("first_from"), F.count(F.lit(1)).alias("intervals"))
    counts = events.groupBy("entity").agg(F.count(F.lit(1)).alias("revisions"))
    return spans.join(counts, "entity", "full_outer")


def neighbours(timeline: DataFrame, start, end, max_rows: int | None = None) -> DataFrame:
    """Previous and next revision of each interval, as far as they lie inside the coverage.

    Previous is the state one second before the interval, next the state at its end.
    """
    scan = (Scan(timeline.select("entity", "rev_id", "valid_from", "valid_to"), "entity", ["valid_from", "rev_id"], max_rows)
            .lag("rev_id", "before").lag("valid_to", "before_to").lead("rev_id", "after").lead("valid_from", "after_from"))
    second = F.expr("interval 1 second")
    return scan.result().select(
        "entity", "rev_id", "valid_from", "valid_to",
        F.when((F.col("valid_from") - second >= ntz(start)) & (F.col("before_to") >= F.col("valid_from")),
               F.col("before")).alias("previous_rev"),
        F.when((F.col("valid_to") < infinity()) & (F.col("valid_to") <= ntz(end))
               & (F.col("after_from") == F.col("valid_to")), F.col("after")).alias("next_rev"))


def with_creation(answers: DataFrame, bounds: DataFrame) -> DataFrame:
    """Probes before an entity's first event get ``not_yet_created`` and the instant it appeared."""
    first = bounds.select("entity", "first_from")
    return (answers.join(first, "entity", "left")
            .withColumn("not_yet_created", F.col("rev_id").isNull() & F.col("first_from").isNotNull())
            .withColumn("first_from", F.when(F.col("not_yet_created"), F.col("first_from"))))


def live_in_year(timeline: DataFrame, t) -> DataFrame:
    """Intervals live at some point of the calendar year of ``t``."""
    first = F.trunc(F.to_date(ntz(t)), "year").cast("timestamp_ntz")
    last = F.add_months(F.trunc(F.to_date(ntz(t)), "year"), 12).cast("timestamp_ntz") - F.expr("interval 1 second")
    return overlapping(timeline, first, last)


def totals_at(events: DataFrame, t, size: str = "size_bytes") -> DataFrame:
    """Number of entities and the sum of their sizes as of ``t``."""
    return snapshot_of_events(events, t, size).agg(
        F.count(F.lit(1)).alias("entities"), F.sum(size).alias("bytes"))


def iso(ts) -> Column:
    """ISO 8601 text in UTC; microseconds only where present, an open end is null."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(ts < infinity(), F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z")))


def decorated(timeline: DataFrame, link_prefix: str) -> DataFrame:
    return timeline.withColumns({
        "open_ended": F.col("valid_to") == infinity(),
        "valid_from_iso": iso("valid_from"),
        "valid_to_iso": iso("valid_to"),
        "valid_to": null_if_open("valid_to"),
        "permalink": F.concat(F.lit(link_prefix), F.col("rev_id").cast("string")),
    })


def compare(timeline: DataFrame, events: DataFrame, pairs: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Two instants per pair (pair_id, entity, a, b): both states and the number of edits in between.

    Instants given in the wrong order are swapped and flagged. The edits in (a, b] are the difference of two
    running event counts, taken in the scan that finds the states, so no pair meets all events of its entity.
    ``status`` is NO_REVISION where one of the instants has none; ``same_revision`` is null there.
    """
    pairs = pairs.select(F.col("pair_id").cast("bigint"), "entity", F.least("a", "b").alias("a"),
                         F.greatest("a", "b").alias("b"), (F.col("b") < F.col("a")).alias("swapped"))
    ends = pairs.select("entity", F.explode(F.array(
        F.struct((F.col("pair_id") * 2).alias("probe_id"), F.col("a").alias("t")),
        F.struct((F.col("pair_id") * 2 + 1).alias("probe_id"), F.col("b").alias("t")))).alias("p")) \
        .select("p.probe_id", "entity", "p.t")
    sides = answers_of({"found": timeline}, ends, max_rows, events)

    def side(k, column):
        return F.max(F.when(F.col("probe_id") % 2 == k, F.col(column)))

    both = sides.groupBy(F.floor(F.col("probe_id") / 2).alias("pair_id")).agg(
        side(0, "found.rev_id").alias("rev_a"), side(1, "found.rev_id").alias("rev_b"), side(0, "n").alias("n_a"), side(1, "n").alias("n_b"))
    known = F.col("rev_a").isNotNull() & F.col("rev_b").isNotNull()
    return (pairs.join(both, "pair_id")
            .select("pair_id", "entity", "a", "b", "swapped", "rev_a", "rev_b",
                    F.when(known, F.col("rev_a") == F.col("rev_b")).alias("same_revision"),
                    F.when(~known, "NO_REVISION").when(F.col("rev_a") == F.col("rev_b"), "SAME_REVISION").otherwise("OK").alias("status"),
                    (F.col("n_b") - F.col("n_a")).alias("edits_between")))


def events_until(events: DataFrame, probes: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Number of events with ts <= t per probe."""
    return answers_of({}, probes, max_rows, events).select("probe_id", "n")


def revision_density(events: DataFrame) -> DataFrame:
    return events.groupBy("entity").agg(F.count(F.lit(1)).alias("revisions"), F.sum("size_bytes").alias("bytes"))
