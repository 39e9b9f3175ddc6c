"""System time: row versions with [row_start, row_end), and both clocks together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock.operators.lookups import answers_of, revisions_at
from twinclock.operators.slices import Scan, find_hot
from twinclock.operators.timelines import interval_at
from twinclock.schema import infinity, ntz, system_max
from twinclock.session import materialise


def scd2_from_log(log: DataFrame, tracked: list[str] | None = None, keep_noops: bool = True,
                  max_rows: int | None = None, hot="find") -> DataFrame:
    """Row versions of a one-row-per-entity table from its ordered change log (entity, rev_id, ts, ...).

    Of several changes at one instant the last is kept. With ``keep_noops=False`` a change that leaves the
    tracked columns as they were makes no version.
    """
    extra = [c for c in log.columns if c not in ("entity", "rev_id", "ts")]
    scan = Scan(log, "entity", ["ts", "rev_id"], max_rows, hot).lead("ts", "next_ts")
    scan.map(lambda df: df.filter(F.col("next_ts").isNull() | (F.col("next_ts") > F.col("ts"))))
    if not keep_noops:
        scan.map(lambda df: df.withColumn("image", F.struct(*(tracked or extra)))).lag("image", "before")
        scan.map(lambda df: df.filter(F.col("before").isNull() | ~F.col("before").eqNullSafe(F.col("image")))
                 .drop("next_ts", "before", "image")).lead("ts", "next_ts")
    return scan.result().select(
        "entity", "rev_id", *extra, F.col("ts").alias("row_start"),
        F.coalesce("next_ts", system_max()).alias("row_end"))


def scd2_with_deletes(log: DataFrame, max_rows: int | None = None) -> DataFrame:
    """As ``scd2_from_log`` with a column ``op`` that is D for a delete.

    A delete closes the version; one at the instant of the change it deletes leaves a version of length zero.
    """
    extra = [c for c in log.columns if c not in ("entity", "rev_id", "ts", "op")]
    image = F.struct("rev_id", *extra)
    instants = log.groupBy("entity", "ts").agg(
        F.max_by(image, F.when(F.col("op") != "D", F.col("rev_id"))).alias("image"),
        F.max_by("op", "rev_id").alias("last_op"))
    rows = Scan(instants, "entity", ["ts"], max_rows).lead("ts", "next_ts").result()
    return (rows.filter(F.col("image").isNotNull())
            .select("entity", "image.*", F.col("ts").alias("row_start"),
                    F.when(F.col("last_op") == "D", F.col("ts"))
                    .otherwise(F.coalesce("next_ts", system_max())).alias("row_end")))


def versions_per_commit(log: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One version per (entity, commit_id) however many statements it had; null end means current."""
    extra = [c for c in log.columns if c not in ("entity", "rev_id", "commit_id")]
    commits = (log.groupBy("entity", "commit_id").agg(F.max_by(F.struct("rev_id", *extra), "rev_id").alias("r"))
               .select("entity", "commit_id", "r.*"))
    return (Scan(commits, "entity", ["commit_id"], max_rows).lead("commit_id", "commit_end").result()
            .withColumnRenamed("commit_id", "commit_start"))


def as_of_commit(versions: DataFrame, commit_id: int) -> DataFrame:
    return versions.filter((F.col("commit_start") <= commit_id)
                           & (F.col("commit_end").isNull() | (F.col("commit_end") > commit_id)))


def scd2_tracking(log: DataFrame, tracked: list[str], untracked: list[str], max_rows: int | None = None) -> DataFrame:
    """Versions open on a change of ``tracked`` only; ``untracked`` keep the last value they held inside."""
    rows = log.select("entity", "rev_id", "ts", *tracked, *untracked, F.struct(*tracked).alias("image"))
    hot = find_hot(rows, ["entity"], ["ts", "rev_id"], max_rows)
    scan = Scan(rows, "entity", ["ts", "rev_id"], hot=hot).lag("image", "before")
    opens = F.col("before").isNull() | ~F.col("before").eqNullSafe(F.col("image"))
    scan.map(lambda df: df.withColumn("opens", opens.cast("int"))).running_sum("opens", "version")
    groups = scan.result().groupBy("entity", "version").agg(
        F.min(F.struct("ts", "rev_id")).alias("first"),
        F.max_by(F.struct(*tracked, *untracked), F.struct("ts", "rev_id")).alias("last"))
    flat = groups.select("entity", F.col("first.rev_id").alias("rev_id"), F.col("first.ts").alias("ts"), "last.*")
    # several tracked changes at one instant leave the last of them; with a hot key the versions are read three times
    return scd2_from_log(flat if hot is None else materialise(flat, "tracking"), hot=hot)


def start_versioning(table: DataFrame, at) -> DataFrame:
    return table.withColumns({"row_start": ntz(at), "row_end": system_max()})


def stop_versioning(versions: DataFrame) -> DataFrame:
    return current(versions).drop("row_start", "row_end")


def current(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("row_end") == system_max())


def superseded(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("row_end") < system_max())


def as_of(versions: DataFrame, s) -> DataFrame:
    """Rows current at system time ``s``: row_start <= s < row_end."""
    return versions.filter((F.col("row_start") <= ntz(s)) & (F.col("row_end") > ntz(s)))


def between(versions: DataFrame, a, b) -> DataFrame:
    """Rows current at some moment of [a, b], the upper bound included."""
    return versions.filter((F.col("row_start") <= ntz(b)) & (F.col("row_end") > ntz(a)))


def from_to(versions: DataFrame, a, b) -> DataFrame:
    """Rows current at some moment of [a, b), the upper bound excluded."""
    return versions.filter((F.col("row_start") < ntz(b)) & (F.col("row_end") > ntz(a)))


def trail(versions: DataFrame, what: str = "rev_id", separator: str = " ") -> DataFrame:
    """Per entity its versions as one text, in the order they came: ``what`` of each, joined by ``separator``.

    Nulls of ``what`` are left out of the text but counted. The text of an entity is one value, so cut the versions to a
    range first (``between``, ``from_to``) where an entity has a long history."""
    between = separator.replace("\\", "\\\\").replace("'", "\\'")
    # the DataFrame function has no order, the SQL one has
    text = F.expr(f"listagg(CAST(`{what}` AS STRING), '{between}') WITHIN GROUP (ORDER BY row_start, rev_id)")
    return versions.groupBy("entity").agg(text.alias("revisions" if what == "rev_id" else what), F.count(F.lit(1)).alias("versions"))


def all_versions(versions: DataFrame) -> DataFrame:
    return versions.withColumn("is_current", F.col("row_end") == system_max())


def believed_at(versions: DataFrame, s, t) -> DataFrame:
    """What the store believed at ``s`` about ``t``."""
    return interval_at(as_of(versions, s), t)


def known_then_and_now(versions: DataFrame, probes: DataFrame, s, max_rows: int | None = None) -> DataFrame:
    """Per probe the answer believed at ``s``, today's answer, and whether they agree."""
    both = answers_of({"then": as_of(versions, s), "now": current(versions)}, probes, max_rows)
    return (both.select("probe_id", "entity", "t", F.col("then.rev_id").alias("then_rev"), F.col("now.rev_id").alias("now_rev"))
            .withColumn("agrees", F.col("then_rev").eqNullSafe(F.col("now_rev"))))


def history_growth(versions: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Closed versions and their bytes per year of row_end."""
    return (superseded(versions).groupBy(F.year("row_end").alias("year_closed"))
            .agg(F.count(F.lit(1)).alias("row_versions"), F.sum(size).alias("bytes")))


def audit_trail(versions: DataFrame, condition: Column) -> DataFrame:
    return versions.filter(condition).orderBy("row_start")


def mirror_intervals(mirror: DataFrame) -> DataFrame:
    """The mirror's system time read as application time."""
    return mirror.select("entity", "rev_id", F.col("row_start").alias("valid_from"),
                         F.when(F.col("row_end") == system_max(), infinity()).otherwise(F.col("row_end")).alias("valid_to"))


def mirror_answers(mirror: DataFrame, probes: DataFrame, strategy: str = "as_of", max_rows: int | None = None) -> DataFrame:
    """Answers from the system-time mirror: the version current at each probe's instant.

    ``as_of``  the AS OF predicate per probe, an access path of its own; work grows as probes x versions of an entity.
    ``carry``  the mirror read as a timeline, in one linear scan.
    ``bucket``  the mirror read as a timeline, joined month by month.
    """
    if strategy in ("carry", "bucket"):
        return revisions_at(mirror_intervals(mirror), probes, strategy, max_rows)
    if strategy != "as_of":
        raise ValueError("strategy is as_of, carry or bucket")
    rows = mirror.select("entity", "rev_id", "row_start", "row_end")
    at = (F.col("row_start") <= F.col("t")) & (F.col("row_end") > F.col("t"))
    found = probes.join(rows, "entity").filter(at).select("probe_id", "rev_id", F.col("row_start").alias("valid_from"))
    return probes.join(found, "probe_id", "left")


def cross_check(timeline: DataFrame, mirror: DataFrame, probes: DataFrame, max_rows: int | None = None, strategy: str = "carry") -> DataFrame:
    """Application-time answer against mirror answer, per probe.

    ``carry`` asks both in one linear scan. ``as_of`` asks the mirror by its own predicate, which joins a probe with every
    version of its entity: for entities with few of either."""
    if strategy == "carry":
        both = answers_of({"app": timeline, "mirror": mirror_intervals(mirror)}, probes, max_rows)
        both = both.select("probe_id", "entity", "t", F.col("app.rev_id").alias("app_rev"), F.col("mirror.rev_id").alias("mirror_rev"))
    else:
        app = revisions_at(timeline, probes, "carry", max_rows).select("probe_id", "entity", "t", F.col("rev_id").alias("app_rev"))
        other = mirror_answers(mirror, probes, strategy).select("probe_id", F.col("rev_id").alias("mirror_rev"))
        both = app.join(other, "probe_id", "left")
    return both.withColumn("agrees", F.col("app_rev").eqNullSafe(F.col("mirror_rev")))


def load_stamped(events: DataFrame, loaded_at) -> DataFrame:
    """The naive import: every version stamped with the load instant, so only the last event of an entity
    survives and nothing is known as of any earlier date."""
    last = events.groupBy("entity").agg(F.max(F.struct("ts", "rev_id")).alias("e"))
    return last.select("entity", "e.rev_id", "e.ts", ntz(loaded_at).alias("row_start"), system_max().alias("row_end"))


def keep_since(versions: DataFrame, cutoff) -> DataFrame:
    """Retention: versions that ended before ``cutoff`` are gone; current rows always stay."""
    return versions.filter(F.col("row_end") >= ntz(cutoff))


def live_counts_per_year(timeline: DataFrame, mirror: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Intervals live in each calendar year, from the timeline and from the mirror.

    Each row expands to the years it covers, at most the length of the coverage.
    """
    def counts(df, lo, hi, out):
        from_year = F.greatest(F.year(lo), F.lit(first_year))
        # half-open: an interval ending at new year's midnight does not reach into that year
        to_year = F.least(F.year(F.col(hi) - F.expr("interval 1 microsecond")), F.lit(last_year))
        return (df.filter(from_year <= to_year)
                .select(F.explode(F.sequence(from_year, to_year)).alias("year"))
                .groupBy("year").agg(F.count(F.lit(1)).alias(out)))

    return (counts(timeline, "valid_from", "valid_to", "app_rows")
            .join(counts(mirror, "row_start", "row_end", "mirror_rows"), "year", "full_outer")
            .withColumn("agrees", F.col("app_rows").eqNullSafe(F.col("mirror_rows"))))


def dataset_statistics(events: DataFrame, texts: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: entities, events, distinct texts and their bytes, superseded versions."""
    e = events.agg(F.count_distinct("entity").alias("entities"), F.count(F.lit(1)).alias("revisions"))
    t = texts.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("raw_bytes"))
    v = superseded(versions).agg(F.count(F.lit(1)).alias("history_rows"))
    # three single rows become one
    parts = e.unionByName(t, allowMissingColumns=True).unionByName(v, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])
