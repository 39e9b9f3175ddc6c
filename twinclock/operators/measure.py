"""Measurement jobs on tables: workloads, agreement of strategies, scaled copies, layouts, percentiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinclock.operators import lookups as L
from twinclock.operators import systime as D
from twinclock.operators.content import global_rank
from twinclock.operators.slices import Scan
from twinclock.schema import ntz, system_max
from twinclock.sources.layout import VersionTable


def _draw(column: str, salt: str):
    """A number in [0, 2^32) from the row and a salt; the same on every run and in SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.col(column).cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("bigint")


def probe_workload(entities: DataFrame, n: int, start, end, seed: int = 42) -> DataFrame:
    """``n`` seeded (entity, instant) pairs, uniform over the entities and the seconds of the window."""
    ranked = global_rank(entities.select("entity").distinct(), ["entity"])
    span = F.timestamp_diff("SECOND", ntz(start), ntz(end)) + 1
    total = ranked.agg(F.max("total").alias("n")).first()["n"]
    draws = entities.sparkSession.range(n).withColumnRenamed("id", "probe_id")
    return (draws.select("probe_id", (_draw("probe_id", f"e{seed}") % F.lit(total)).alias("rank"),
                         F.timestamp_add("SECOND", _draw("probe_id", f"t{seed}") % span, ntz(start)).alias("t"))
            .join(ranked.select("rank", "entity"), "rank").select("probe_id", "entity", "t"))


def aggregate_answers(events: DataFrame, probes: DataFrame) -> DataFrame:
    """Last event with ts <= t per probe by a join and one aggregation; for measurement, work grows as probes x events
    of an entity."""
    found = (probes.join(events.select("entity", "rev_id", "ts"), "entity").filter(F.col("ts") <= F.col("t"))
             .groupBy("probe_id").agg(F.max(F.struct("ts", "rev_id")).alias("e")))
    return probes.join(found, "probe_id", "left").select("probe_id", "entity", "t", "e.rev_id")


def strategy_agreement(timeline: DataFrame, events: DataFrame, mirror: DataFrame, probes: DataFrame,
                       max_rows: int | None = None, bucket: bool = False) -> DataFrame:
    """Every lookup strategy on one workload, each by an access path of its own: probes, and how many answers differ
    from those of the scan. ``bucket`` adds the join by months."""
    answers = {
        "carry": L.revisions_at(timeline, probes, "carry", max_rows),
        "join": L.revisions_at(timeline, probes, "join"),
        "events": aggregate_answers(events, probes),
        "mirror": D.mirror_answers(mirror, probes, "as_of")}
    if bucket:
        answers["bucket"] = L.revisions_at(timeline, probes, "bucket")
    rows = None
    for name, a in answers.items():
        one = a.select("probe_id", F.lit(name).alias("strategy"), "rev_id")
        rows = one if rows is None else rows.unionByName(one)
    per_probe = rows.groupBy("probe_id").agg(*[
        F.max(F.when(F.col("strategy") == s, F.col("rev_id"))).alias(s) for s in answers])
    return per_probe.agg(F.count(F.lit(1)).alias("probes"), *[
        F.count_if(~F.col(s).eqNullSafe(F.col("carry"))).alias(f"{s}_differs") for s in answers if s != "carry"])


def scaled_copies(df: DataFrame, k: int, shift: int | None = None) -> DataFrame:
    """k copies with shifted entity ids and unchanged times: rows multiply in place, nothing is shuffled.

    The default shift is the largest id plus one, so that copies of different entities never meet; ids must not be
    negative."""
    if shift is None:
        shift = (df.agg(F.max("entity")).first()[0] or 0) + 1
    copies = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("copy")
    cols = [(F.col("entity") + F.col("copy") * shift).alias("entity") if c == "entity" else F.col(c) for c in df.columns]
    return df.select("*", copies).select(*cols)


LAYOUTS = ("none", "year", "month")


def build_layouts(versions: DataFrame, path: str) -> dict[str, VersionTable]:
    tables = {}
    for g in LAYOUTS:
        tables[g] = VersionTable(versions.sparkSession, f"{path}/{g}", g)
        tables[g].append(versions)
    return tables


def layout_queries(entity, t, early, late, month) -> dict[str, Callable[[VersionTable], DataFrame]]:
    """The seven reads of the layout comparison; each gives one row (n, bytes)."""
    def total(df):
        return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))

    one = F.col("entity") == F.lit(entity)
    return {
        "current_point": lambda v: total(v.current().filter(one)),
        "current_scan": lambda v: total(v.current()),
        "asof_point": lambda v: total(v.as_of(t).filter(one)),
        "asof_scan_early": lambda v: total(v.as_of(early)),
        "asof_scan_late": lambda v: total(v.as_of(late)),
        "between_month": lambda v: total(v.between(*month)),
        "all_scan": lambda v: total(v.all()),
    }


def layout_answers(tables: dict[str, VersionTable], reads: dict[str, Callable[[VersionTable], DataFrame]]) -> DataFrame:
    """Answers of every read on every layout, for comparison."""
    out = None
    for layout, table in tables.items():
        for name, read in reads.items():
            one = read(table).select(F.lit(layout).alias("layout"), F.lit(name).alias("query"), "n", "bytes")
            out = one if out is None else out.unionByName(one)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, current and history per table; a table without row_end is all current."""
    out = None
    for name, df in tables.items():
        now = F.count_if(F.col("row_end") == system_max()) if "row_end" in df.columns else F.count(F.lit(1))
        one = df.agg(F.count(F.lit(1)).alias("rows"), now.alias("current")).select(
            F.lit(name).alias("table"), "rows", "current", (F.col("rows") - F.col("current")).alias("history"))
        out = one if out is None else out.unionByName(one)
    return out


def nearest_rank(timings: DataFrame, group: str, value: str, percents=(50, 95, 99), max_rows: int | None = None) -> DataFrame:
    """Nearest-rank percentiles per group: the value at position ceil(p/100 * n).

    Equal values are counted first, so a value shared by very many rows is one row of the scan, which counts from both
    ends: no total has to be joined back."""
    counts = timings.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    ranked = Scan(counts, group, [value], max_rows).running_sum("c", "upto").running_sum("c", "left", backward=True).result()
    ranked = ranked.withColumn("n", F.col("upto") + F.col("left") - F.col("c"))

    def at(p):
        position = F.floor((F.col("n") * p + 99) / 100)
        return F.max(F.when((F.col("upto") >= position) & (F.col("upto") - F.col("c") < position), F.col(value))).alias(f"p{p}")

    return ranked.groupBy(group).agg(F.max("n").alias("n"), *[at(p) for p in percents])
