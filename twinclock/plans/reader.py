"""Reads with a default AS OF, and the bundle of both-clock questions about one instant."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinclock.operators import lookups as L
from twinclock.operators import systime as D


class TemporalReader:
    """Registered version tables are seen as of ``default_as_of`` (None: current rows).

    Explicit methods override the default, and the versions themselves, so writes too, are untouched.
    """

    def __init__(self, spark: SparkSession, default_as_of: str | None = None):
        self.spark, self.default_as_of = spark, default_as_of
        self._tables: dict[str, DataFrame] = {}

    def register(self, name: str, versions: DataFrame) -> TemporalReader:
        self._tables[name] = versions
        self._refresh(name)
        return self

    def set_default(self, as_of: str | None) -> None:
        self.default_as_of = as_of
        for name in self._tables:
            self._refresh(name)

    def _refresh(self, name: str) -> None:
        self.table(name).createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        versions = self._tables[name]
        return D.current(versions) if self.default_as_of is None else D.as_of(versions, self.default_as_of)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def as_of(self, name: str, s) -> DataFrame:
        return D.as_of(self._tables[name], s)

    def between(self, name: str, a, b) -> DataFrame:
        return D.between(self._tables[name], a, b)

    def from_to(self, name: str, a, b) -> DataFrame:
        return D.from_to(self._tables[name], a, b)

    def all(self, name: str) -> DataFrame:
        return D.all_versions(self._tables[name])


def define_functions(spark: SparkSession, timeline: DataFrame, versions: DataFrame, prefix: str = "") -> None:
    """SQL table functions of this session over a timeline and its row versions; a second call replaces them.

    ``rev_at(at)`` the interval of every entity at an instant, ``rev_of(who, at)`` that of one entity, also per row of another
    table by ``LATERAL``, ``believed_at(known, at)`` what was believed at ``known`` about ``at``, ``versions_between(a, b)``
    the versions current at some moment of [a, b]. Their bodies are plain filters, so the optimiser sees through them;
    ``LATERAL rev_of`` becomes a join on the entity, whose work grows as probes x intervals of an entity.
    """
    for name, df in (("timeline", timeline), ("versions", versions)):
        df.createOrReplaceTempView(f"{prefix}{name}_rows")
    entity = timeline.schema["entity"].dataType.simpleString()
    interval = f"entity {entity}, rev_id BIGINT, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ"
    shown = "v.entity, v.rev_id, v.valid_from, v.valid_to"
    valid = "v.valid_from <= {f}.at AND {f}.at < v.valid_to"
    bodies = {
        "rev_at": ("at TIMESTAMP_NTZ", interval, f"SELECT {shown} FROM {prefix}timeline_rows v WHERE {valid}"),
        "rev_of": (f"who {entity}, at TIMESTAMP_NTZ", interval, f"SELECT {shown} FROM {prefix}timeline_rows v WHERE v.entity = {{f}}.who AND {valid}"),
        "believed_at": ("known TIMESTAMP_NTZ, at TIMESTAMP_NTZ", interval,
                        f"SELECT {shown} FROM {prefix}versions_rows v WHERE v.row_start <= {{f}}.known AND {{f}}.known < v.row_end AND {valid}"),
        "versions_between": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", f"{interval}, row_start TIMESTAMP_NTZ, row_end TIMESTAMP_NTZ",
                             f"SELECT {shown}, v.row_start, v.row_end FROM {prefix}versions_rows v WHERE v.row_start <= {{f}}.b AND v.row_end > {{f}}.a")}
    for name, (arguments, returned, body) in bodies.items():
        function = f"{prefix}{name}"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({arguments}) RETURNS TABLE ({returned}) RETURN {body.format(f=function)}")


def middle(start: str, end: str) -> str:
    a, b = datetime.fromisoformat(start), datetime.fromisoformat(end)
    return str((a + (b - a) / 2).replace(microsecond=0))


def lab(timeline: DataFrame, events: DataFrame, versions: DataFrame, mirror: DataFrame,
        checkpoints: list[tuple[str, str]], start: str, end: str, t: str | None = None,
        entity=None, rows: int | None = None, catalogue: DataFrame | None = None) -> dict[str, DataFrame]:
    """One DataFrame per both-clock question at ``t`` (default: the middle of the coverage).

    ``rows``: show only so many of the newest rows of the version lists. ``catalogue``: versions of the catalogue rows,
    whose audit trail is part of the bundle.
    """
    t = t or middle(start, end)
    if entity is not None:
        timeline, events, versions, mirror = (
            d.filter(F.col("entity") == F.lit(entity)) for d in (timeline, events, versions, mirror))

    def newest(df: DataFrame, *order: str) -> DataFrame:
        return df.orderBy(*[F.col(c).desc() for c in order]).limit(rows) if rows is not None else df

    first, last = (checkpoints[0][1], checkpoints[-1][1]) if checkpoints else (None, None)
    shown = ["entity", "rev_id", "valid_from", "valid_to"]
    out = {
        "app": L.revision_at(timeline, events, t),
        "all": newest(D.all_versions(versions), "valid_from", "row_start"),
        "mirror_as_of": D.as_of(mirror, t),
        "mirror_between": D.between(mirror, f"{t[:4]}-01-01 00:00:00", f"{t[:4]}-12-31 23:59:59"),
        "mirror_all": D.all_versions(mirror),
    }
    if catalogue is not None:
        out["audit"] = D.all_versions(catalogue).orderBy("row_start")
    if first:
        out["as_of"] = newest(D.as_of(versions, first), "valid_from")
        then = D.believed_at(versions, first, t).select(F.lit("first checkpoint").alias("knowledge"), *shown)
        now = L.snapshot(D.current(versions), t).select(F.lit("now").alias("knowledge"), *shown)
        out["bitemporal"] = then.unionByName(now)
    if first and last != first:
        out["between"] = newest(D.between(versions, first, last), "row_start", "valid_from")
    return out
