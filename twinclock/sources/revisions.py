"""Revision feed: reading, slicing and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinclock.schema import CURATED_JSON, REVISION_JSON, ntz


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def normalise(df: DataFrame, entity: str) -> DataFrame:
    """Feed records to typed rows: hidden fields become null with a flag."""
    return df.select(
        F.col(entity).alias("entity"),
        F.col("revid").alias("rev_id"),
        F.nullif(F.col("parentid"), F.lit(0)).alias("parent_rev_id"),
        F.to_timestamp_ntz("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"),
        F.when(~_flag("userhidden"), F.col("user")).alias("editor"),
        F.when(~_flag("userhidden"), F.col("userid")).alias("editor_id"),
        _flag("userhidden").alias("editor_hidden"),
        F.when(~_flag("commenthidden"), F.coalesce("comment", F.lit(""))).alias("comment"),
        _flag("commenthidden").alias("comment_hidden"),
        _flag("minor").alias("is_minor"),
        F.col("size").alias("size_bytes"),
        F.when(~_flag("sha1hidden"), F.col("sha1")).alias("sha1"),
        (_flag("sha1hidden") | _flag("texthidden") | _flag("suppressed")).alias("content_hidden"))


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a page_id and the feed's revision fields."""
    schema = "page_id BIGINT, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REVISION_JSON)
    return normalise(spark.read.schema(schema).json(path), "page_id")


def parse_revisions(df: DataFrame, entity: str, json: str) -> DataFrame:
    """The same for a column of JSON texts."""
    return normalise(df.select(entity, F.from_json(json, REVISION_JSON).alias("r")).select(entity, "r.*"), entity)


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of {title, domain} with its position in the list."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"array<{CURATED_JSON.simpleString()}>")
    return whole.select(F.posexplode(items).alias("position", "r")).select("position", "r.*")


def window_slice(events: DataFrame, start, end) -> DataFrame:
    return events.filter(F.col("ts").between(ntz(start), ntz(end)))


def baseline(events: DataFrame, start) -> DataFrame:
    """Last event at or before ``start`` per entity, keeping its true instant."""
    rest = [c for c in events.columns if c != "entity"]
    last = (events.filter(F.col("ts") <= ntz(start)).groupBy("entity")
            .agg(F.max_by(F.struct(*rest), F.struct("ts", "rev_id")).alias("e")))
    return last.select("entity", "e.*").withColumn("is_baseline", F.lit(True))


def merge_slices(*slices: DataFrame) -> DataFrame:
    """One row per rev_id; a baseline row wins over the same revision from a slice."""
    flagged = [s if "is_baseline" in s.columns else s.withColumn("is_baseline", F.lit(False)) for s in slices]
    rows = flagged[0]
    for s in flagged[1:]:
        rows = rows.unionByName(s)
    rest = [c for c in rows.columns if c != "rev_id"]
    # copies of one revision meet on the map side first
    return (rows.groupBy("rev_id").agg(F.max_by(F.struct(*rest), "is_baseline").alias("r"))
            .select("rev_id", "r.*").select(*rows.columns))


def new_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    return events.join(stored.select("rev_id"), "rev_id", "left_anti")


def new_texts(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Digests not stored yet, each with the earliest event that carries its text."""
    wanted = events.filter(F.col("sha1").isNotNull() & ~F.col("content_hidden"))
    first = wanted.groupBy("sha1").agg(F.min(F.struct("ts", "rev_id", "entity")).alias("e"))
    return first.select("sha1", "e.*").join(stored.select("sha1"), "sha1", "left_anti")


def with_content_status(events: DataFrame, fetched: DataFrame) -> DataFrame:
    """available where the digest is known, not hidden, and its text was not hidden when it was fetched.

    ``fetched`` holds (sha1, hidden_now) per digest.
    """
    joined = events.join(fetched.select("sha1", "hidden_now"), "sha1", "left")
    ok = F.col("sha1").isNotNull() & ~F.col("content_hidden") & ~F.coalesce("hidden_now", F.lit(False))
    return (joined.withColumn("content_status", F.when(ok, "available").otherwise("hidden"))
            .withColumn("sha1", F.when(ok, F.col("sha1"))).drop("hidden_now"))
