"""Tables as events: map any columns onto (entity, rev_id, ts, attributes)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinclock.schema import ntz


def as_events(df: DataFrame, entity, rev_id, ts, **attributes: Column | str) -> DataFrame:
    return df.select(
        F.col(entity).alias("entity") if isinstance(entity, str) else entity.alias("entity"),
        F.col(rev_id).alias("rev_id") if isinstance(rev_id, str) else rev_id.alias("rev_id"),
        F.col(ts).alias("ts") if isinstance(ts, str) else ts.alias("ts"),
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in attributes.items()])


class Tables:
    """The parquet tables of one scale folder, and the event tables made from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        """Orders as revisions of a customer, one-day resolution with same-instant collisions."""
        return as_events(self["orders"], "o_custkey", "o_orderkey", "o_orderdate",
                         size_bytes=F.round(F.col("o_totalprice") * 100).cast("bigint"),
                         status="o_orderstatus", priority="o_orderpriority")

    @cached_property
    def user_events(self) -> DataFrame:
        """Dense log, one-second resolution."""
        return as_events(self["events"], "user_id", "event_id",
                         F.date_trunc("second", "ts").cast("timestamp_ntz"),
                         kind="event_type", size_bytes=F.round(F.col("value") * 100).cast("bigint"))

    @cached_property
    def documents(self) -> DataFrame:
        """Documents as revisions of their source, one hour apart; toxic ones are hidden."""
        hidden = self["labels"].select("doc_id", (F.col("toxic") == 1).alias("hidden"))
        docs = self["documents"].join(hidden, "doc_id", "left")
        ts = ntz("2020-01-01 00:00:00") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
        return as_events(docs, "source", "doc_id", ts, lang="lang", text="text",
                         hidden=F.coalesce("hidden", F.lit(False)),
                         sha1=F.sha1("text"), size_bytes=F.octet_length("text").cast("bigint"))
