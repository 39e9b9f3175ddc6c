"""Operator 4: exact duplicates through a persistent digest index, bucketed and sorted by digest.

Texts are equal if they are identical after every run of ASCII white space became one space; the SHA-256 of that text
is its digest. New data is grouped by digest, the new digests are found by a sort-merge anti-join with the index (whose
side needs no shuffle) and appended to it. The earliest batch keeps a text; within a batch, the smallest doc_id.

Skew: rows are counted per digest before the shuffle; digests with more than 1/HOT of a batch's rows, at most HOT of
them, reach the rows by broadcast, all others by a shuffled join.

Defined results: a null text counts as empty. A null doc_id only stays if no row of its group has an id. Rows that
repeat doc_id and text are copies: ``decide`` marks each of them as kept, ``drop_duplicates`` leaves one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinclock.llm.common import BLANKS
from twinclock.session import materialise, new_table_path

HOT = 1000


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ").cast("binary"), 256))


class DigestIndex:
    """Digests seen so far with the id that stays: a Parquet table of ``buckets`` buckets at ``path``.

    Opening a path that already holds an index goes on with it. ``compact`` writes each bucket as one sorted file."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.id_type = spark, path, buckets, id_type
        self._open()

    def _open(self) -> None:
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id {self.id_type}) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the digests of ``groups`` (digest, first_id) that the index lacks."""
        fresh = groups.join(self.read().hint("merge"), "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"))
        # written aside first: a table can't be read and appended to in one job
        fresh = materialise(fresh, "digest-fresh")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self, path: str) -> DigestIndex:
        new = DigestIndex(self.spark, path, self.buckets, self.id_type)
        self.read().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(new.name)
        self.spark.catalog.refreshTable(new.name)
        return new


def new_index(docs: DataFrame) -> DigestIndex:
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, new_table_path(spark, "digest-index"), buckets, dict(docs.dtypes)["doc_id"])


def decide(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Take ``docs`` into the index; doc_id, keep_id, group_size (rows of this batch), kept, digest for every row."""
    rows = materialise(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digest-rows")
    groups = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "digest-groups")
    index.append(groups)
    known = materialise(groups.join(index.read().hint("merge"), "digest").select("digest", "keep_id", "group_size"), "digest-known")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = known.where(F.col("group_size") * HOT > total)
    cold = known.where(F.col("group_size") * HOT <= total)
    out = rows.join(F.broadcast(hot), "digest").unionByName(
        rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row of each group of equal texts, with its columns as they are."""
    decided = materialise(decide(docs, index or new_index(docs)), "digest-decided")
    mark = "twinclock_digest"
    while mark in docs.columns:
        mark += "_"
    gone = decided.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    same = lambda a: F.col("doc_id").eqNullSafe(F.col(f"{a}_id")) & (F.col(mark) == F.col(f"{a}_digest"))
    left = docs.withColumn(mark, digest(F.col("text"))).alias("rows").join(gone, same("gone"), "left_anti")
    again = decided.where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("digest").alias("again_digest"))
    again = materialise(again, "digest-again")
    if not again.isEmpty():
        left = left.join(again, same("again"), "left_anti").unionByName(left.join(again, same("again"), "left_semi").dropDuplicates(["doc_id", mark]))
    return left.drop(mark)
