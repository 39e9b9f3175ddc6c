"""Operator 8: duplicate lines through levelled sorted runs of line hashes.

``LineRuns`` holds what earlier batches have seen: runs, each a table bucketed and sorted by line hash with the document
that keeps the line. A batch is grouped by hash, merge-anti-joined with each run in turn (the runs need no shuffle), and
what is new becomes a run of level 0. When a level holds FANOUT runs they are merged into one run of the next level, so
there are few runs to read and a hash is rewritten once per level.

Batches of one call are ranges of doc_id in rising order, so the document that keeps a line is the smallest that holds it. A
line that the given runs hold already stays with the document of the earlier call, whatever the ids.

Skew: a line is counted per task before the shuffle. Lines with more than 1/HOT of a batch's lines, at most HOT of them,
reach the rows by broadcast, the others by a shuffled join.

Defined results: a null or empty text is one empty line. Rows that repeat a doc_id are one document to the rule, and each
row is rebuilt from its own text. A row without doc_id keeps all lines and never counts as a document.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinclock.llm.common import lower_ascii
from twinclock.session import materialise, new_table_path

LEAST_CHARS = 10
HOT = 1000
FANOUT = 4
BATCHES = 4


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def read(self) -> DataFrame | None:
        runs = self.runs()
        return reduce(DataFrame.unionByName, runs) if runs else None

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key")
         .option("path", new_table_path(self.spark, "line-run")).saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, first: DataFrame) -> None:
        """Take in the hashes of ``first`` (key, keeper) that no run holds, then compact."""
        fresh = first.select("key", "keeper")
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), "key", "left_anti")
        self._write(fresh, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= FANOUT:
                merged = reduce(DataFrame.unionByName, [self.spark.table(n) for n in self.levels[level]])
                self._write(merged, level + 1)
                self.levels[level] = []


def _dropped(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """(doc_id, row, pos) of the lines of one batch that another document keeps; the batch is taken into the runs. A line the
    runs already hold stays with its keeper, whether the batch's ids lie above or below."""
    first = materialise(lines.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "line-first")
    runs.add(first)
    seen = first.select("key", F.col("keeper").alias("least"), "last", "n").join(runs.read(), "key")
    seen = seen.where("last <> keeper or least <> keeper").select("key", "keeper", "n")
    seen = materialise(seen, "line-seen")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot, cold = seen.where(F.col("n") * HOT > total).drop("n"), seen.where(F.col("n") * HOT <= total).drop("n")
    pairs = lines.join(F.broadcast(hot), "key").unionByName(
        lines.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key"))
    return materialise(pairs.where("doc_id <> keeper").select("doc_id", "row", "pos"), "line-dropped")


def dedup_lines(docs: DataFrame, runs: LineRuns | None = None, batches: int = BATCHES) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for every row of ``docs``."""
    runs = runs or LineRuns(docs.sparkSession)
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("line")).where(F.char_length("line") >= LEAST_CHARS)
    lines = materialise(lines.select("doc_id", "row", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key")), "lines")
    cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    dropped = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = lines if low is None else lines.where(F.col("doc_id") > low)
        dropped.append(_dropped(part if high is None else part.where(F.col("doc_id") <= high), runs))
    gone = reduce(DataFrame.unionByName, dropped).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "gone")
    rows = docs.select("doc_id", "text")
    joined = rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_row")), "left")
    parts = lines_of(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.concat_ws("\n", F.transform(stay, lambda k: F.get(parts, k))))
    return joined.select("doc_id", kept.alias("kept_text"), F.size(parts).cast("bigint").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"))
