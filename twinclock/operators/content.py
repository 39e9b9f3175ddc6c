"""Texts: de-duplication by digest, packing, lookup and size reports. Texts never travel through windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinclock.operators.lookups import snapshot_of_events
from twinclock.operators.slices import Scan
from twinclock.schema import MAX_PACK_BYTES, MAX_PACK_TEXTS
from twinclock.session import materialise, new_table_path


def distinct_texts(revisions: DataFrame) -> DataFrame:
    """One row per digest: text, byte length and the earliest revision that carries it; hidden ones have none.

    Copies of a text meet on the map side, so a digest shared by a third of all rows arrives as a few rows.
    """
    shown = revisions.filter(~F.col("hidden")) if "hidden" in revisions.columns else revisions
    return shown.groupBy("sha1").agg(
        F.first("text").alias("text"),          # equal digests carry equal texts
        F.max(F.octet_length("text").cast("bigint")).alias("byte_length"),
        F.min(F.struct("ts", "rev_id", "entity")).alias("o")) \
        .select("sha1", "text", "byte_length", F.col("o.entity").alias("entity"),
                F.col("o.rev_id").alias("first_rev"), F.col("o.ts").alias("first_ts"))


def damaged_texts(texts: DataFrame) -> DataFrame:
    """Stored texts whose digest or byte length does not fit; checked over the whole table."""
    return texts.filter((F.sha1("text") != F.col("sha1")) | (F.octet_length("text") != F.col("byte_length")))


# ---- packs ---------------------------------------------------------------------------------------
#
# A pack takes texts of one entity in order until the next would exceed the byte or the count bound. Where a
# pack starts depends on where the one before it ended, so an entity is a sequential job over its lengths.
# Entities longer than a block are cut into blocks that are worked on in parallel: a pack holds at most
# ``max_texts`` texts, so a block can only be entered at one of its first ``max_texts`` positions. Each block
# first says, for all of these, where the next block would be entered; chaining these small tables gives the
# true entries, and the blocks are then packed independently.

BLOCK = 1_000_000


def _next_start(prefix: np.ndarray, i: int, max_bytes: int, max_texts: int) -> int:
    """Position after the pack starting at ``i``; ``prefix[j]`` is the total length of the first j texts."""
    fits = int(np.searchsorted(prefix, prefix[i] + max_bytes, side="right")) - 1
    return min(max(i + 1, min(i + max_texts, fits)), len(prefix) - 1)


def _prefix(lengths) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.int64))))


def _exits(lengths, size: int, max_bytes: int, max_texts: int) -> list[tuple[int, int]]:
    """Per entry position: where the next block is entered, and how many packs start inside this one."""
    prefix, known = _prefix(lengths), {}
    for e in range(min(max_texts, size)):
        path, i = [], e
        while i < size and i not in known:
            path.append(i)
            i = _next_start(prefix, i, max_bytes, max_texts)
        exit_at, packs = known[i] if i < size else (i - size, 0)
        for p in reversed(path):
            packs += 1
            known[p] = (exit_at, packs)
    return [known[e] if e < size else (e - size, 0) for e in range(max_texts)]


def pack_texts(texts: DataFrame, max_bytes: int = MAX_PACK_BYTES, max_texts: int = MAX_PACK_TEXTS,
               block: int = BLOCK, max_rows: int | None = None) -> DataFrame:
    """(entity, sha1, pack, byte_offset, byte_length) of texts in (first_ts, first_rev) order.

    Only lengths are moved, never texts. An entity that fits into a block is one block.
    """
    narrow = texts.select("entity", "sha1", "byte_length", "first_ts", "first_rev")
    key_type = narrow.schema["entity"].dataType.simpleString()
    long = narrow.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("entity")

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _exits(pdf.sort_values("pos")["byte_length"], int(pdf["own"].sum()), max_bytes, max_texts)
        return pd.DataFrame({"entity": pdf["entity"].iloc[0], "block": pdf["block"].iloc[0], "entry": range(len(found)),
                             "exit": [f[0] for f in found], "packs": [f[1] for f in found]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = pdf.sort_values(["block", "entry"])[["exit", "packs"]].to_numpy().reshape(-1, max_texts, 2)
        entry, before, out = 0, 0, []
        for table in steps:
            out.append((entry, before))
            entry, before = int(table[entry][0]), before + int(table[entry][1])
        return pd.DataFrame({"entity": pdf["entity"].iloc[0], "block": range(len(out)),
                             "entry": [o[0] for o in out], "before": [o[1] for o in out]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        entry, before, size = int(pdf["entry"].iloc[0]), int(pdf["before"].iloc[0]), int(pdf["own"].sum())
        prefix, starts = _prefix(pdf["byte_length"]), np.zeros(len(pdf), dtype=np.int64)
        i = entry
        while i < size:
            starts[i] = 1
            i = _next_start(prefix, i, max_bytes, max_texts)
        return pd.DataFrame({"entity": pdf["entity"], "sha1": pdf["sha1"], "byte_length": pdf["byte_length"],
                             "pack": before + starts.cumsum(), "nth": np.arange(len(pdf))})[:size]

    packed = f"entity {key_type}, sha1 string, byte_length bigint, pack bigint, nth bigint"
    placed = materialise(
        Scan(narrow, "entity", ["first_ts", "first_rev"], max_rows).running_sum(F.lit(1), "nth").result()
        .withColumn("pos", (F.col("nth") - 1).cast("bigint"))
        .withColumn("block", F.floor(F.col("pos") / block).cast("bigint"))
        .select("entity", "sha1", "byte_length", "pos", "block"), "placed")
    # the first texts of a block are also shown to the block before, whose last pack may take them
    own = placed.withColumn("own", F.lit(True))
    peek = (placed.filter((F.col("block") > 0) & (F.col("pos") % block < max_texts))
            .withColumns({"block": F.col("block") - 1, "own": F.lit(False)}))
    rows = own.unionByName(peek)
    entries = (rows.join(long, "entity", "left_semi").groupBy("entity", "block")
               .applyInPandas(exits, f"entity {key_type}, block bigint, entry int, exit int, packs bigint")
               .groupBy("entity").applyInPandas(chain, f"entity {key_type}, block bigint, entry int, before bigint"))
    blocks = rows.join(entries, ["entity", "block"], "left").fillna(0, ["entry", "before"])
    # a pack may cross into the next block, so its texts are ordered by block and place
    numbered = (blocks.groupBy("entity", "block")
                .applyInPandas(lambda key, pdf: pack(pdf).assign(block=key[1]), packed + ", block bigint"))
    inside = Window.partitionBy("entity", "pack").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.select("entity", "sha1", "pack",
                           F.coalesce(F.sum("byte_length").over(inside), F.lit(0)).alias("byte_offset"), "byte_length")


def pack_summary(packs: DataFrame) -> DataFrame:
    return packs.groupBy("entity", "pack").agg(F.count(F.lit(1)).alias("texts"), F.sum("byte_length").alias("raw_bytes"))


# ---- lookups and reports -------------------------------------------------------------------------

def text_of(revisions: DataFrame, texts: DataFrame) -> DataFrame:
    """Revisions with their text by digest; hidden ones keep their row and have none."""
    shown = revisions.withColumn("sha1", F.when(~F.col("hidden"), F.col("sha1")))
    return (shown.join(texts.select("sha1", "text"), "sha1", "left")
            .withColumn("content_status", F.when(F.col("text").isNotNull(), "available").otherwise("hidden")))


def texts_at(revisions: DataFrame, texts: DataFrame, t) -> DataFrame:
    """Text of every entity as of ``t``: the snapshot carries digests, one text per entity is joined."""
    return text_of(snapshot_of_events(revisions, t, "sha1", "hidden"), texts)


def size_report(revisions: DataFrame, texts: DataFrame) -> DataFrame:
    """Sum of revision sizes against distinct texts, as one row."""
    r = revisions.agg(F.count(F.lit(1)).alias("revisions"), F.sum("size_bytes").alias("revision_bytes"))
    t = texts.agg(F.count(F.lit(1)).alias("texts"), F.sum("byte_length").alias("text_bytes"))
    both = r.unionByName(t, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn(
        "ratio", F.round(F.col("revision_bytes") / F.col("text_bytes"), 4))


def pick_by_size(events: DataFrame, fractions: list[float]) -> DataFrame:
    """Entities at given quantiles of total size.

    The rank of an entity is a count over all entities' totals; it is taken with a range-partitioned sort and
    one count per partition, not with a single-task window.
    """
    sizes = events.groupBy("entity").agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("revisions"))
    ranked = global_rank(sizes, ["bytes", "entity"])
    n = F.col("total")
    wanted = F.array_distinct(F.array(*[F.floor(F.lit(f) * n).cast("bigint") for f in fractions]))
    return ranked.filter(F.array_contains(wanted, F.col("rank"))).drop("total")


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """0-based ``rank`` over the whole table and its ``total``, without a single-task window.

    Rows are range partitioned once and written; partition counts, one row each, give the offsets.
    """
    parts = materialise(
        df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order), "rank")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = counts.select("part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("offset"),
                            F.sum("c").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy(*order)
    return (parts.withColumn("rn", F.row_number().over(within)).join(F.broadcast(offsets), "part")
            .withColumn("rank", F.col("offset") + F.col("rn") - 1).drop("part", "rn", "offset"))


def layout_study(revisions: DataFrame, texts: DataFrame, fractions: list[float]) -> DataFrame:
    """Bytes on disk of full text per version against digest references, for entities picked by size; with the versions
    and texts that are read back from each layout."""
    picked = pick_by_size(revisions, fractions).select("entity")
    chosen = revisions.join(picked, "entity", "left_semi").drop("text")
    inline = chosen.join(texts.select("sha1", "text"), "sha1", "left")
    stored = texts.join(chosen.select("sha1"), "sha1", "left_semi").select("sha1", "text")
    spark = revisions.sparkSession
    layouts = {"inline": [inline.select("entity", "rev_id", "text")],
               "inline_zstd": [inline.select("entity", "rev_id", "text")],
               "digest_zstd": [chosen.select("entity", "rev_id", "sha1"), stored.sortWithinPartitions("sha1")]}
    out = []
    for name, parts in layouts.items():
        versions = found = total = 0
        for part in parts:
            path = new_table_path(spark, name)
            part.write.option("compression", "zstd" if name.endswith("zstd") else "none").parquet(path)
            back = spark.read.parquet(path)
            texts_there = F.count("text") if "text" in back.columns else F.lit(0)
            row = back.agg(F.count(F.lit(1)).alias("n"), texts_there.alias("texts")).first()
            versions += row["n"] if "rev_id" in back.columns else 0
            found += row["texts"]
            total += _folder_bytes(spark, path)
        out.append((name, versions, found, total))
    return spark.createDataFrame(out, "layout string, versions bigint, texts bigint, bytes bigint")


def _folder_bytes(spark, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
