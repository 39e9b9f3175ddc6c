"""Events in one order across all entities, read from any position on.

    rows/part=P    a range of the order (ts, rev_id, entity), sorted; every row of part P comes before those of part P + 1
    columns        no rows, the columns of the events
    bounds         one row per part: its rows, its first and last position, and the rows of all parts before it

The order is made once, by a range shuffle; no task holds more than a part. A reader that goes on from a position opens the
part it lies in and later ones only.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinclock.schema import ntz

ORDER = ["ts", "rev_id", "entity"]
ROWS_PER_PART = 1_000_000


def write_in_order(events: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """Write ``events`` (entity, rev_id, ts, ...) in parts of about ``rows_per_part`` rows.

    The cuts come from a sample: they decide the size of the parts, not the order. Rows without ts come first, as nulls do.
    """
    clash = {"part", "place", "rows_before"} & set(events.columns)
    if clash:
        raise ValueError(f"columns with names of the order: {sorted(clash)}")
    spark = events.sparkSession
    parts = max(1, ceil(events.count() / rows_per_part))
    (events.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id())
     .sortWithinPartitions("part", *ORDER).write.partitionBy("part").parquet(f"{path}/rows"))
    events.limit(0).write.parquet(f"{path}/columns")
    position = F.struct(*ORDER)
    rows = _rows(spark, path)
    bounds = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"), F.max(position).alias("last"))
    # one row per part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (bounds.withColumn("rows_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path}/bounds"))


def read_in_order(spark: SparkSession, path: str, after: tuple | None = None) -> DataFrame:
    """Rows with ``place``, their number in the whole order from 1; with ``after`` = (ts, rev_id) those that come later.

    Rows that agree in ts, rev_id and entity share a place range in any order. Sort by ``place`` to hand them to one consumer.
    """
    bounds = spark.read.parquet(f"{path}/bounds")
    rows = _rows(spark, path)
    later = None
    if after is not None:
        ts, rev_id = ntz(after[0]), F.lit(after[1])
        later = (F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("rev_id") > rev_id))
        ends_later = (F.col("last.ts") > ts) | ((F.col("last.ts") == ts) & (F.col("last.rev_id") > rev_id))
        start = bounds.filter(ends_later).agg(F.min("part").alias("part")).first()["part"]
        # a literal, so that the scan lists the folders it needs
        rows = rows.filter(F.col("part") >= start) if start is not None else rows.limit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(*ORDER))
    out = (rows.withColumn("within", within).join(bounds.select("part", "rows_before"), "part")
           .withColumn("place", F.col("rows_before") + F.col("within")).drop("part", "within", "rows_before"))
    return out if later is None else out.filter(later)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("part", "integer")).parquet(f"{path}/rows")
