"""Operator 7: mixing sources to target weights by Poisson replication.

Of the ``total`` documents wanted, a source with weight w of all weights should give w / sum(w); its n documents are
repeated total * w / sum(w) / n times in the mean. A document's count is the Poisson quantile of a number in [0, 1)
hashed from seed and doc_id, so a lost task draws the same again. Rows are copied by their count and dealt to
partitions by a hash of seed, doc_id and copy number, and sorted by it there: a global shuffle with an even deal,
whatever the sizes of the sources.

Defined results: null is a source of its own. A source without a weight, or with one of zero or less, gives nothing. Rows
that repeat a doc_id draw the same count. Without documents or positive weights the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinclock.session import materialise

SEED = 42
#: Quantile tables up to this many numbers (8 bytes each) are broadcast; beyond it the join is salted.
BROADCAST_NUMBERS = 1 << 20
SALTS = 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: DataFrame | None, total: float | None) -> DataFrame:
    """source, rate: the mean number of copies of a document of each source."""
    sizes = materialise(docs.groupBy("source").agg(F.count("*").alias("n")), "mix-sizes")
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        w = weights.groupBy(F.col("source").alias("s")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = sizes.join(w, sizes["source"].eqNullSafe(w["s"])).drop("s")
    weighed = weighed.where("weight > 0")
    goal = float(sizes.agg(F.sum("n")).first()[0] or 0) if total is None else float(total)
    whole = float(weighed.agg(F.sum("weight")).first()[0] or 1)
    return weighed.select("source", (F.lit(goal) * F.col("weight") / F.lit(whole) / F.col("n")).alias("rate"))


def quantiles(rates: DataFrame) -> DataFrame:
    """source, cdf: P(count <= k) for k = 0, 1, ... until it can't be told from 1."""
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))).alias("k")
    up = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = rates.select("source", "rate", k).withColumn("log_k", F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(0.0)).over(up))
    p = F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_k"))
    steps = steps.withColumn("c", F.sum(p).over(up))
    return steps.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` with copy (1, 2, ...) and mix_key, shuffled. ``weights``: source, weight; default: all equal.

    ``total``: documents wanted; default: as many as there are. A column of ``docs`` named copy or mix_key is replaced."""
    docs = docs.drop("copy", "mix_key")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    tables = quantiles(rates(docs, weights, total)).select(F.col("source").alias("twinclock_source"), F.col("cdf").alias("twinclock_cdf"))
    tables = materialise(tables, "mix-tables")
    numbers = tables.agg(F.sum(F.size("twinclock_cdf") + 8)).first()[0] or 0
    drawn = docs.withColumn("twinclock_u", uniform(seed, name))
    same = F.col("source").eqNullSafe(F.col("twinclock_source"))
    if numbers <= BROADCAST_NUMBERS:
        drawn = drawn.join(F.broadcast(tables), same)
    else:
        salted = tables.withColumn("twinclock_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = drawn.join(salted, same & (F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) == F.col("twinclock_salt"))).drop("twinclock_salt")
    drawn = drawn.withColumn("twinclock_n", F.size(F.filter("twinclock_cdf", lambda c: c <= F.col("twinclock_u")))).where("twinclock_n > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("twinclock_n"))))
    copies = copies.drop("twinclock_source", "twinclock_cdf", "twinclock_u", "twinclock_n")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")
