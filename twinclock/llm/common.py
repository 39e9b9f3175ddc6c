"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators read it.
BLANKS = r"[\x20\x09-\x0D]+"
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time, unless the session has bounds of its own: a batch takes BATCH_ROWS texts
    or BATCH_BYTES of them, whichever comes first."""
    for key, default, bound in [("maxBytesPerBatch", 2**31 - 1, BATCH_BYTES), ("maxRecordsPerBatch", 10_000, BATCH_ROWS)]:
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", str(default)) == str(default):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(bound))


def text_udf(prepare: Callable[[], Callable[[list], pa.Array]], returns: str) -> Callable[[Column], Column]:
    """A column function over UTF-8 bytes. ``prepare`` runs once in a task; what it returns maps a list of byte
    strings (or None) to an Arrow array. Binary input: a text that isn't UTF-8 fails nowhere on the way."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = prepare()
        for batch in batches:
            yield each(batch.to_pylist())
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    call = F.arrow_udf(run, returns)
    return lambda text: call(text.cast("binary"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` says the same of a text that holds ASCII only, and is faster."""
    every = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(every)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) fixed by the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))
