"""Operator 2: toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Defined results: a null or empty text, or one of white space only, scores as a text without insults. Labels other than 0 and 1,
labels of unknown documents and null labels are ignored; a document labelled both ways teaches nothing. If the sample
holds only one class, every text gets a score below 0.7. Rows come back as they are, repeated ids included.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock.llm import toxicity_model
from twinclock.llm.common import bound_batches, crc_mod, text_udf, unit_hash
from twinclock.session import materialise

THRESHOLD = 0.7
#: Bounds of the sample the machine is fitted on: documents of each class, bytes of one text, bytes of all.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 3000
TEXT_BYTES, SAMPLE_BYTES = 4 << 20, 48 << 20


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> toxicity_model.Model:
    """Fit on at most about ``toxic`` and ``clean`` labelled documents, picked by a hash of their id, and on at most about
    SAMPLE_BYTES of text; texts above TEXT_BYTES teach nothing."""
    docs = docs.select("doc_id", "text")
    sure = (labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other"))
    counts = {r["label"]: r["count"] for r in sure.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, toxic / max(1, counts.get(1, 0))).otherwise(clean / max(1, counts.get(0, 0)))
    picked = sure.where(unit_hash(F.col("doc_id").cast("string")) < share)
    sample = materialise(docs.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").where(F.octet_length("text") <= TEXT_BYTES), "toxicity-sample")
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    return toxicity_model.fit(Sample(sample.where(unit_hash(F.col("doc_id").cast("string"), F.lit("bytes")) < SAMPLE_BYTES / size)))


class Sample:
    """The pairs (text, label) of a bounded sample (doc_id, label, text), in an order fixed by their ids. The driver holds none
    of them unless it iterates; ``apart`` hands them to a function in one task and returns what that returns."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "label")

    def __len__(self) -> int:
        return self.rows.count()

    def __iter__(self) -> Iterator[tuple[str, int]]:
        return iter(in_order(self.rows.toArrow().to_batches()))

    def apart(self, call: Callable[[list[tuple[str, int]]], object]) -> object:
        bound_batches(self.rows.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(call(in_order(batches)))], pa.binary())], ["made"])
        rows = self.rows.coalesce(1).mapInArrow(run, "made binary").collect()
        # a table without a file has no task
        return pickle.loads(rows[0]["made"]) if rows else call([])


def in_order(batches: Iterable[pa.RecordBatch]) -> list[tuple[str, int]]:
    rows = ((hash_order(i), t.decode("utf-8", "replace"), y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return [(t, y) for _, t, y in sorted(rows)]


def hash_order(doc_id) -> int:
    return int.from_bytes(str(doc_id).encode(), "little") * 0x9E3779B97F4A7C15 % (1 << 64)


def scorer(docs: DataFrame, model: toxicity_model.Model):
    """A column function from text to score. The model is a vector of fixed size, 4 MB, and is broadcast."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        scorer = toxicity_model.scorer_of(shared.value)

        def each(texts: list) -> pa.Array:
            margins = scorer.margins([t and t.decode("utf-8", "replace") for t in texts])
            return pa.array(scorer.model.probability(margins), pa.float64())
        return each
    return text_udf(prepare, "double")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 3) == 1


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. Only documents that are not held out teach."""
    model = train(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with their columns as they are."""
    model = train(docs, labels)
    return docs.where(scorer(docs, model)(F.col("text")) < THRESHOLD)
