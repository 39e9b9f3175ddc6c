"""Operator 5: language identification by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else reads as one blank. N-grams of one to three characters are hashed into BUCKETS;
the matrix of log-probabilities (BUCKETS x languages) is broadcast, and a task scores a batch of texts in numpy.

Defined results: ``und`` with score 0 if the text is null or has no letter; also for every text if nothing was learned.
Ties go to the language that sorts first. Null languages teach nothing. Rows come back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock.llm.common import bound_batches, crc_mod, text_udf, unit_hash

BUCKETS = 1 << 16
#: Bound of the sample: about so many documents of a language, picked by a hash of their id.
SAMPLE = 1500
#: Most languages; 65,536 log-probabilities of 4 bytes each, so the matrix stays below 128 MB.
MOST_LANGUAGES = 512
PIECE = 1 << 19
_K1, _K2, _K3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_LIMIT = 0x250
_LETTER = np.array([chr(c).isalpha() for c in range(_LIMIT)])


def _codes(text: str) -> np.ndarray:
    """Code points, 32 for runs of anything that is no letter; empty if there is no letter."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(cps, _LIMIT - 1)]
    far = cps >= _LIMIT
    if far.any():
        points, where = np.unique(cps[far], return_inverse=True)
        letter[far] = np.array([chr(c).isalpha() for c in points.tolist()])[where]
    if not letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(letter, cps, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    return np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Codes of a text, a bounded piece at a time; an n-gram over the seam of two pieces reads as ending there."""
    for at in range(0, len(text), PIECE):
        codes = _codes(text[at: at + PIECE])
        if len(codes):
            yield codes


def _grams(c: np.ndarray) -> np.ndarray:
    one = c * _K1
    two = one[:-1] * np.uint32(31) + c[1:] * _K2
    three = two[:-1] * np.uint32(31) + c[2:] * _K3
    x = np.concatenate([one, two * _K1, three * _K2])
    return (x ^ (x >> np.uint32(15))) * _K3 >> np.uint32(16)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, priors: np.ndarray):
        self.languages = languages
        smooth = counts + 0.1
        self.log = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32))
        self.prior = np.log(priors / priors.sum()) if len(priors) else priors

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            total, any_letter = self.prior.copy(), False
            for codes in _pieces(text or ""):
                any_letter = True
                grams = _grams(codes)
                if len(grams) < BUCKETS // 8:
                    total += self.log[grams].sum(0, dtype=np.float64)
                else:
                    n = np.bincount(grams, minlength=BUCKETS)
                    own = np.nonzero(n)[0]
                    total += n[own] @ self.log[own].astype(np.float64)
            if not any_letter or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
        return names, scores


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Count n-grams of about ``sample`` documents of each language."""
    bound_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; merge them or raise MOST_LANGUAGES and the executors' memory")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for name in languages for x in (name, sample / sizes[name])]), F.col("lang"))
    picked = known.where(unit_hash(F.col("doc_id").cast("string"), F.lit("lang")) < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        place = {name: n for n, name in enumerate(languages)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for codes in _pieces(text):
                    total[place[lang]] += np.bincount(_grams(codes), minlength=BUCKETS)
        who, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[who, bucket])], ["who", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS))
    found = picked.mapInArrow(count, "who int, bucket int, n bigint").groupBy("who", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found["who"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, counts, np.array([sizes[name] for name in languages], float))


def predictor(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def prepare():
        def each(texts: list) -> pa.Array:
            names, scores = shared.value.predict([t and t.decode("utf-8", "replace") for t in texts])
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))
        return each
    return text_udf(prepare, "struct<lang:string,score:double>")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Only documents that are not held out teach."""
    bound_batches(docs.sparkSession)
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(docs, model)(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
