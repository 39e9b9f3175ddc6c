"""Operator 13: phrase collocations by SETM relational mining.

An occurrence relation R_k lists where frequent phrases of k words stand: one row for a document with the sorted positions and,
beside them, the keys of the phrases (positions leave a gap between pieces) and the number of the task that wrote them. Each
length takes four steps:

* merge-join: R_k meets itself in the same piece at the next position, which gives the occurrences of phrases of k + 1 words;
* group-count: tasks send sorted runs of counted phrases to buckets, which merge them; of the parts of R_k that hold a frequent
  phrase the first is noted, and that part alone names its front and back;
* semi-join: R_{k+1} keeps the occurrences of frequent phrases only;
* R_{k+1} is written in order of position, and the next length reads it.

A piece lies in one row, so the merge-join moves nothing. The semi-join sends the frequent keys to all tasks up to ``most_sent``
of them (8 bytes each); beyond, occurrences are joined as rows with the frequent keys, with no bound on either.

A key is a 64-bit hash of language and words. Words are counted by their letters; of longer phrases, those with the same key
count as one: among a billion different frequent neighbours the odds of any such pair are 1 in 40.

Defined results: a null or blank text has no words, a null language counts as ``und``. Rows of one id are documents each;
no id is read. Without a frequent phrase the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinclock.llm.common import bound_batches
from twinclock.session import materialise

LEAST, WORDS, TOP, COVER = 100, 5, 2000, 100
#: Frequent keys that are sent to every task; more are joined.
MOST_SENT = 4_000_000
#: Keys of a run, keys of a bucket of the group-count.
RUN, BUCKET = 1_000_000, 1_000_000
#: Words of a language that a task remembers.
MOST_WORDS = 60_000
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
NOWHERE = "und"
_AS_LINES = bytes.maketrans(PIECE_ENDS, b"\n" * len(PIECE_ENDS))
_ODD, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
OCCURRENCES = "lang string, part int, pos array<bigint>, key array<bigint>"
PARTS = "lang string, key bigint, front bigint, back bigint"
_OCCURRENCES = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("pos", pa.list_(pa.int64())), ("key", pa.list_(pa.int64()))])


def pieces(text: bytes | None) -> list[list[bytes]]:
    """Words of each piece, A-Z lower-cased."""
    if not text:
        return []
    # of the blanks that split() knows, those that end a piece are gone by then: only space and tab are left
    return [w for p in text.lower().translate(_AS_LINES).split(b"\n") if (w := p.split())]


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


class _Keys(dict):
    """Keys of the words of one language, as they come."""

    def __init__(self, lang: str):
        self._hash = partial(xxhash.xxh64_intdigest, seed=_seed(lang))

    def __missing__(self, word: bytes) -> int:
        key = self[word] = self._hash(word)
        return key


def _joined(front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The key of a phrase from the keys of its first and its last words."""
    x = front.view(np.uint64) * _ODD + (back.view(np.uint64) ^ (back.view(np.uint64) >> np.uint64(31))) * _STIR
    x ^= x >> np.uint64(29)
    x *= _ODD
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, key) of every occurrence of a batch."""
    pos, key = batch.column("pos"), batch.column("key")
    lengths = pos.value_lengths().to_numpy()
    return np.repeat(np.arange(len(lengths)), lengths), pos.flatten().to_numpy(), key.flatten().to_numpy()


def _nested(batch: pa.RecordBatch, row: np.ndarray, pos: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Rows with occurrences, each with its own."""
    cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
    some = np.flatnonzero(np.diff(cuts))
    offsets = pa.array(np.append(cuts[some], len(row)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pos, key)]
    part = pa.array(np.full(len(some), _task(), np.int32))
    return pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(some)), part, *lists], schema=_OCCURRENCES)


def _task() -> int:
    task = TaskContext.get()
    return 0 if task is None else task.partitionId()


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of one part each, with its number; rows of a part come together."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True):
            yield int(part[i]), batch.slice(i, j - i)


def _next_length(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The merge-join of a batch with itself at the next position: (row, position, front key, back key)."""
    row, pos, key = _flat(batch)
    meets = np.flatnonzero((row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1))
    return row[meets], pos[meets], key[meets], key[meets + 1]


def _documents(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.coalesce(lang, F.lit(NOWHERE)).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, a: occurrences of every word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, dict[bytes, int]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = own.setdefault(lang, {})
                for piece in pieces(text):
                    for w in piece:
                        mine[w] = mine.get(w, 0) + 1
            for lang, mine in own.items():
                n = len(mine)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(mine.keys(), pa.binary()), pa.array(mine.values(), pa.int64())], ["lang", "word", "a"])
    rows = _documents(docs).mapInArrow(count, "lang string, word binary, a bigint")
    return rows.groupBy("lang", "word").agg(F.sum("a").alias("a"))


def occurrences(docs: DataFrame, among=None) -> DataFrame:
    """R_1 (lang, pos, key): every word of a document, with a free position after each piece."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, _Keys] = {}
        for batch in batches:
            cuts, flat, gaps = [0], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in keys or len(keys[lang]) > MOST_WORDS:
                    keys[lang] = _Keys(lang)
                key = keys[lang]
                for n, piece in enumerate(pieces(text)):
                    flat += [key[w] for w in piece]
                    gaps.append((len(piece), n))
                cuts.append(len(flat))
            starts, sizes = np.array(cuts), np.array(gaps, np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            pos = np.arange(len(flat)) - starts[row] + np.repeat(sizes[:, 1], sizes[:, 0])
            yield _nested(batch, *_chosen(among, row, pos, np.array(flat, np.uint64).view(np.int64)))
    return _documents(docs).mapInArrow(place, OCCURRENCES)


def word_key(lang: str, word: bytes) -> int:
    return int(np.uint64(_Keys(lang)[word]).view(np.int64))


def _with_keys(words: DataFrame) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.fromiter(map(word_key, batch.column("lang").to_pylist(), batch.column("word").to_pylist()), np.int64, batch.num_rows)
            yield batch.append_column("key", pa.array(key))
    return words.mapInArrow(add, "lang string, word binary, a bigint, key bigint")


def extend(occ: DataFrame, among=None) -> DataFrame:
    """R_{k+1} from R_k, by the merge-join; phrases not yet known to be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, front, back = _next_length(batch)
            yield _nested(batch, *_chosen(among, row, pos, _joined(front, back)))
    return occ.mapInArrow(run, OCCURRENCES)


def _packed(values: np.ndarray) -> bytes:
    """First the low bytes of all values, then the next ones, and so on: small values leave runs of zeros, which the shuffle
    compresses."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _runs(keys: list[np.ndarray], counts: list[np.ndarray], depth: int, part: int) -> Iterator[pa.RecordBatch]:
    """A sorted run of counted keys, cut at the buckets of their first ``depth`` bits; keys as differences."""
    key, count = _summed(keys, counts)
    bucket = (key >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(key), np.int64)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.empty(0, np.int64)
    for at in range(0, len(cuts), 1024):
        starts = cuts[at: at + 1024]
        ends = np.append(cuts, len(key))[at + 1: at + 1025]
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(spans), part, np.int32)),
                                          pa.array([_packed(np.diff(key[i:j], prepend=np.uint64(0))) for i, j in spans], pa.binary()),
                                          pa.array([_packed(count[i:j]) for i, j in spans], pa.binary())], ["bucket", "part", "keys", "counts"])


def phrase_counts(occ: DataFrame, least: int, words: int) -> DataFrame:
    """key, a, part: the phrases of the next length that occur ``least`` times, with the first part of ``occ`` that has them;
    ``words`` is the number of words of the corpus.

    A task counts its own occurrences and sends sorted runs, one for each bucket of keys; a bucket adds up what it gets. A
    bucket has about BUCKET keys at most, and a phrase one count from a run, however often it occurs."""
    depth = max(0, int(words // BUCKET).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, now = [], [], 0, -1
        for part, batch in _by_part(batches):
            if held and part != now:
                yield from _runs(keys, counts, depth, now)
                keys, counts, held = [], [], 0
            now = part
            _, _, front, back = _next_length(batch)
            key, a = np.unique(_joined(front, back).view(np.uint64), return_counts=True)
            keys.append(key)
            counts.append(a.astype(np.int64))
            held += len(key)
            if held > RUN:
                yield from _runs(keys, counts, depth, now)
                keys, counts, held = [], [], 0
        if held:
            yield from _runs(keys, counts, depth, now)

    def add_up(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(k), dtype=np.uint64) for k in group.column("keys").to_pylist()]
        counts = [_unpacked(c).view(np.int64) for c in group.column("counts").to_pylist()]
        key, a = _summed(keys, counts)
        often = a >= least
        key, a, first = key[often], a[often], np.full(int(often.sum()), np.iinfo(np.int32).max, np.int32)
        for own, part in zip(keys, group.column("part").to_pylist(), strict=True):
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            has = own[at] == key
            first[has] = np.minimum(first[has], part)
        return pa.table({"key": pa.array(key.view(np.int64)), "a": pa.array(a), "part": pa.array(first)})
    return occ.mapInArrow(run, "bucket bigint, part int, keys binary, counts binary").groupBy("bucket").applyInArrow(add_up, "key bigint, a bigint, part int")


def _sent(occ: DataFrame, frequent: DataFrame, most_sent: int):
    """A test of keys against ``frequent`` for use in tasks, or None if they are too many to be sent."""
    if frequent.count() > most_sent:
        return None
    sent = occ.sparkSession.sparkContext.broadcast(np.sort(frequent.select("key").toArrow().column(0).to_numpy().astype(np.int64)))

    def among(own: np.ndarray) -> np.ndarray:
        known = sent.value
        return known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
    return among


def phrase_parts(occ: DataFrame, frequent: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """lang, key, front, back, a for the frequent phrases (key, a) of the next length; front and back are the keys of their
    first and their last words."""
    sent = None
    if frequent.count() <= most_sent:
        known = frequent.select("key", "part").toArrow()
        key, part = (known.column(c).to_numpy() for c in ("key", "part"))
        order = np.argsort(key)
        sent = occ.sparkSession.sparkContext.broadcast((key[order].astype(np.int64), part[order].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, home = sent.value if sent else (np.empty(0, np.int64), None)
        told = np.zeros(len(known), bool)
        for part, batch in _by_part(batches):
            row, _, front, back = _next_length(batch)
            key, first = np.unique(_joined(front, back), return_index=True)
            if sent and len(known):
                # a phrase is told by its own part, once
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                new = (known[at] == key) & (home[at] == part) & ~told[at]
                told[at[new]] = True
                key, first = key[new], first[new]
            if len(key):
                lang = batch.column("lang").take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(key), pa.array(front[first]), pa.array(back[first])], ["lang", "key", "front", "back"])
    return occ.mapInArrow(run, PARTS).distinct().join(frequent.select("key", "a"), "key")


def semi_join(occur, source: DataFrame, frequent: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """The occurrences that ``occur`` (``occurrences`` or ``extend``) makes of ``source``, if their key is one of ``frequent``
    (a written table). Keys that can be sent are looked up where the occurrences are made."""
    among = _sent(source, frequent, most_sent)
    return _semi_join_as_rows(occur(source), frequent) if among is None else occur(source, among)


def _chosen(among, row: np.ndarray, pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    if among is None:
        return row, pos, key
    own, at = np.unique(key, return_inverse=True)
    kept = among(own)[at]
    return row[kept], pos[kept], key[kept]


def _semi_join_as_rows(occ: DataFrame, frequent: DataFrame) -> DataFrame:
    """The same by a join. Occurrences of a document come together again under a number of its own; a frequent key with very
    many occurrences is split at run time."""
    numbered = materialise(occ.withColumn("doc", F.monotonically_increasing_id()), "phrases-numbered")
    rows = numbered.select("doc", "lang", F.explode(F.arrays_zip("pos", "key")).alias("at")).select("doc", "lang", "at.pos", "at.key")
    kept = rows.join(frequent.select("key"), "key", "left_semi").groupBy("doc", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("at"))
    return kept.select("lang", F.spark_partition_id().alias("part"), F.col("at.pos").alias("pos"), F.col("at.key").alias("key"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, words: int = WORDS, most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) for every phrase of up to ``words`` words that occurs ``least`` times in its language, and
    (lang, n): all words of a language. Both are written tables."""
    bound_batches(docs.sparkSession)
    counted = materialise(word_counts(docs), "phrases-words")
    totals = materialise(counted.groupBy("lang").agg(F.sum("a").alias("n")), "phrases-totals")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    named = materialise(_with_keys(counted.where(F.col("a") >= least)).select("lang", "key", F.col("word").cast("string").alias("phrase"), "a"), "phrases-1")
    occ = materialise(semi_join(occurrences, docs, named, most_sent), "phrases-at-1")
    last = F.element_at(F.split("back_phrase", " "), -1)
    out = named.withColumn("k", F.lit(1))
    for k in range(2, words + 1):
        often = materialise(phrase_counts(occ, least, n_words), f"phrases-often-{k}")
        if often.isEmpty():
            break
        found = materialise(phrase_parts(occ, often, most_sent), f"phrases-found-{k}")
        front = named.select("lang", F.col("key").alias("front"), F.col("phrase").alias("front_phrase"))
        back = named.select("lang", F.col("key").alias("back"), F.col("phrase").alias("back_phrase"))
        # front and back overlap in all words but one each, so the last word of back completes front
        joined = found.join(front, ["lang", "front"]).join(back, ["lang", "back"])
        named = materialise(joined.select("lang", "key", F.concat_ws(" ", "front_phrase", last).alias("phrase"), "a"), f"phrases-{k}")
        out = out.unionByName(named.withColumn("k", F.lit(k)))
        if k < words:
            occ = materialise(semi_join(extend, occ, often, most_sent), f"phrases-at-{k}")
    return out.select("lang", "phrase", "k", "a"), totals


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP, cover: int = COVER, most_sent: int = MOST_SENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of 2 to ``words`` words of each language.

    A phrase scores by the cut that explains it best, floor(1000 a n / (l r)) for its two parts' counts l and r; it is left out
    if a longer one holds it and has ``cover`` hundredths of its occurrences. Products are decimals of 38 digits."""
    phrases, totals = frequent_phrases(docs, least, words, most_sent)
    several = phrases.where("k > 1").withColumn("w", F.split("phrase", " "))
    size = lambda name: F.col(name).cast("int")
    cuts = several.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.col("w"), 1, size("cut")).alias("front"), _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("back"))
    counts = lambda part, name: phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    scored = cuts.join(counts("front", "l"), ["lang", "front"]).join(counts("back", "r"), ["lang", "back"]).join(F.broadcast(totals) if totals.count() < 1_000_000 else totals, "lang")
    scored = scored.withColumn("top", _exact("a") * _exact("n") * 1000).withColumn("score", F.expr("top div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    inner = several.where("k > 2").select("lang", "w", "k", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "w", "size", "longer", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    inner = inner.select("lang", _part(F.col("w"), F.col("start"), F.col("size")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * _exact("longer") < cover * _exact("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
