"""Operator 12: periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period q, at least ``max(least, 2 q)`` long, that no neighbouring word extends with
that period. The suffixes of a text are put in order and every pair of neighbours in that order is an edge with its longest
common prefix (LCP). Edges are taken by decreasing LCP; each unites two classes of suffixes, kept as ordered sets of positions.
A run that starts at i with period q makes i and i + q neighbours in their class exactly when LCP(i, i + q) is reached: a
position between them would give the run a smaller period. So each newly neighbouring pair at a distance within the LCP is a
stretch with its smallest period, and it is a run if the words before the pair differ.

A text is worked on where it lies: nothing is shuffled, and memory grows with one batch of texts, in proportion to its words.

Defined results: a null, empty or blank text has no words and no runs, and collapses to an empty text. Rows come back as
they are, null and repeated ids included. A word is compared as its bytes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinclock.llm.common import bound_batches, text_udf

#: Least length of a run in words.
LEAST = 12
#: Words of a pair that are compared in step with all other pairs, before it is followed on its own.
IN_STEP = 32
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: binary>"


def suffix_neighbours(word: np.ndarray, end: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of neighbours in the order of suffixes that share ``deep`` words, at least; ``deep`` is a power of two.

    ``word`` numbers the words so that texts share none, ``end`` is the end of each word's text. Sorts by 1, 2, 4 ... words and
    takes along only what is not yet apart."""
    n = len(word)
    order = np.argsort(word, kind="stable")
    rank = np.empty(n, np.int64)
    slots, key, width = np.arange(n), word[order], 1
    kept = near = None
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        if width == deep:
            kept, near = slots[~alone], ~new[~alone]
        slots = slots[~alone]
        if not len(slots):
            break
        at = order[slots]
        after = at + width
        key = rank[at] * (n + 1) + np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        width *= 2
    if kept is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    second = kept[near]
    return order[second - 1], order[second]


def _follow(word: np.ndarray, a: int, b: int, most: int) -> int:
    done, step = 0, 2 * IN_STEP
    while done < most:
        k = min(step, most - done)
        differ = word[a + done: a + done + k] != word[b + done: b + done + k]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + k, 2 * step
    return most


def common_prefixes(word: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, deep: int) -> np.ndarray:
    """LCP of all pairs, in order of b. If the words before a pair are the same, its LCP is one less than that of the pair
    before; the others are compared, n log n words altogether. ``b`` is in rising order."""
    start = np.empty(len(word), bool)
    start[:1] = True
    start[1:] = end[1:] != end[:-1]
    fresh = start[a] | start[b] | (word[a - 1] != word[b - 1])
    at = np.flatnonzero(fresh)
    x, y = a[at], b[at]
    most = end[x] - np.maximum(x, y)
    lcp = np.minimum(deep, most)
    going = np.arange(len(at))
    for _ in range(IN_STEP):
        going = going[lcp[going] < most[going]]
        going = going[word[x[going] + lcp[going]] == word[y[going] + lcp[going]]]
        if not len(going):
            break
        lcp[going] += 1
    for k in going.tolist():
        lcp[k] += _follow(word, x[k] + lcp[k], y[k] + lcp[k], most[k] - lcp[k])
    whole = np.zeros(len(b), np.int64)
    whole[at] = lcp + y
    last = np.maximum.accumulate(np.where(fresh, np.arange(len(b)), 0))
    return whole[last] - b


def unite(word: np.ndarray, end: np.ndarray, a: list, b: list, lcp: list, least: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) from edges by decreasing LCP. Classes hold negated positions: a run grows to its left, so
    most new members then come last."""
    home: dict[int, list[int]] = {}
    out = []

    def meet(i: int, j: int, common: int) -> None:
        period = j - i
        if period <= common and period + common >= least and (i == 0 or end[i - 1] != end[i] or word[i - 1] != word[j - 1]):
            out.append((i, period + common, period))

    for x, y, common in zip(a, b, lcp, strict=True):
        small, large = home.get(-x) or [-x], home.get(-y) or [-y]
        if len(small) > len(large):
            small, large = large, small
        home.setdefault(large[0], large)
        if len(small) * 16 > len(large):
            large += small
            large.sort()
        else:
            for p in small:
                insort(large, p)
        for p in small:
            k = bisect_left(large, p)
            if k and home.get(large[k - 1]) is large:
                meet(-p, -large[k - 1], common)
            if k + 1 < len(large) and home.get(large[k + 1]) is large:
                meet(-large[k + 1], -p, common)
        for p in small:
            home[p] = large
    return out


def find_runs(word: np.ndarray, end: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs of all texts by start and period; ``word`` and ``end`` as in ``suffix_neighbours``."""
    deep = 1
    while 2 * deep <= least // 2:
        deep *= 2
    a, b = suffix_neighbours(word, end, deep)
    by = np.argsort(b)
    a, b = a[by], b[by]
    lcp = common_prefixes(word, end, a, b, deep)
    long = np.flatnonzero(2 * lcp >= least)  # length = period + LCP, and the period is at most the LCP
    long = long[np.argsort(-lcp[long], kind="stable")]
    runs = unite(word.tolist(), end.tolist(), a[long].tolist(), b[long].tolist(), lcp[long].tolist(), least) if len(long) else []
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _batch(texts: list[bytes | None], least: int) -> pa.Array:
    split = [(t or b"").split() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    lengths = np.diff(bounds)
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for s in split for w in s), np.int64, int(bounds[-1]))
    text = np.repeat(np.arange(len(texts)), lengths)
    word += text * (len(number) + 1)
    runs = find_runs(word, np.repeat(bounds[1:], lengths), least) if len(word) else []
    collapsed = [b" ".join(s) for s in split]
    found = np.array(runs, np.int64).reshape(-1, 3)
    of = np.searchsorted(bounds, found[:, 0], side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    found[:, 0] -= bounds[of]
    for k, (low, high) in enumerate(pairwise(cuts.tolist())):
        if low < high:
            edge = np.zeros(lengths[k] + 1, np.int64)
            np.add.at(edge, found[low:high, 0] + found[low:high, 2], 1)
            np.add.at(edge, found[low:high, 0] + found[low:high, 1], -1)
            own = split[k]
            collapsed[k] = b" ".join([own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])
    rows = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], fields=list(RUN))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows), pa.array(collapsed, pa.binary())], ["runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period), collapsed_text: the words that no run contains after
    its first period, joined by a blank."""
    if least < 2:
        raise ValueError("a run has two words at least")
    bound_batches(docs.sparkSession)
    found = text_udf(lambda: lambda texts: _batch(texts, least), FOUND)(F.col("text"))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.runs", F.col("found.collapsed").cast("string").alias("collapsed_text"))


def drop_repetition(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with collapsed texts where a text has a run; all other texts and columns as they are."""
    bound_batches(docs.sparkSession)
    mark = "twinclock_found"
    while mark in docs.columns:
        mark += "_"
    found = text_udf(lambda: lambda texts: _batch(texts, least), FOUND)(F.col("text"))
    text = F.when(F.size(f"{mark}.runs") > 0, F.col(f"{mark}.collapsed").cast("string")).otherwise(F.col("text"))
    return docs.withColumn(mark, found).withColumn("text", text).drop(mark)
