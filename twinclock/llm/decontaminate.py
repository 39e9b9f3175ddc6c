"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

Containment is one-sided: a long document holds a short item although their Jaccard similarity is tiny. So only the
item is sketched: its bottom-k MinHash sketch, the k smallest hashes of its shingles. Items are partitioned by the
number of their shingles (powers of two); within a partition k is set by the size so that no match is lost: a document
with at least 0.8 of n shingles misses fewer than k = n - ceil(0.8 n) + 1 of them, hence holds one of the k. A document
is only searched for the partitions its own number of shingles can contain. Candidates are then verified by their exact
shingles, as strings.

Shingles are five words, of lower-cased A-Z, split at ASCII white space. An item of fewer words is one shingle of its own
length, and documents are cut at that length too for its partition. An item or text without words matches nothing.
Null ids are kept as nulls. Items with equal texts are reported each; a repeated row counts as a row of its own.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinclock.llm.common import bound_batches, text_udf

WORDS, SHARE = 5, 0.8
#: Most bytes of item text in one broadcast; more items are searched in as many passes as they need.
PASS_BYTES = 8 << 20
PIECE = 1 << 18
#: Words whose hashes a Python worker remembers, from task to task.
REMEMBER = 150_000
_MIX = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, WORDS + 1)], np.uint64)
FOUND = "array<struct<item:int,shared:int,size:int>>"


def _shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[k: k + width]) for k in range(len(words) - width + 1)}


class _Words(dict):
    """Hashes of words, remembered: REMEMBER of them at most."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_known = _Words()


def known_words() -> _Words:
    """The words of this Python worker, kept from task to task."""
    return _known


def _hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    total = np.zeros(max(0, n), np.uint64)
    for k in range(width):
        total += words[k: k + n] * _MIX[k] if n > 0 else 0
    return total ^ (total >> np.uint64(29))


class Sketches:
    """Bottom-k sketches of a block of items, one index for each width and size partition."""

    def __init__(self, texts: list[bytes | None]):
        self.items = []
        word = _Words()
        index: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, text in enumerate(texts):
            words = (text or b"").lower().split()
            width = min(WORDS, len(words))
            own = _shingles(words, width) if words else set()
            need = math.ceil(SHARE * len(own) - 1e-9)
            self.items.append((own, need))
            if own:
                size = len(own).bit_length()
                hashes = np.unique(_hashes(np.array([word[w] for w in words], np.uint64), width))
                for h in hashes[: len(own) - need + 1].tolist():
                    index[width, size][h].append(n)
        self.parts = []
        for (width, size), of in sorted(index.items()):
            keys = np.array(sorted(of), np.uint64)
            gate = np.zeros(1 << 16, bool)
            gate[keys & np.uint64(0xFFFF)] = True
            least = min(self.items[n][1] for own in of.values() for n in own)
            self.parts.append((width, least, keys, gate, of))

    def candidates(self, hashes: dict[int, list[np.ndarray]]) -> set[int]:
        found: set[int] = set()
        for width, least, keys, gate, of in self.parts:
            if sum(map(len, hashes[width])) < least:
                continue
            for part in hashes[width]:
                some = part[gate[part & np.uint64(0xFFFF)]]
                if len(some):
                    for h in some[keys[np.minimum(np.searchsorted(keys, some), len(keys) - 1)] == some].tolist():
                        found.update(of[h])
        return found

    def find(self, text: bytes | None, word: _Words) -> list[dict]:
        words = (text or b"").lower().split()
        if not words:
            return []
        widths = {p[0] for p in self.parts}
        hashes: dict[int, list[np.ndarray]] = {w: [] for w in widths}
        for at in range(0, len(words), PIECE):
            part = words[at: at + PIECE + WORDS - 1]
            codes = np.fromiter(map(word.__getitem__, part), np.uint64, len(part))
            for w in widths:
                hashes[w].append(_hashes(codes[: PIECE + w - 1], w))
        out = []
        own: dict[int, set[bytes]] = {}
        for n in sorted(self.candidates(hashes)):
            wanted, need = self.items[n]
            width = next(iter(wanted)).count(b" ") + 1
            if width not in own:
                own[width] = _shingles(words, width)
            shared = len(wanted & own[width])
            if shared >= need:
                out.append({"item": n, "shared": shared, "size": len(wanted)})
        return out


def _finder(docs: DataFrame, texts: list[bytes | None]):
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def prepare():
        sketches, word = Sketches(shared.value), known_words()
        return lambda batch: pa.array([sketches.find(t, word) for t in batch], pa.list_(pa.struct([("item", pa.int32()), ("shared", pa.int32()), ("size", pa.int32())])))
    return text_udf(prepare, FOUND)


def _blocks(items: DataFrame):
    """Items in blocks of at most about PASS_BYTES of text, dealt by a hash of text and id; each block fits a broadcast."""
    items = items.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // PASS_BYTES + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = part.select("item_id", F.col("text").cast("binary").alias("text")).collect()
        yield [r["item_id"] for r in rows], [None if r["text"] is None else bytes(r["text"]) for r in rows]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every document and item it holds to 0.8 or more."""
    bound_batches(docs.sparkSession)
    out = None
    for ids, texts in _blocks(items):
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"item int, item_id {dict(items.dtypes)['item_id']}")
        hits = docs.select("doc_id", F.explode(_finder(docs, texts)(F.col("text"))).alias("hit"))
        hits = hits.select("doc_id", "hit.*").join(F.broadcast(names), "item").select(
            "doc_id", "item_id", F.col("shared").alias("n_shared"), F.col("size").alias("n_item"), (F.col("shared") / F.col("size")).alias("containment"))
        out = hits if out is None else out.union(hits)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item to 0.8 or more, with their columns as they are."""
    bound_batches(docs.sparkSession)
    for _, texts in _blocks(items):
        docs = docs.where(F.size(_finder(docs, texts)(F.col("text"))) == 0)
    return docs
