"""Operator 9: SimHash near-duplicates through vantage-point trees.

A text's fingerprint has bit b set if more than half of the XXH64 (seed 42) of its 3-word shingles have it. Distinct
fingerprints are dealt to the leaves of a vantage-point tree: an inner node has a vantage fingerprint and a radius, and
sends a fingerprint inside if its Hamming distance to the vantage is at most the radius, else outside. A fingerprint
within reach of the boundary is also sent to the other side as a guest, so every pair within reach meets at least once;
the triangle bound prunes the rest. The vantages come from a bounded sample and only set who meets where. A leaf
compares exactly, in blocks, and keeps a forest of links in place of all pairs; a crowded leaf is shared by several tasks. Components join the leaves' forests.

Defined results: a null or blank text has fingerprint zero, linked like any other. Rows of one doc_id are one document
each; they share a component if they link. A null doc_id is never the smallest unless its component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinclock.llm.common import bound_batches, text_udf
from twinclock.llm.components import components
from twinclock.session import materialise

SEED, WORDS, REACH = 42, 3, 3
#: Distinct fingerprints a leaf should hold, fingerprints of the sample for each leaf, most leaves of a tree.
LEAF, SAMPLE, MOST_LEAVES = 4096, 32, 1 << 15
#: Comparisons of one task; a leaf with more of them is worked on by several tasks.
MOST_COMPARISONS = 20_000_000_000
CHUNK, BLOCK = 1 << 16, 2048
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
#: Byte to eight lanes of one byte, so that up to 255 hashes can be added lane by lane.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def _votes(hashes: np.ndarray) -> np.ndarray:
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 64).sum(0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at: at + CHUNK + WORDS - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(WORDS)))) if len(words) >= WORDS else [b" ".join(part)]  # noqa: B905
        votes += _votes(np.fromiter(map(_hash, shingles), np.uint64))
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def _fingerprints():
    return lambda texts: pa.array(map(fingerprint, texts), pa.int64())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", text_udf(_fingerprints, "bigint")(F.col("text")).alias("fp"))


class Tree:
    """A complete binary vantage-point tree: nodes 1 .. 2^depth - 1, node k's children 2k (inside) and 2k + 1."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.vantage = np.zeros(1 << depth, np.uint64)
        self.radius = np.zeros(1 << depth, np.int64)
        stack = [(1, np.sort(sample))]
        while stack:
            node, own = stack.pop()
            if node >= 1 << depth:
                continue
            if len(own):
                far = own[np.argmax(np.bitwise_count(own ^ own[0]))]
                spread = np.bitwise_count(own ^ far).astype(np.int64)
                self.vantage[node], self.radius[node] = far, int(np.median(spread))
                inside = spread <= self.radius[node]
            else:
                inside = np.zeros(0, bool)
            stack += [(2 * node, own[inside]), (2 * node + 1, own[~inside])]

    def place(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the fingerprint, leaf, home) for each leaf that it lives in or visits."""
        who, node, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            gap = np.bitwise_count(fps[who] ^ self.vantage[node]).astype(np.int64) - self.radius[node]
            # a home goes to its own side, and as a guest from inside to outside: that is where such a pair meets
            inside, outside = gap <= 0, gap > 0
            visit_in, visit_out = ~home & ~inside & (gap <= reach), (gap > -reach) & ~outside
            parts = [(inside, 0, home[inside]), (outside, 1, home[outside]),
                     (visit_in, 0, np.zeros(visit_in.sum(), bool)), (visit_out, 1, np.zeros(visit_out.sum(), bool))]
            who, node, home = (np.concatenate(x) for x in zip(*((who[m], 2 * node[m] + side, h) for m, side, h in parts), strict=True))
        return who, node, home


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked entries the smaller label; ``label`` maps each entry to its root before and after."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def forest(homes: np.ndarray, guests: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever homes and guests lie within reach of a home: (fingerprint, smallest of its group)."""
    fps = np.concatenate([homes, guests])
    label = np.arange(len(fps))
    for at in range(0, len(homes), BLOCK):
        block = homes[at: at + BLOCK]
        for other in range(at, len(fps), BLOCK):
            near = np.bitwise_count(block[:, None] ^ fps[None, other: other + BLOCK]) <= reach
            near &= label[at: at + len(block), None] != label[None, other: other + BLOCK]
            if near.any():
                a, b = np.nonzero(near)
                _hook(label, a + at, b + other)
    own = fps.view(np.int64)
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, label, own)
    least = least[label]
    linked = least != own
    return own[linked], least[linked]


def plant(fps: DataFrame, n: int, leaf: int = LEAF) -> Tree | None:
    """A tree with leaves of about ``leaf`` fingerprints, from at most SAMPLE fingerprints for a leaf (8 MB at most)."""
    depth = max(0, int(np.ceil(np.log2(max(1, min(n / leaf, MOST_LEAVES))))))
    if not depth:
        return None
    share = min(1.0, SAMPLE * (1 << depth) / n)
    rows = fps.where(F.shiftrightunsigned(F.xxhash64("fp"), 11) < int(share * (1 << 53))).select("fp").toArrow()
    return Tree(rows.column(0).to_numpy().astype(np.int64).view(np.uint64), depth)


def links(fps: DataFrame, n: int, reach: int = REACH) -> DataFrame:
    """(a, b), b < a: links that connect exactly the distinct fingerprints ``fps`` (column fp) that lie within reach."""
    tree = plant(fps, n)
    shared = fps.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64)
            who, node, home = shared.value.place(own.view(np.uint64), reach)
            for at in range(0, len(who), 1 << 17):
                cut = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(node[cut]), pa.array(own[who[cut]]), pa.array(home[cut])], ["leaf", "fp", "home"])

    def meet(group: pa.Table) -> pa.Table:
        own, home = group.column("fp").to_numpy().astype(np.int64), group.column("home").to_numpy()
        a, b = forest(np.sort(own[home]).view(np.uint64), own[~home].view(np.uint64), reach)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    if tree is None:
        dealt = fps.select(F.lit(1).cast("bigint").alias("leaf"), "fp", F.lit(True).alias("home"))
    else:
        dealt = fps.mapInArrow(deal, "leaf bigint, fp bigint, home boolean")
    return _shared_out(materialise(dealt, "simhash-dealt")).groupBy("leaf", "part").applyInArrow(meet, "a bigint, b bigint")


def _shared_out(dealt: DataFrame, most: int = MOST_COMPARISONS) -> DataFrame:
    """``dealt`` and part: a crowded leaf has several parts, each with a share of the homes and all others as guests.

    Every home is a home in one part, and meets everyone of its leaf there."""
    sizes = dealt.groupBy("leaf").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows"))
    crowded = sizes.where(F.col("homes") * F.col("rows") > most).select("leaf", F.ceil(F.col("homes") * F.col("rows") / most).cast("int").alias("parts"))
    crowded = materialise(crowded, "simhash-crowded")
    hint = F.broadcast if crowded.count() <= 2 * MOST_LEAVES else (lambda df: df)
    parts = F.coalesce("parts", F.lit(1))
    rows = dealt.join(hint(crowded), "leaf", "left").select(*dealt.columns, parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rows.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), "parts") == F.col("part"))).drop("parts")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of ``fps`` (doc_id, fp)."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("lead")), "simhash-distinct")
    n = distinct.count()
    roots = components(materialise(links(distinct.select("fp"), n), "simhash-links"))
    linked = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    linked = materialise(linked, "simhash-roots")
    heads = materialise(linked.groupBy("root").agg(F.min("lead").alias("component_id")), "simhash-heads")
    return materialise(linked.join(heads, "root").select("fp", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable), one row per row.

    All sides of the joins are tables, so that a fingerprint with very many rows can be split at run time."""
    fps = materialise(fingerprints(docs), "simhash-fps")
    return fps.join(classes(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
