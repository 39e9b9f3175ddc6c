"""Operator 11: n-gram Jaccard join by signature trees.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two sets link when their Jaccard similarity is ``least``
hundredths or more. Equal sets are one class from the start. The join of the classes has three steps:

1. *Leaders.* Classes with a MinHash value in common are held against one of them; links found make first components.
   This step decides nothing: it spares the next one the pairs within large groups of near copies, since a pair that is
   connected already needs no link.
2. *Signature trees.* A class is dealt to the shards of its rarest tokens. Of n tokens, n - ceil(least n / 100) + 1 are enough for
   two linked sets to meet, and with k - 1 more they meet in k: a class that shares fewer with others has no link and is not
   sent. Tokens that one component has alone are left out, and the classes of a token stand under the smallest
   of them, so that tokens of the same passage send a class once. A shard's classes are the leaves of trees, one for each power
   of two in size. A node holds the
   OR-combined token bitmap of what lies under it, its range of sizes, of tokens and of components. A dual traversal, level by
   level, drops a pair of nodes whose sizes, bitmaps or components rule out a new link: two sets have at most as many tokens in
   common as the bitmaps have bits in common, plus the tokens that fell on an occupied bit.
3. *Verification.* What is left of the pairs is held against the whole sets.

Tokens frequent in a sample of documents count as less rare; the sample decides in which shard a pair meets, never whether it
does. A head of too many classes has shards of its own, one for each pair of blocks of its classes.

Defined results: without words or text a set is empty, linked with nothing, and the document is its own component. Rows of
one doc_id are documents each. A null doc_id is never the smallest unless its component has no other. Two different shingles,
or sets, of the same hash count as one: among a billion the odds that any two are, are 1 in 37.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock.llm.common import bound_batches, unit_hash
from twinclock.llm.components import components
from twinclock.session import materialise

LEAST, WORDS, LEADERS = 80, 5, 16
#: Bits of a bitmap for each token of a set, at least, and most bits; powers of two.
SPARSE, WIDEST = 4, 1 << 15
#: Tokens of a set to each that linked sets must share beyond the first.
SHARE = 32
#: Times that classes are left out for meeting others in too few tokens.
AGAIN = 1
#: MinHash values of LEADERS that a class has in common with its leader, at least.
ALIKE = 9
#: Entries of a shard or of a part of one; children of a node; bytes of bitmaps compared at a time.
CROWD, FAN, CHUNK_BYTES = 20_000, 8, 16 << 20
#: Pairs of nodes that are opened at a time.
BLOCK = 1 << 14
#: Documents sampled for frequent tokens, and documents of the sample that make a token frequent.
SAMPLE, FREQUENT = 4096, 8
#: Rows of ids, or of classes and their components, that are broadcast; more are joined.
MOST_SENT = 1_000_000
#: Tokens that are sent to all tasks, 8 bytes each; more are joined.
MOST_TOKENS = 4_000_000
#: Words a worker remembers.
MOST_WORDS = 300_000
#: Bytes of text whose words are held at a time, a longer text excepted.
WORD_BYTES = 1 << 20
_ODD, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, LEADERS, np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def batch_sets(texts: list[bytes | None], known: _Words, size: int = WORDS) -> list[np.ndarray]:
    """The set of each text: sorted distinct hashes of its shingles."""
    out, some, held = [], [], 0
    for t in texts:
        if some and held + len(t or b"") > WORD_BYTES:
            out += _sets_at_once(some, known, size)
            some, held = [], 0
        some.append(t)
        held += len(t or b"")
    return out + _sets_at_once(some, known, size)


def _sets_at_once(texts: list[bytes | None], known: _Words, size: int) -> list[np.ndarray]:
    # of bytes: A-Z and ASCII white space only
    words = [t.lower().split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    code = np.fromiter((known[x] for w in words for x in w), np.uint64, int(n.sum()))
    h = np.full(len(code), size, np.uint64)
    for k in range(size):
        m = max(0, len(code) - k)
        h[:m] = _stirred(h[:m]) * _STIR + code[len(code) - m:]
    h = _stirred(h)
    out, start = [], 0
    for many in n.tolist():
        own = h[start: start + max(0, many - size + 1)]
        if 0 < many < size:  # the whole sequence as one
            own = np.full(1, many, np.uint64)
            for k in range(many):
                own = _stirred(own) * _STIR + code[start + k]
            own = _stirred(own)
        own.sort()
        out.append(own[np.append(True, own[1:] != own[:-1])] if many else own)
        start += many
    return out


def name_of(own: np.ndarray) -> int:
    """The class of a set, as a long."""
    return xxhash.xxh64_intdigest(own.tobytes(), seed=len(own)) - (1 << 63)


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: between SPARSE n and 2 SPARSE n. A narrower one rules out less."""
    return max(64, min(WIDEST, SPARSE << n.bit_length()))


def bitmap(own: np.ndarray) -> bytes:
    width = width_of(len(own))
    bits = np.zeros(width, bool)
    bits[own & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def prefix_length(n: int, least: int) -> int:
    """First tokens of a set of n, in whatever common order. Of those of two linked sets as many are the same as the smaller set's
    n asks for: 1 and one more for SHARE of the tokens that they have in common at least."""
    least_common = -(least * n // -100)
    return n - least_common + 1 + least_common // SHARE


def _agreeing(least: int) -> Column:
    """Tokens that a class of ``n`` has in common with any linked one, of the first ones of both; the other set is no smaller than
    what they have in common."""
    return F.expr(f"1 + ({least} * (({least} * n + 99) div 100) + 99) div 100 div {SHARE}")


def _by_row(docs: DataFrame, rows: Callable[[], Callable[[list], list[pa.Array]]], columns: str) -> DataFrame:
    """A pass over the texts, batch by batch. ``rows`` runs once in a task; what it returns maps texts to the numbers of their
    rows, repeated for each row of the result, and the columns of it."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows()
        for batch in batches:
            at, values = each(batch.column("text").to_pylist())
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *values], ["doc_id", *(f"c{k}" for k in range(len(values)))])
    kind = dict(docs.dtypes)["doc_id"]
    names = [c.split()[0] for c in columns.split(", ")]
    types = [c.split()[1] for c in columns.split(", ")]
    schema = f"doc_id {kind}, " + ", ".join(f"c{k} {t}" for k, t in enumerate(types))
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema).toDF("doc_id", *names)


def frequent_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted tokens that FREQUENT of about SAMPLE documents have: at most their tokens / FREQUENT."""
    def rows():
        known = _Words()

        def each(texts):
            own = batch_sets(texts, known)
            token = np.concatenate([*own, np.empty(0, np.uint64)]).view(np.int64)
            return np.repeat(np.arange(len(own)), [len(s) for s in own]), [pa.array(token)]
        return each
    some = docs.where(unit_hash(F.col("doc_id").cast("string"), F.col("text")) < min(1.0, SAMPLE / max(1, n)))
    found = _by_row(some, rows, "token bigint").groupBy("token").count().where(F.col("count") >= FREQUENT)
    return np.sort(found.select("token").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def rare_first(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return own
    often = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
    return np.concatenate([own[~often], own[often]])


def sets(docs: DataFrame, frequent: np.ndarray, least: int) -> DataFrame:
    """doc_id, node (the class, null without words), n (size of the set), least (its MinHash values), bits (its bitmap), and
    rare: its rarest tokens, as many as it needs to meet whatever it links with."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows():
        known, often = _Words(), sent.value

        def each(texts):
            own = batch_sets(texts, known)
            node = pa.array([name_of(s) if len(s) else None for s in own], pa.int64())
            values = [_stirred(s ^ _SEEDS[:, None]).min(1).view(np.int64) if len(s) else None for s in own]
            rare = [rare_first(s, often)[:prefix_length(len(s), least)].view(np.int64) if len(s) else None for s in own]
            return np.arange(len(texts)), [node, pa.array([len(s) for s in own], pa.int64()), pa.array(values, pa.list_(pa.int64())),
                                           pa.array([bitmap(s) for s in own], pa.binary()), pa.array(rare, pa.list_(pa.int64()))]
        return each
    return _by_row(docs, rows, "node bigint, n bigint, least array<bigint>, bits binary, rare array<bigint>")


def leaders(own: DataFrame) -> DataFrame:
    """(a, b): classes and a class with which they have a MinHash value in common.

    Of a group with one value, that class leads whose values are shared most: where copies stem from one text, it is mostly
    that text, and near to all of them."""
    values = own.where("node is not null").select("node", F.posexplode("least").alias("k", "value")).distinct()
    sizes = values.groupBy("k", "value").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialise(values.join(sizes, ["k", "value"]), "jaccard-shared")
    score = shared.groupBy("node").agg(F.sum("size").alias("score"))
    ranked = shared.join(score, "node")
    heads = ranked.groupBy("k", "value").agg(F.max(F.struct("score", F.xxhash64("k", "node"), "node")).alias("head")).select("k", "value", "head.node")
    pairs = shared.join(heads.withColumnRenamed("node", "head"), ["k", "value"]).where("node <> head").select(
        F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
    least = own.where("node is not null").select("node", "least").distinct()
    side = lambda name: least.select(F.col("node").alias(name), F.col("least").alias(f"of_{name}"))
    alike = F.size(F.filter(F.zip_with("of_a", "of_b", lambda x, y: x == y), lambda same: same)) >= ALIKE
    return pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b")


def linked(docs: DataFrame, own: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Those of ``pairs`` (a, b; a written table) whose whole sets have the similarity. Only texts of these classes are read."""
    def rows():
        known = _Words()

        def each(texts):
            whole = batch_sets(texts, known)
            return np.arange(len(texts)), [pa.array([name_of(s) if len(s) else None for s in whole], pa.int64()), pa.array([s.tobytes() for s in whole], pa.binary())]
        return each

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= least * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    named = own.select("node", "doc_id").join(wanted, "node", "left_semi").groupBy("node", F.col("doc_id").alias("lead")).agg(F.count("*").alias("rows"))
    named = named.groupBy("node").agg(F.min(F.struct(F.col("lead").isNull(), F.col("lead"), F.col("rows"))).alias("first")).select("node", "first.lead", "first.rows")
    named = materialise(named, "jaccard-named")
    ids = named.select("lead").distinct()
    if named.count() <= MOST_SENT:
        ids, named = F.broadcast(ids), F.broadcast(named)
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("lead")), "left_semi")
    # a class is read from one of its documents; a document may have several rows
    found = _by_row(texts, rows, "node bigint, own binary").alias("f").join(named.alias("l"), (F.col("f.node") == F.col("l.node")) & F.col("doc_id").eqNullSafe(F.col("lead")))
    found = found.select("f.node", "own")
    if not named.where("rows > 1").isEmpty():
        found = found.dropDuplicates(["node"])
    found = materialise(found, "jaccard-sets")
    side = lambda name: found.select(F.col("node").alias(name), F.col("own").alias(f"set_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a bigint, b bigint").distinct()


class Level:
    """One level of a tree: OR-combined bitmaps and ranges, a row for each node. ``spare``: the most tokens of a set under the
    node that fell on a bit already set."""

    def __init__(self, bits, low, high, spare, token, root):
        self.bits, self.low, self.high, self.spare, self.token, self.root = bits, low, high, spare, token, root

    def __len__(self) -> int:
        return len(self.low)

    def above(self) -> Level:
        at = np.arange(0, len(self), FAN)
        least, most = (lambda x: np.minimum.reduceat(x, at)), (lambda x: np.maximum.reduceat(x, at))
        return Level(np.bitwise_or.reduceat(self.bits, at, axis=0), least(self.low), most(self.high), most(self.spare),
                     (least(self.token[0]), most(self.token[1])), (least(self.root[0]), most(self.root[1])))

    def narrowed(self, words: int) -> Level:
        """Bitmaps folded to ``words`` words. How many tokens then share a bit isn't known any more."""
        bits = self.bits
        if bits.shape[1] == words:
            return self
        while bits.shape[1] > words:
            half = bits.shape[1] // 2
            bits = bits[:, :half] | bits[:, half:]
        return Level(bits, self.low, self.high, self.high, self.token, self.root)


def plant(bits: np.ndarray, n: np.ndarray, token: np.ndarray, root: np.ndarray) -> list[Level]:
    """Levels of a tree from the leaves up; entries are in order of token."""
    levels = [Level(bits, n, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64), (token, token), (root, root))]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].above())
    return levels


def _possible(x: Level, y: Level, i: np.ndarray, j: np.ndarray, least: int, leaves: bool) -> np.ndarray:
    """Which pairs of nodes can hold a new link."""
    able = (x.token[0][i] <= y.token[1][j]) & (y.token[0][j] <= x.token[1][i])
    able &= (100 * x.high[i] >= least * y.low[j]) & (100 * y.high[j] >= least * x.low[i])
    able &= ~((x.root[0][i] == x.root[1][i]) & (y.root[0][j] == y.root[1][j]) & (x.root[0][i] == y.root[0][j]))
    at = np.flatnonzero(able)
    step = max(1, CHUNK_BYTES // (8 * x.bits.shape[1]))
    for k in range(0, len(at), step):
        part = at[k: k + step]
        u, v = i[part], j[part]
        a, b = x.bits[u], y.bits[v]
        if leaves:
            most = np.minimum(x.low[u] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), y.low[v] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
        else:
            most = np.bitwise_count(a & b).sum(1, dtype=np.int64) + np.minimum(x.spare[u], y.spare[v])
        able[part] = (100 + least) * most >= least * (x.low[u] + y.low[v])
    return able


def _children(i: np.ndarray, j: np.ndarray, x: Level, y: Level, same: bool) -> tuple[np.ndarray, np.ndarray]:
    grid = np.arange(FAN)
    a = np.repeat((i[:, None] * FAN + grid).ravel(), FAN)
    b = np.repeat(j[:, None] * FAN + grid, FAN, axis=0).ravel()
    real = (a < len(x)) & (b < len(y))
    if same:
        real &= a <= b
    return a[real], b[real]


def traverse(one: list[Level], two: list[Level], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves of two trees, or of one and itself, that may link. Goes down in blocks, deepest first, so that the pairs
    at hand stay few."""
    same = one is two
    words = min(t[0].bits.shape[1] for t in (one, two))
    one, two = ([level.narrowed(words) for level in t] for t in (one, two))
    for t, other in ((one, two), (two, one)):
        while len(t) < len(other):
            t.append(t[-1].above())
    stack = [(len(one) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        at, i, j = stack.pop()
        able = _possible(one[at], two[at], i, j, least, at == 0)
        i, j = i[able], j[able]
        if at == 0:
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        for k in range(0, len(i), BLOCK):
            stack.append((at - 1, *_children(i[k: k + BLOCK], j[k: k + BLOCK], one[at - 1], two[at - 1], same)))


def shard_pairs(group: pa.Table, least: int) -> pa.Table:
    """(a, b), b < a: classes of one shard under one head (its column is ``token``) that may link, by the trees' dual traversal. If
    the group has two sides, only pairs of one and the other."""
    token, node, n, root, side = (group.column(c).to_numpy() for c in ("token", "node", "n", "root", "side"))
    order = np.lexsort((node, n, token))
    token, node, n, root, side = (c[order] for c in (token, node, n, root, side))
    bits = group.column("bits").combine_chunks().take(pa.array(order))
    size = np.frexp(n.astype(np.float64))[1].astype(np.int64)
    trees, rows = {}, {}
    for s, e in np.unique(np.stack([side, size], 1), axis=0).tolist():
        own = rows[s, e] = np.flatnonzero((side == s) & (size == e))
        plain = np.frombuffer(b"".join(bits.take(pa.array(own)).to_pylist()), np.uint64).reshape(len(own), -1)
        trees[s, e] = plant(plain, n[own], token[own], root[own])
    mixed = side.min() != side.max()
    found = [np.empty((0, 2), np.int64)]
    for s, e in trees:
        for t, f in trees:
            # sizes of class e lie in [2^(e-1), 2^e)
            if least << (max(e, f) - 1) < 100 << min(e, f) and (s < t if mixed else e <= f):
                for i, j in traverse(trees[s, e], trees[t, f], least):
                    a, b = rows[s, e][i], rows[t, f][j]
                    new = (token[a] == token[b]) & (root[a] != root[b])
                    a, b = node[a[new]], node[b[new]]
                    found.append(np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})


def _of_tokens(classes: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Those of ``rows`` (node, n, root, token; the rare tokens of ``classes``) that have one of the tokens. Up to MOST_TOKENS
    tokens are sent to the rows, more are joined."""
    if shared.count() > MOST_TOKENS:
        return rows.join(shared, "token", "left_semi").select("token", "node", "n", "root")
    sent = classes.sparkSession.sparkContext.broadcast(np.sort(shared.toArrow().column(0).to_numpy().astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            rare = batch.column("rare")
            token = rare.flatten().to_numpy()
            met = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token if len(known) else np.zeros(len(token), bool)
            at = pa.array(np.repeat(np.arange(len(batch)), np.diff(rare.offsets.to_numpy()))[met])
            yield pa.RecordBatch.from_arrays([pa.array(token[met]), *(batch.column(c).take(at) for c in ("node", "n", "root"))], ["token", "node", "n", "root"])
    return classes.mapInArrow(run, "token bigint, node bigint, n bigint, root bigint")


def headed(met: DataFrame, least: int) -> DataFrame:
    """(band, head, node, n, root), each once: classes of different components that have a token in common, under the smallest
    class that has it too. A class has many tokens in common with others, mostly with the same ones, as shingles of one passage
    go together; under a head it stands, and is sent, once. Linked classes stand under one head of each token they share."""
    # linked sets lie in one band of sizes or in two next to each other, and meet in the upper one
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / least + 1e-9))).cast("int") if least < 100 else F.col("n").cast("int")
    met = met.withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    # a class that meets others in too few tokens is left out, which may leave its neighbours too few
    for step in range(AGAIN + 1):
        heads = met.groupBy("token", "band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("own").alias("top"), F.min("node").alias("head"))
        heads = materialise(heads.where("low <> high and top = band").select("token", "band", "head"), f"jaccard-apart-{step}")
        under = met.join(heads, ["token", "band"])
        if step < AGAIN:
            enough = under.groupBy("band", "node").agg(F.count("*").alias("common"), F.first("n").alias("n")).where(F.col("common") >= _agreeing(least))
            met = materialise(under.drop("head").join(enough.select("band", "node"), ["band", "node"], "left_semi"), "jaccard-agreeing")
    return under.select("band", "head", "node", "n", "root").distinct()


def candidates(own: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that the signature trees can't rule out."""
    sent = F.broadcast(roots) if roots.count() <= MOST_SENT else roots
    classes = own.where("node is not null").select("node", "n", "rare").join(sent, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), "rare")
    rows = classes.select("node", "n", "root", F.explode("rare").alias("token"))
    # a token that one component has alone leads to no new link
    shared = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    met = materialise(_of_tokens(classes, rows, materialise(shared, "jaccard-tokens")).distinct(), "jaccard-met")
    entries = materialise(headed(met, least), "jaccard-narrow")
    crowded = entries.groupBy("band", "head").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1")
    shards = max(1, -(-entries.count() // CROWD))
    entries = entries.join(materialise(crowded, "jaccard-crowded"), ["band", "head"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entries = entries.select(F.xxhash64("head", "band").alias("head"), "node", "n", "root", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("block"))
    # a crowded head has a shard for each pair of its blocks; all others share shards
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    alone = F.col("parts") == 1
    entries = entries.select(
        F.when(alone, F.pmod("head", F.lit(shards))).otherwise(F.col("head")).alias("shard"),
        F.when(alone, F.lit(-1)).otherwise(F.least("block", "other")).alias("first"), F.greatest("block", "other").alias("second"),
        (F.col("block") > F.col("other")).cast("bigint").alias("side"), F.col("head").alias("token"), "node", "n", "root")
    signs = own.select("node", "bits").join(entries.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    entries = materialise(entries.join(signs, "node"), "jaccard-entries")
    return entries.groupBy("shard", "first", "second").applyInArrow(lambda group: shard_pairs(group, least), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), one row per row."""
    own = materialise(sets(docs, frequent_tokens(docs, docs.count()), least), "jaccard-sets-of-rows")
    first = materialise(linked(docs, own, materialise(leaders(own), "jaccard-leaders"), least), "jaccard-first")
    roots = materialise(components(first), "jaccard-roots")
    more = materialise(candidates(own, roots, least), "jaccard-candidates")
    second = linked(docs, own, more, least)
    roots = components(materialise(first.unionByName(second), "jaccard-links"))
    rooted = own.select("doc_id", "node", "n").join(roots, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "jaccard-rooted-rows")
    heads = materialise(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("head")), "jaccard-heads")
    out = rooted.join(heads, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("component_id"))
