import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from twinclock.llm import simhash as S
from twinclock.llm.components import components


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k: k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    lead = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, f"{fps[k]:016x}", lead[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def near_copies(prose, n, seed=4):
    r = random.Random(seed)
    out = {}
    for k in range(n):
        if k % 4 and k > 4:
            words = out[r.randrange(k)].split()
            for _ in range(r.choice([0, 1, 1, 2])):
                words[r.randrange(len(words))] = "new"
            out[k] = " ".join(words)
        else:
            out[k] = prose(f"{seed}-{k}", r.choice([2, 30, 150, 400]))
    return out


def test_against_brute_force(docs, prose):
    rows = near_copies(prose, 240)
    want = brute(list(rows.items()))
    assert len({c for _, _, c in want}) < 200
    assert got(S.near_duplicates(docs(rows))) == want


def test_deep_trees_lose_no_link(docs, prose, monkeypatch):
    rows = near_copies(prose, 240, seed=9)
    monkeypatch.setattr(S, "LEAF", 4)
    monkeypatch.setattr(S, "BLOCK", 5)
    assert got(S.near_duplicates(docs(rows))) == brute(list(rows.items()))


def test_crowded_leaves_are_shared_and_lose_no_link(docs, prose, monkeypatch):
    rows = near_copies(prose, 160, seed=11)
    monkeypatch.setattr(S, "MOST_COMPARISONS", 500)
    assert got(S.near_duplicates(docs(rows))) == brute(list(rows.items()))
    monkeypatch.setattr(S, "LEAF", 40)
    assert got(S.near_duplicates(docs(rows))) == brute(list(rows.items()))


def test_tree_and_forest_against_all_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base[r.integers(0, 40, 200)] ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64)) for _ in range(3)] + [r.integers(0, 2**63, 300, dtype=np.uint64)]))
    tree = S.Tree(fps[::3], 5)
    who, leaf, home = tree.place(fps, 3)
    assert np.array_equal(np.sort(who[home]), np.arange(len(fps)))
    links = set()
    for n in np.unique(leaf):
        own = leaf == n
        a, b = S.forest(fps[who[own & home]], fps[who[own & ~home]], 3)
        links |= set(zip(a.tolist(), b.tolist(), strict=True))
    root = {int(f): int(f) for f in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    signed = fps.view(np.int64).tolist()
    want = {int(f): int(f) for f in signed}
    for a, b in zip(*np.nonzero(near), strict=True):
        assert find(signed[a]) == find(signed[b])
    assert sum(find(f) == f for f in signed) == len(set(_labels(near)))
    assert want


def _labels(near):
    label = np.arange(len(near))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_long_texts_are_whole(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(1000))
    monkeypatch.setattr(S, "CHUNK", 64)
    assert S.fingerprint(text.encode()) & (2**64 - 1) == fingerprint(text)


def test_edges(clashing, edge_rows, empty):
    assert got(S.near_duplicates(clashing)) == brute([r[:2] for r in edge_rows])
    assert S.near_duplicates(empty).count() == 0


def test_many_copies_make_no_pairs():
    fps = np.arange(3000, dtype=np.uint64)
    a, b = S.forest(fps, fps[:0], 64)
    assert len(a) == 2999 and set(b.tolist()) == {0}


def test_components(spark, rows):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (None, 3), (200, 199)], "a bigint, b bigint")
    want = [(k, 0) for k in range(1, 41)] + [(k, 100) for k in range(101, 160)] + [(200, 199)]
    assert rows(components(edges)) == sorted(want)
    assert components(edges.limit(0)).count() == 0
    assert components(edges.where(F.col("a") == F.col("b"))).count() == 0
