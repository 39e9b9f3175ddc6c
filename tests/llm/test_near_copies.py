"""Near copies of whole rows against all pairs of exact sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from twinclock.llm import exact_dedup
from twinclock.llm import near_copies as N
from twinclock.llm.common import table


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    own = words(text)
    return {" ".join(own[k: k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def alike(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def groups(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(sets)):
        for b in range(a):
            if find(a) != find(b) and alike(sets[a], sets[b]):
                root[find(a)] = find(b)
    out = {}
    for k in range(len(sets)):
        out.setdefault(find(k), []).append(k)
    return list(out.values())


def survivors(rows):
    """doc_id of the row that stays of each group of (doc_id, text)."""
    return [min((rows[k][0] for k in own), key=lambda i: (i is None, i or 0)) for own in groups([t for _, t in rows])]


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def edited(prose, n, seed):
    r = random.Random(seed)
    out = {}
    for k in range(n):
        own = prose(k, r.randint(3, 200)).split()
        if k % 3 and k > 3:
            own = out[r.randrange(k)].split()
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = "edited"
        out[k] = " ".join(own)
    return out


def test_nothing_is_lost_within_the_widest_reach(spark, docs, prose):
    texts = edited(prose, 240, 1)
    want = sorted(survivors(list(texts.items())), key=str)
    assert ids(N.drop_near_copies(docs(texts), reach=64)) == want
    assert ids(N.drop_near_copies(docs(texts), reach=64, leaf=40)) == want


def test_leaves_and_bands_meet_all_pairs_within_reach(spark, docs, prose):
    texts = edited(prose, 240, 2)
    marks = {t: N.mark(t.encode()) for t in texts.values()}
    want = set()
    for a in marks.values():
        for b in marks.values():
            near = any(((x ^ y) & (2**64 - 1)).bit_count() <= N.REACH for x, y in zip(a[0], b[0], strict=True))
            if a[2] < b[2] and near and 100 * min(a[1], b[1]) >= 80 * max(a[1], b[1]):
                want.add((a[2], b[2]))
    rows = sorted({(m[2], tuple(m[0]), m[1]) for m in marks.values()})
    nodes = spark.createDataFrame(rows, "key bigint, fps array<bigint>, size bigint")
    got = set()
    by_leaf = {}
    for r in N._deal(nodes, len(rows), N.REACH, 30).collect():
        by_leaf.setdefault(r["leaf"], []).append(r)
    for own in by_leaf.values():
        own.sort(key=lambda r: not r["home"])
        key, fp, size = (np.array([r[c] for r in own], np.int64) for c in ("key", "fp", "size"))
        a, b = N.candidates(key, fp, size, key, sum(r["home"] for r in own), False, N.REACH)
        got |= {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == want


def test_recall_on_the_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")
    frame = exact_dedup.drop_duplicates(table(spark, folder, "documents"))
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    want = len(rows) - len(survivors(rows))
    assert want
    kept = N.drop_near_copies(frame)
    gone = len(rows) - kept.count()
    assert 0.9 * want <= gone <= want


def test_rows_with_repeated_and_null_ids(spark, prose):
    a, b = prose(1, 100), prose(2, 100)
    near = b.split()
    near[50] = "other"
    rows = [(3, b, "x"), (5, a, "x"), (5, " ".join(near), "x"), (None, "one two", "x"), (None, "One  two", "y"), (None, "one two", "z"), (7, a, "x")]
    kept = N.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string, row string"))
    assert kept.columns == ["doc_id", "text", "row"]
    got = sorted(map(tuple, kept.collect()), key=str)
    assert [r[:2] for r in got if r[0]] == [(3, b), (5, a)] and sum(r[0] is None for r in got) == 1


def test_edges(clashing, edge_rows, empty):
    kept = N.drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    assert ids(kept) == sorted(survivors([r[:2] for r in edge_rows]), key=str)
    assert N.drop_near_copies(empty).count() == 0


def test_long_texts_are_whole(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(1000)).encode()
    whole = N.mark(text)
    monkeypatch.setattr(N, "CHUNK", 64)
    assert N.mark(text) == whole and whole[1] == len(shingle_set(text.decode()))


def test_pairs_of_one_class_are_not_written():
    n = 2000
    key, fp, size, root = np.arange(n), np.zeros(n, np.int64), np.full(n, 9), np.zeros(n, np.int64)
    assert len(N.candidates(key, fp, size, root, n, False, N.REACH)[0]) == 0
    assert len(N.candidates(key, fp, size, key, n, True, N.REACH)[0]) == n


def unlike(n, shared=30, own=20):
    """Texts whose fingerprints lie near each other while no two sets have the similarity."""
    base = [f"c{k}" for k in range(shared)]
    return {k: " ".join(base + [f"own{k}x{i}" for i in range(own)]) for k in range(n)}


def test_pairs_within_reach_that_are_not_alike_are_not_written(spark, docs, monkeypatch):
    n, rows = 60, []
    kept = N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, name: rows.append((name, (out := kept(df, name)).count())) or out)
    texts = unlike(n)
    texts[n] = texts[7] + " more"
    assert ids(N.drop_near_copies(docs(texts), reach=64)) == sorted(range(n), key=str)
    # every document meets every other for each fingerprint; rows grow with documents, not with pairs
    assert max(many for name, many in rows if name.startswith(("near-pairs", "near-links", "near-members"))) <= 2 * N.PRINTS * (n + 1)


def test_blocks_of_a_crowded_leaf_lose_no_link(spark, docs, prose, monkeypatch):
    texts = edited(prose, 120, 3)
    want = sorted(survivors(list(texts.items())), key=str)
    monkeypatch.setattr(N._tested_in_place, "__defaults__", (4000,))
    monkeypatch.setattr(N, "_linked", lambda pairs, nodes, keyed: pairs.where("false"))
    assert ids(N.drop_near_copies(docs(texts), reach=64)) == want


@pytest.mark.parametrize(("crowd", "few"), [(0, N.FEW), (0, 2), (1500, 5)])
def test_crowded_bands_lose_no_link(spark, docs, prose, monkeypatch, crowd, few):
    texts = edited(prose, 160, 4)
    want = sorted(survivors(list(texts.items())), key=str)
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "SIGN_LEAF", 50)
    assert ids(N.drop_near_copies(docs(texts), reach=64, crowd=crowd)) == want
    monkeypatch.setattr(N._tested_in_place, "__defaults__", (4000,))
    monkeypatch.setattr(N, "_linked", lambda pairs, nodes, keyed: pairs.where("false"))
    assert ids(N.drop_near_copies(docs(texts), reach=64, crowd=crowd)) == want


def test_a_crowded_band_keeps_the_reach(spark, docs, prose):
    texts = edited(prose, 160, 5)
    for reach in (3, N.REACH):
        assert ids(N.drop_near_copies(docs(texts), reach=reach, crowd=0)) == ids(N.drop_near_copies(docs(texts), reach=reach))


def test_comparisons_do_not_grow_with_the_square(spark, docs, prose, monkeypatch):
    compared = []

    def kept(df, name, keep=N.materialise):
        out = keep(df, name)
        if name == "near-met":
            leaves = out.groupBy("leaf", "part").agg(F.count_if("home").alias("homes"), F.count("*").alias("n"))
            compared.append(leaves.agg(F.sum(F.col("homes") * F.col("n"))).first()[0] or 0)
        return out
    monkeypatch.setattr(N, "materialise", kept)
    for n in (100, 400):
        texts = {k: prose(k, 100) for k in range(n)} | {n: prose(7, 100) + " more"}
        assert ids(N.drop_near_copies(docs(texts), crowd=20_000)) == sorted(range(n), key=str)
    assert compared[1] <= 4 * compared[0]


def test_signs_give_the_candidates_of_each_sign(prose):
    marks = [N.mark(t.encode()) for t in edited(prose, 90, 6).values()]
    fp, size, key = (np.array([m[k] for m in marks], np.int64) for k in range(3))
    r = np.random.default_rng(1)
    who, sign = r.integers(0, 90, 400), r.integers(0, 40, 400)
    root, homes = key // 3, 300
    for nearest in (True, False):
        want = set()
        for s in range(40):
            own = np.flatnonzero(sign == s)
            at = who[own]
            a, b = N.candidates(key[at], fp[at], size[at], root[at], int((own < homes).sum()), nearest, 30)
            want |= set(zip(a.tolist(), b.tolist(), strict=True))
        got = N.candidates(key[who], fp[who], size[who], root[who], homes, nearest, 30, sign)
        assert want and set(zip(*(x.tolist() for x in got), strict=True)) == want


def test_signs_of_alike_sets():
    r = np.random.default_rng(2)
    shared = []
    for _ in range(300):
        own = r.integers(0, 2**64, 100, dtype=np.uint64)
        shared.append(int((N.signs(np.sort(own[:90])) == N.signs(np.sort(own[10:]))).sum()))
    # of similarity 0.8: binomial, 28 times 0.64
    assert min(shared) >= 6 and abs(np.mean(shared) - 17.92) < 0.6 and 4.5 < np.var(shared) < 8.5
    assert not (N.signs(own[:50]) == N.signs(own[50:])).any()


def test_a_pair_that_shares_many_signs_is_sent_once(spark, docs, prose, monkeypatch):
    asked, kept = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, name: (out := kept(df, name), name == "near-members" and asked.append(out.count()))[0])
    text = prose(1, 200).split()
    texts = {1: " ".join(text), 2: " ".join(text[:160] + ["other"] * 40)}
    assert ids(N.drop_near_copies(docs(texts), reach=64, crowd=0)) == [1, 2]
    assert asked[0] > 2 and asked[1] == 2
