import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from twinclock.llm import signature_tree as S
from twinclock.llm.common import table

SCHEMA = "doc_id bigint, text string"


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def links(rows, least=80):
    own = [tokens(t) for _, t in rows]
    held = {}
    for k, s in enumerate(own):
        for x in s:
            held.setdefault(x, []).append(k)
    out = []
    for k, s in enumerate(own):
        shared = {}
        for x in s:
            for j in held[x]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        out += [(j, k) for j, both in shared.items() if 100 * both >= least * (len(s) + len(own[j]) - both)]
    return out


def brute(rows, least=80):
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for j, k in links(rows, least):
        root[find(k)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least_id = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return sorted(((i, len(tokens(t)), least_id[find(k)]) for k, (i, t) in enumerate(rows)), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near(seed, n=80, most=6):
    """Groups of copies with a few words changed, around the bound of similarity."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        w = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([3, 5, 6, 12, 40, 90, 300, 1000]))]
        for _ in range(r.randint(1, 5)):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(v) // 25))):
                v[r.randrange(len(v))] = f"x{r.randint(0, 5000)}"
            if r.random() < 0.3:
                v = v[:max(1, int(len(v) * r.uniform(0.75, 1)))]
            rows.append(" ".join(v))
    r.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize(("seed", "least"), [(1, 80), (2, 80), (3, 50), (4, 95)])
def test_against_brute_force(spark, seed, least):
    rows = near(seed)
    want = brute(rows, least)
    assert len({c for _, _, c in want}) < len(want)
    assert got(S.near_duplicates(spark.createDataFrame(rows, SCHEMA), least)) == want


def test_trees_alone_find_all_links(spark, monkeypatch):
    """Without leaders, in many small shards, with crowded tokens in blocks and names joined in place of sent."""
    rows = near(5)
    want = brute(rows)
    monkeypatch.setattr(S, "leaders", lambda own: own.sparkSession.createDataFrame([], "a bigint, b bigint"))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(S.near_duplicates(df)) == want
    monkeypatch.setattr(S, "CROWD", 3)
    monkeypatch.setattr(S, "MOST_SENT", 0)
    monkeypatch.setattr(S, "MOST_TOKENS", 0)
    monkeypatch.setattr(S, "FREQUENT", 2)
    assert got(S.near_duplicates(df)) == want


def test_traversal_loses_no_pair():
    r = random.Random(8)
    for least in (50, 80, 90):
        sets = []
        for _ in range(40):
            base = {r.getrandbits(64) for _ in range(r.choice([1, 3, 20, 70, 130]))}
            for _ in range(4):
                own = {x for x in base if r.random() < 0.97} | {r.getrandbits(64) for _ in range(r.randint(0, 3))}
                sets.append(np.array(sorted(own or base), np.uint64))
        rows = [(7, k, len(s), k, k % 2, S.bitmap(s)) for k, s in enumerate(sets)]
        for sides in (False, True):
            cols = list(zip(*rows, strict=True))
            group = pa.table({"token": cols[0], "node": cols[1], "n": cols[2], "root": cols[3], "side": cols[4] if sides else [0] * len(rows), "bits": pa.array(cols[5], pa.binary())})
            found = set(zip(*S.shard_pairs(group, least).to_pydict().values(), strict=True))
            every = {(a, b) for a in range(len(sets)) for b in range(a) if not sides or a % 2 != b % 2}
            alike = {(a, b) for a, b in every if 100 * len(both := set(sets[a].tolist()) & set(sets[b].tolist())) >= least * (len(sets[a]) + len(sets[b]) - len(both))}
            assert alike and alike <= found <= every and len(found) < len(every) / 4


def test_connected_classes_are_left_out():
    s = np.arange(50, dtype=np.uint64)
    group = pa.table({"token": [1] * 30, "node": list(range(30)), "n": [50] * 30, "root": [0] * 29 + [29], "side": [0] * 30, "bits": pa.array([S.bitmap(s)] * 30, pa.binary())})
    assert S.shard_pairs(group, 80).num_rows == 29


def test_prefixes_of_linked_sets_meet():
    r = random.Random(3)
    often = np.sort(np.array([r.getrandbits(64) for _ in range(200)], np.uint64))
    for _ in range(500):
        n = r.randint(1, 60)
        a = set(r.sample(often.tolist(), r.randint(0, n))) | {r.getrandbits(64) for _ in range(r.randint(1, n))}
        b = {x for x in a if r.random() < 0.9} | {r.getrandbits(64) for _ in range(r.randint(0, n // 8 + 1))}
        if 100 * len(a & b) >= 80 * len(a | b):
            first = [set(S.rare_first(np.array(sorted(x), np.uint64), often)[:S.prefix_length(len(x), 80)].tolist()) for x in (a, b)]
            assert first[0] & first[1]


def test_edges(spark, clashing, edge_rows, empty):
    assert got(S.near_duplicates(clashing)) == brute([r[:2] for r in edge_rows])
    assert S.near_duplicates(empty).count() == 0
    rows = [(None, "a b c"), (None, "A  b c"), (4, "a B c"), (4, "a b d"), (4, "a b d"), (None, "x"), (9, None), (9, "")]
    assert got(S.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_repeated_rows_are_read_once(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(1, text)] * 300 + [(2, text + " more words")] * 300 + [(3, text + " other words")] * 300
    out = got(S.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert len(out) == 900 and sorted(set(out)) == brute(rows[::300])


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "one two three four five six"), ("a", "One two three four five six"), ("c", "no")], "doc_id string, text string")
    assert {r[0]: r[2] for r in got(S.near_duplicates(df))} == {"a": "a", "b": "a", "c": "c"}


def test_query_on_the_smallest_table(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = S.near_duplicates(docs.withColumn("node", F.lit(1)))
    assert got(out) == brute(rows)


def test_words_of_few_texts_are_held_at_a_time(monkeypatch):
    r = random.Random(5)
    texts = [None, "", *[" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 300))).encode() for _ in range(40)], None]
    texts = [t if t else None for t in texts]
    whole = S.batch_sets(texts, S._Words())
    held, real = [], S._sets_at_once
    monkeypatch.setattr(S, "WORD_BYTES", 500)
    monkeypatch.setattr(S, "_sets_at_once", lambda some, *a: held.append([len(t or b"") for t in some]) or real(some, *a))
    parts = S.batch_sets(texts, S._Words())
    assert [x.tolist() for x in parts] == [x.tolist() for x in whole] and len(parts) == len(texts)
    assert len(held) > 5 and all(sum(x) <= 500 or sum(map(bool, x)) == 1 for x in held)


def test_tokens_of_one_passage_have_one_list(spark, monkeypatch):
    """Three texts, half of each the same: they meet in some dozens of tokens, but a class goes once to the shards for each list
    of classes."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**9)}"
    passage = [word() for _ in range(300)]
    rows = [(k, " ".join(passage + [word() for _ in range(300)])) for k in range(3)]
    tables, real = {}, S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, name: tables.setdefault(name, real(df, name)))
    assert got(S.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert tables["jaccard-met"].count() > 40
    # lists of two or all three classes: four at most
    assert 0 < tables["jaccard-entries"].count() <= 9


def passages(seed, n, own):
    """Texts with one passage in common, of which too little to link them."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**9)}"
    passage = [word() for _ in range(300)]
    return [(k, " ".join(passage + [word() for _ in range(own)])) for k in range(n)]


def test_classes_stand_once_under_a_head(spark, monkeypatch):
    """Seven texts meet in some dozens of tokens, each of which other ones of them have: many lists, few heads."""
    rows = passages(4, 7, 300)
    tables, real = {}, S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, name: tables.setdefault(name, real(df, name)))
    assert got(S.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert tables["jaccard-met"].count() > 100
    # a class stands under itself and smaller ones only: 7 * 8 / 2 in a band
    assert 0 < tables["jaccard-entries"].count() <= 28


def test_tokens_of_one_component_are_not_sent(spark, monkeypatch):
    """Near copies that the leaders connect share tokens with each other and with no one else."""
    r = random.Random(6)
    rows = []
    for _ in range(4):
        w = [f"w{r.randrange(10**9)}" for _ in range(300)]
        rows += [(len(rows) + k, " ".join([*w[:150], f"x{k}", *w[150:]])) for k in range(4)]
    tables, real = {}, S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, name: tables.setdefault(name, real(df, name)))
    want = brute(rows)
    assert len({c for _, _, c in want}) == 4
    assert got(S.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == want
    assert tables["jaccard-first"].count() >= 12 and tables["jaccard-met"].count() == 0


def test_linked_sets_agree_in_as_many_first_tokens(spark):
    """Sets at the bound of similarity, of equal and of unequal sizes."""
    r = np.random.default_rng(8)
    asked = spark.createDataFrame([(n,) for n in range(1, 1100)], "n bigint")
    for least in (50, 80, 100):
        need = {n: k for n, k in asked.select("n", S._agreeing(least)).collect()}
        for n in [*range(1, 60), 161, 320, 500]:
            for m in {n, 100 * n // least}:
                both = next(b for b in range(n + 1) if 100 * b >= least * (n + m - b))
                whole = r.permutation(n + m - both)
                a, b = whole[:n], np.append(whole[:both], whole[n:])
                x, y = (set(np.sort(s)[:S.prefix_length(len(s), least)].tolist()) for s in (a, b))
                assert len(x & y) >= max(need[len(a)], need[len(b)])


def test_classes_that_share_a_token_by_chance_are_not_sent(spark, monkeypatch):
    """Every text has a few shingles of each of the next two; one pair of near copies is found all the same."""
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**9)}"
    common = [[word() for _ in range(6)] for _ in range(26)]
    rows = [(k, " ".join([x for c in common[k: k + 3] for x in [*c, *(word() for _ in range(130))]])) for k in range(24)]
    rows.append((24, " ".join(x if k % 45 else word() for k, x in enumerate(rows[7][1].split()))))
    tables, real = {}, S.materialise

    def latest(df, name):
        tables[name] = real(df, name)
        return tables[name]
    monkeypatch.setattr(S, "materialise", latest)
    # no leaders, so that the trees find the pair
    monkeypatch.setattr(S, "ALIKE", S.LEADERS + 1)
    want = brute(rows)
    assert len({c for _, _, c in want}) == 24
    assert got(S.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == want
    assert tables["jaccard-met"].count() > 20
    assert {n for n, in tables["jaccard-entries"].select("node").distinct().collect()} == {n for p in tables["jaccard-links"].collect() for n in p}
