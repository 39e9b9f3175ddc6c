import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinclock.llm import periodic as P
from twinclock.llm import queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=P.LEAST):
    """Every period, every maximal stretch; a stretch that a smaller period explains is left out."""
    seen = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                seen.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def found(df):
    return [(r[0], [tuple(x) for x in r[1]], r[2]) for r in df.select("doc_id", "runs", "collapsed_text").collect()]


def check(rows, df, least=P.LEAST):
    want = [(i, r := brute(words(t), least), collapse(words(t), r)) for i, t in rows]
    assert sorted(found(df), key=str) == sorted(want, key=str)


def texts(seed, n=150):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, 6)):
            unit = [r.choice("abcd") for _ in range(r.randint(1, 9))]
            w += unit * r.randint(1, 6) + unit[:r.randint(0, len(unit))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("least", [2, 3, 5, 12, 31])
def test_against_brute_force(docs, least):
    rows = texts(least)
    check(list(enumerate(rows)), P.periodic_runs(docs(rows), least), least)


def test_words_of_two_letters_of_fibonacci_shape(docs):
    a, b = ["x"], ["x", "y"]
    while len(b) < 600:
        a, b = b, b + a
    rows = [" ".join(b), " ".join(["z"] * 500), " ".join((["u"] * 20 + ["v"]) * 15), " ".join(map(str, range(400)))]
    check(list(enumerate(rows)), P.periodic_runs(docs(rows)))


def test_edges(clashing, edge_rows, empty):
    check([r[:2] for r in edge_rows if r[0] not in (4, 5)], P.periodic_runs(clashing).where("doc_id not in (4, 5) or doc_id is null"))
    assert P.periodic_runs(empty).count() == 0
    long = {r[0]: r for r in found(P.periodic_runs(clashing)) if r[0] in (4, 5)}
    assert long[4][1] == long[5][1] == [(0, 60_000, 977)] and len(long[4][2].split()) == 977


def test_very_long_runs_stay_fast():
    for unit in (1, 3, 20_001):
        word = np.arange(400_000) % unit
        assert P.find_runs(word, np.full(len(word), len(word))) == [(0, 400_000, unit)]


def test_refuses_shorter_runs(docs):
    with pytest.raises(ValueError):
        P.periodic_runs(docs(["a"]), 1)


def test_drop_repetition_keeps_the_rest(clashing):
    out = P.drop_repetition(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[7] == "one  two\nthree" and rows[1] is None and rows[4] == " ".join(f"word{k}" for k in range(977))


def test_query_on_planted_runs(spark, tmp_path):
    import zlib

    rows = [(k, t) for k, t in enumerate(texts(77, 120) + [None, "", " \n"] + [" ".join(f"w{j}" for j in range(n)) for n in range(1, 60)])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in rows:
        w, h = words(t), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i] = (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapse(w, runs)))
    out = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in out.collect()} == want
    assert dict(out.dtypes)["n_runs"] == "bigint" and out.agg(F.max("n_runs")).first()[0] > 1
