import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinclock.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, words=5, top=2000, cover=100):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    out = []
    frequent = {(lang, p): a for (lang, p), a in f.items() if a >= least and len(p) > 1}
    for (lang, p), a in frequent.items():
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j, f[lang, p[:j]], f[lang, p[j:]]) for j in range(1, len(p)))
        if not any(g == lang and len(q) > len(p) and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), b in frequent.items()):
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    rows = []
    for lang in n:
        for rank, (_, score, a, p, left, right) in enumerate(sorted(r for r in out if r[0] == lang)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def prose(seed, n=60):
    r = random.Random(seed)
    fixed = ["new york city hall", "in order to", "Ein Satz ohne Sinn", "a a a a a a", "ÄÖ äö ß"]
    out = []
    for k in range(n):
        parts = [r.choice(fixed) if r.random() < 0.5 else " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 9))]
        text = "".join(p + r.choice([". ", ", ", " ", "\n", "\t", "!?", ";", "\r\n", "\x0b", " \x0c "]) for p in parts)
        out.append((k, text, r.choice(["en", "de", None])))
    return out


@pytest.mark.parametrize(("seed", "least", "words", "cover"), [(1, 3, 5, 100), (2, 8, 4, 100), (3, 5, 5, 60), (4, 2, 2, 100)])
def test_against_brute_force(spark, seed, least, words, cover):
    rows = prose(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, least, words, cover=cover)
    assert want and got(C.collocations(df, least, words, cover=cover)) == want


def test_joined_as_rows_and_sent_agree(spark):
    rows = prose(9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(C.collocations(df, 4, most_sent=0)) == got(C.collocations(df, 4)) == brute(rows, 4)


def test_many_buckets_and_short_runs_agree(spark, monkeypatch):
    rows = prose(12)
    monkeypatch.setattr(C, "BUCKET", 40)
    monkeypatch.setattr(C, "RUN", 20)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(C.collocations(df, 4)) == brute(rows, 4)


def test_ranks_are_cut_and_ties_follow_bytes(spark):
    rows = [(k, "b c. B d. ä z. a z. é y. Z q", "en") for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 4, top=3)
    assert len(want) == 3 and got(C.collocations(df, 4, top=3)) == want


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", 1, 9 * 10**15), ("en", "b", 1, 9 * 10**15), ("en", "a b", 2, 8 * 10**15)], "lang string, phrase string, k int, a bigint")
    totals = spark.createDataFrame([("en", 9 * 10**16)], "lang string, n bigint")
    real = C.frequent_phrases
    try:
        C.frequent_phrases = lambda *args: (phrases, totals)
        want = 1000 * 8 * 10**15 * 9 * 10**16 // (9 * 10**15) ** 2
        assert got(C.collocations(phrases)) == [("en", 1, "a b", 8 * 10**15, 9 * 10**15, 9 * 10**15, 9 * 10**16, want)]
    finally:
        C.frequent_phrases = real


def test_edges(clashing, edge_rows, empty):
    assert got(C.collocations(clashing, 2)) == brute([(r[0], r[1], r[2]) for r in edge_rows], 2)
    assert C.collocations(empty).count() == 0
    assert C.collocations(clashing.drop("lang"), 2).where("lang <> 'und'").count() == 0


def test_phrases_without_a_frequent_word(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(50))), "en")], SCHEMA)
    assert C.collocations(df, 2).count() == 0


def test_a_hot_phrase_and_a_long_text(spark):
    rows = [(k, "the same old words everywhere. " * (1 + k % 3), "en") for k in range(300)] + [(999, "x y z " * 40_000, "en")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("a", F.lit(1)).withColumn("k", F.lit("x"))
    assert got(C.collocations(df, 100)) == brute(rows, 100)


def test_a_frequent_phrase_is_told_once(spark, monkeypatch):
    """Not once for each batch that holds it."""
    from twinclock.session import materialise

    df = spark.createDataFrame([(k, "new york city. new york", "en") for k in range(400)], SCHEMA).repartition(4)
    monkeypatch.setattr(C, "bound_batches", lambda spark: None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        occ = materialise(C.occurrences(df), "test-at")
        often = materialise(C.phrase_counts(occ, 100, 2000), "test-often")
        told, real = [], type(occ).distinct
        monkeypatch.setattr(type(occ), "distinct", lambda self: told.append(self.count()) or real(self))
        assert sorted(r["a"] for r in C.phrase_parts(occ, often).collect()) == [400, 800]
        assert told == [2]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
