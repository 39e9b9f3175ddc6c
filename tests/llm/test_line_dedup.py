import hashlib
import random
import re

from pyspark.sql import functions as F

from twinclock.llm import line_dedup as L


def key(line):
    line = re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(rows):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in holders or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    out = df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h"))
    return sorted(map(tuple, out.collect()), key=str)


def texts(n, seed):
    r = random.Random(seed)
    pool = [f"common line {k} of them" for k in range(12)] + ["short", "", " \t", "  Common LINE 3 of them\t", "ÄÖÜ äöü ßßß x", "12345678 9", "123456789", "\r", "trailing\r"]
    return {k: "\n".join(r.choice(pool) if r.random() < 0.6 else f"own line {k} {j}" for j in range(r.randint(0, 9))) for k in range(n)}


def test_against_brute_force(docs):
    rows = texts(120, 5)
    for batches in (1, 2, 7):
        assert got(L.dedup_lines(docs(rows), batches=batches)) == brute(list(rows.items()))


def test_edges(spark, clashing, edge_rows, empty):
    assert got(L.dedup_lines(clashing)) == brute([r[:2] for r in edge_rows])
    assert L.dedup_lines(empty).count() == 0
    rows = [(1, "a line of text\nb"), (1, "other text here\na line of text"), (2, "A LINE OF TEXT\nother text here"), (None, "a line of text"), (3, "a line of text\n"), (3, "a line of text\n")]
    assert got(L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_hot_line(docs):
    rows = {k: ("the same line everywhere\n" if k % 3 else "") + f"a line of {k // 2} here" for k in range(2500)}
    assert got(L.dedup_lines(docs(rows))) == brute(list(rows.items()))


def test_hot_and_cold_paths_agree(docs, monkeypatch):
    rows = texts(60, 8)
    want = brute(list(rows.items()))
    for hot in (1, 10_000):
        monkeypatch.setattr(L, "HOT", hot)
        assert got(L.dedup_lines(docs(rows))) == want


def test_runs_are_compacted_and_disjoint(spark, docs):
    runs = L.LineRuns(spark, 4)
    rows = texts(90, 2)
    L.dedup_lines(docs(rows), runs, batches=9)
    assert len(runs.levels) >= 2 and all(len(level) < L.FANOUT for level in runs.levels)
    seen = runs.read()
    assert seen.count() == seen.select("key").distinct().count()


def test_a_later_batch_meets_the_runs_of_an_earlier_one(spark, docs):
    runs = L.LineRuns(spark, 4)
    L.dedup_lines(docs({1: "a line seen before\nx"}), runs).count()
    out = {r["doc_id"]: r["kept_text"] for r in L.dedup_lines(docs({5: "new\nA line seen before", 6: "a line not seen"}), runs).collect()}
    assert out == {5: "new", 6: "a line not seen"}


def test_a_later_call_with_smaller_ids_drops_what_the_runs_hold(spark, docs):
    runs = L.LineRuns(spark, 4)
    L.dedup_lines(docs({5: "a line seen before\nx"}), runs).count()
    out = {r["doc_id"]: r["kept_text"] for r in L.dedup_lines(docs({1: "new\nA line seen before", 5: "a line seen before"}), runs).collect()}
    assert out == {1: "new", 5: "a line seen before"}


def test_runs_are_read_without_a_shuffle(spark):
    runs = L.LineRuns(spark, 4)
    first = spark.range(50).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("key"), F.col("id").alias("keeper"))
    runs.add(first)
    plan = first.join(runs.runs()[0].hint("merge"), "key", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
