import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinclock.llm import mixing as M


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
        if p < 1e-300:
            break
    return k


def draw(doc_id):
    text = f"{M.SEED}|{'' if doc_id is None else doc_id}"
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def brute(rows, weights=None, total=None):
    sizes = Counter(r[3] for r in rows)
    w = {s: 1.0 for s in sizes} if weights is None else {s: v for s, v in weights.items() if s in sizes and v is not None and v > 0}
    total = len(rows) if total is None else total
    out = []
    for r in rows:
        if r[3] in w:
            k = poisson(total * w[r[3]] / sum(w.values()) / sizes[r[3]], draw(r[0]))
            out += [(r[0], c) for c in range(1, k + 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["copy"]) for r in df.collect()), key=str)


def test_edges(clashing, edge, edge_rows, empty, spark):
    out = M.mix(clashing, total=60.0)
    assert got(out) == brute(edge_rows, total=60.0)
    assert set(out.columns) == set(clashing.columns) and set(M.mix(edge).columns) == {*edge.columns, "copy", "mix_key"}
    assert M.mix(empty).count() == 0
    none = spark.createDataFrame([("a", 0.0), ("zz", 3.0), ("b", None), (None, -1.0)], "source string, weight double")
    assert M.mix(edge, none).count() == 0


def test_weights(spark, edge, edge_rows):
    weights = {"a": 3.0, "b": 1.0, None: 0.5, "unused": 9.0, "c": 0.0}
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    assert got(M.mix(edge, table, 200.0)) == brute(edge_rows, weights, 200.0)


def test_shares_and_hot_source(docs, spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 8).cast("string"))).alias("source"), F.lit(1).alias("n_chars"))
    n = Counter(r["source"] for r in M.mix(df, total=9000.0).collect())
    assert all(abs(v - 1000) < 6 * math.sqrt(1000) for v in n.values()) and len(n) == 9


def test_large_rates(spark, docs):
    rows = [(k, "t", "en", "rare", 1) for k in range(3)]
    df = docs(["t"] * 3).withColumn("source", F.lit("rare"))
    n = M.mix(df, total=9000.0).groupBy("doc_id").count().collect()
    assert all(abs(r["count"] - 3000) < 400 for r in n) and len(n) == len(rows)


def test_salted_join_gives_the_same(edge, monkeypatch):
    want = got(M.mix(edge, total=80.0))
    monkeypatch.setattr(M, "BROADCAST_NUMBERS", 0)
    assert got(M.mix(edge, total=80.0)) == want


def test_order_is_shuffled_and_repeatable(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    a, b = ([r["doc_id"] for r in M.mix(df).collect()] for _ in range(2))
    assert a == b and a != sorted(a) and M.mix(df, seed=1).count() != len(a)


def test_native(edge):
    plan = M.mix(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("rate", [0.001, 0.5, 1.0, 7.3, 100.0])
def test_quantiles(spark, rate):
    cdf = M.quantiles(spark.createDataFrame([("s", rate)], "source string, rate double")).first()["cdf"]
    p, c = math.exp(-rate), 0.0
    for k, value in enumerate(cdf):
        c += p
        p *= rate / (k + 1)
        assert value == pytest.approx(c, rel=1e-9)
