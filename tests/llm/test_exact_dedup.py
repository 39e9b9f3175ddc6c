import hashlib
import re

from twinclock.llm import exact_dedup as E
from twinclock.session import new_table_path


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((r[0], keep[norm(r[1])], len(groups[norm(r[1])]), r[0] == keep[norm(r[1])], hashlib.sha256(norm(r[1]).encode()).digest()) for r in rows), key=str)


def decided(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) for r in df.collect()), key=str)


def test_edges(clashing, edge_rows, empty):
    assert decided(E.decide(clashing, E.new_index(clashing))) == brute(edge_rows)
    assert E.decide(empty, E.new_index(empty)).count() == 0


def test_hot_group(docs, prose):
    texts = {k: "the same text" if k % 3 == 0 else prose(k, 3, ("ab", "cd")) for k in range(3000)}
    df = docs(texts)
    assert decided(E.decide(df, E.new_index(df))) == brute([(k, t) for k, t in texts.items()])


def test_hot_and_cold_paths_agree(docs, prose, monkeypatch):
    texts = {k: prose(k % 40, 3) for k in range(200)}
    df, want = docs(texts), brute(list(texts.items()))
    for hot in (1, 10_000):
        monkeypatch.setattr(E, "HOT", hot)
        assert decided(E.decide(df, E.new_index(df))) == want


def test_index_persists_and_only_new_digests_are_appended(spark, docs):
    path = new_table_path(spark, "index")
    first = E.DigestIndex(spark, path, 4)
    a = E.decide(docs({5: "x", 6: "y y", 7: "x"}), first)
    assert {(r["doc_id"], r["keep_id"]) for r in a.collect()} == {(5, 5), (6, 6), (7, 5)}
    again = E.DigestIndex(spark, path, 4)  # opened anew from its folder
    b = E.decide(docs({1: "x", 2: "z", 3: "y\ty"}), again)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in b.collect()} == {(1, 5, False), (2, 2, True), (3, 6, False)}
    assert again.read().count() == 3
    packed = again.compact(new_table_path(spark, "index"))
    assert sorted(map(tuple, packed.read().collect())) == sorted(map(tuple, again.read().collect()))


def test_anti_join_does_not_shuffle_the_index(spark, docs):
    index = E.DigestIndex(spark, new_table_path(spark, "index"), 4)
    E.decide(docs({1: "a"}), index)
    groups = spark.range(100).selectExpr("sha2(string(id), 256) as h").selectExpr("unhex(h) as digest").distinct()
    plan = groups.join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "SortMergeJoin" in physical and "Bucketed: true" in physical


def test_drop_duplicates(clashing, edge_rows):
    left = E.drop_duplicates(clashing)
    assert left.columns == clashing.columns
    got = sorted(str(r["doc_id"]) for r in left.collect())
    assert got == sorted(map(str, [1, 3, 4, 6, 7, 9, 10, 11])), got


def test_drop_duplicates_without_repeated_ids(docs):
    assert sorted(r["doc_id"] for r in E.drop_duplicates(docs({3: "a b", 1: "a  b", 2: "c"})).collect()) == [1, 2]
