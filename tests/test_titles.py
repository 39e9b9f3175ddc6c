import pytest
from pyspark.sql import functions as F

from tests.conftest import ts
from twinclock.operators import catalog as C
from twinclock.operators import systime as D


def feed(spark):
    entries = spark.createDataFrame(
        [(0, "alpha", "d"), (1, "Old", "d"), (2, "Gamma", "e"), (3, "Alpha", "d"), (4, "Nowhere", "e"), (5, "Mercury", "e"),
         (6, "Loop", "e"), (7, "Talk:X", "e"), (8, "Bad|", "e"), (9, "Unheard", "e"), (10, "NoUrl", "e"), (11, "Older", "d")],
        "position int, requested_title string, domain string")
    normalized = spark.createDataFrame([("alpha", "Alpha")], "from string, to string")
    redirects = spark.createDataFrame([("Older", "Old", "part"), ("Old", "Beta", None), ("Loop", "Loop2", None), ("Loop2", "Loop", "f")],
                                      "from string, to string, tofragment string")
    pages = spark.createDataFrame(
        [("Alpha", 1, 0, False, False, None, "/Alpha", False), ("Beta", 2, 0, False, False, None, "/Beta", False),
         ("Gamma", 3, 0, False, False, None, "/Gamma", False), ("Nowhere", None, 0, True, False, None, None, False),
         ("Mercury", 5, 0, False, False, None, "/Mercury", True), ("Talk:X", 6, 1, False, False, None, "/Talk", False),
         ("Bad|", None, None, False, True, "bar", None, False), ("NoUrl", 7, 0, False, False, None, None, False)],
        "title string, page_id bigint, ns int, missing boolean, invalid boolean, invalid_reason string, url string, is_disambiguation boolean")
    return entries, normalized, redirects, pages


def test_classification(spark):
    got = {r["position"]: r for r in C.classify(*feed(spark)).collect()}
    want = {0: ("resolved", None), 1: ("redirect", None), 2: ("resolved", None), 3: ("resolved", None), 4: ("missing", "page_does_not_exist"),
            5: ("disambiguation", "page_is_a_disambiguation_page"), 6: ("error", "redirect_cycle"), 7: ("error", "not_an_article_namespace_1"),
            8: ("error", "invalid_title: bar"), 9: ("error", "page_not_in_response"), 10: ("error", "api_returned_no_url"), 11: ("redirect", None)}
    assert {p: (r["status"], r["reason"]) for p, r in got.items()} == want
    assert got[0]["normalized_from"] == "alpha" and got[0]["redirect_chain"] == []
    assert got[11]["redirect_chain"] == ["Old", "Beta"] and got[11]["redirect_fragment"] == "part"
    assert got[6]["redirect_chain"] == ["Loop2", "Loop"] and not got[6]["is_redirect"] and got[6]["canonical_title"] is None


def test_one_owner_per_page(spark, rows):
    out = C.mark_duplicates(C.classify(*feed(spark)))
    got = dict((p, (s, d)) for p, s, d in rows(out, "position", "status", "duplicate_of"))
    # the direct title owns page 1 although another entry comes first; page 2 goes to the first entry
    assert got[0] == ("duplicate", "Alpha") and got[3] == ("resolved", None)
    assert got[1] == ("redirect", None) and got[11] == ("duplicate", "Old")
    s = C.status_summary(out).first()
    assert (s["requested"], s["usable"], s["duplicate"], s["error"], s["missing"], s["disambiguation"]) == (12, 3, 2, 5, 1, 1)


def test_long_chain(spark, rows):
    n = 7
    redirects = spark.createDataFrame([(f"t{i}", f"t{i + 1}", None) for i in range(n)], "from string, to string, tofragment string")
    got = C.follow_redirects(spark.createDataFrame([("t0",), ("t5",)], "title string"), redirects)
    assert rows(got.select("title", "final", F.size("chain"))) == [("t0", "t7", 7), ("t5", "t7", 2)]


def test_curated_problems(spark, rows):
    df = spark.createDataFrame([(0, "A", "x"), (1, " a ", "x"), (2, "", "x"), (3, "B", None), (4, None, "y")], "position int, title string, domain string")
    assert rows(C.curated_problems(df), "position", "problem", "first_position") == [
        (1, "duplicate title", 0), (2, "missing title", None), (3, "missing domain", None), (4, "missing title", None)]


def test_upsert_writes_versions_only_for_changes(spark, rows):
    old = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("c", "z", 3)], "t string, url string, page int")
    new = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("d", None, None)], "t string, url string, page int")
    plan = C.upsert_plan(old, new, "t", ["url", "page"])
    assert rows(plan, "t", "action") == [("a", "unchanged"), ("b", "updated"), ("d", "inserted")]
    v = C.apply_upsert(D.start_versioning(old, "2024-01-01 00:00:00"), plan, "t", "2024-02-01 00:00:00")
    assert v.count() == 5 and rows(D.superseded(v), "t", "row_end") == [("b", ts("2024-02-01"))]
    again = C.upsert_plan(D.current(v).drop("row_start", "row_end"), new, "t", ["url", "page"])
    assert again.filter("action <> 'unchanged'").count() == 0
    assert [r["url"] for r in D.audit_trail(v, F.col("t") == "b").collect()] == [None, "y"]


def test_unknown_owner_is_an_error(spark):
    records = spark.createDataFrame([("x", "duplicate", "gone")], "requested_title string, status string, duplicate_of string")
    ids = spark.createDataFrame([("a", 1)], "requested_title string, article_id bigint")
    with pytest.raises(ValueError, match="gone"):
        C.assert_owners_known(records, ids)


def test_redirects_by_doubling(spark, rows):
    pairs = [(f"t{k}", f"t{k + 1}", f"f{k}" if k % 5 == 0 else None) for k in range(37)] + [("a", "b", None), ("b", "c", "x"), ("c", "b", None), ("self", "self", None)]
    redirects = spark.createDataFrame(pairs, "from string, to string, tofragment string")
    titles = spark.createDataFrame([("t0",), ("t36",), ("t37",), ("a",), ("b",), ("self",), ("alone",), ("t0",)], "title string")
    got = {r["title"]: (r["final"], len(r["chain"]), r["fragment"], r["cycle"]) for r in C.follow_redirects(titles, redirects).collect()}
    assert got == {"t0": ("t37", 37, "f35", False), "t36": ("t37", 1, None, False), "t37": ("t37", 0, None, False), "alone": ("alone", 0, None, False),
                   "a": (None, 3, "x", True), "b": (None, 2, "x", True), "self": (None, 1, None, True)}


def test_repeated_mappings_multiply_nothing(spark, rows):
    entries = spark.createDataFrame([(0, "x", "d")], "position int, requested_title string, domain string")
    maps = spark.createDataFrame([(1, "x", "y"), (2, "x", "z")], "seq int, from string, to string")
    assert rows(C.normalise_titles(entries, maps), "title") == [("z",)]
    assert C.normalise_titles(entries, maps.drop("seq")).count() == 1
