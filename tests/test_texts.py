import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests import data
from twinclock.functions.texts import shortest_edit, split_lines, word_parts
from twinclock.operators import content as G
from twinclock.operators import diff as H


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_shortest_edit_equals_brute_force(seed):
    r = random.Random(seed)
    a = [r.choice("abcd") for _ in range(r.randrange(60))]
    b = [r.choice("abcd") for _ in range(r.randrange(60))]
    s = shortest_edit(a, b)
    assert s.count("=") == brute_lcs(a, b)
    i = j = 0
    for step in s:
        if step == "=":
            assert a[i] == b[j]
        i += step != "+"
        j += step != "-"
    assert (i, j) == (len(a), len(b))
    assert "+-" not in "".join(s)


def test_shortest_edit_across_kept_rows():
    r = random.Random(1)
    a = [r.randrange(40) for _ in range(900)]
    b = [x for x in a if r.random() > 0.2] + [r.randrange(40) for _ in range(50)]
    r.shuffle(b[100:200])
    assert shortest_edit(a, b).count("=") == brute_lcs(a, b)


def test_edit_budget():
    assert shortest_edit(list("abc"), list("xyz"), 5) is None and shortest_edit(list("abc"), list("xyz"), 6) is not None


def pair(spark, old, new, n=1):
    return spark.createDataFrame([(n, old, new)], "pair_id bigint, old_text string, new_text string")


FOX = ("The quick\nbrown fox\njumps\n", "The quick\nred fox\njumps\n")


def test_one_changed_line(spark, rows):
    lines = H.diff_pairs(pair(spark, *FOX))
    assert rows(H.diff_stats(lines), "added", "removed", "old_lines", "new_lines", "identical") == [(1, 1, 3, 3, False)]
    assert rows(lines, "seq", "type", "old_no", "new_no") == [(0, "same", 1, 1), (1, "del", 2, None), (2, "add", None, 2), (3, "same", 3, 3)]
    w = H.word_changes(lines).first()
    assert [tuple(p) for p in w["old_parts"]] == [("brown", True), (" fox", False)]
    assert [tuple(p) for p in w["new_parts"]] == [("red", True), (" fox", False)]


def test_identical_texts(spark, rows):
    assert rows(H.diff_stats(H.diff_pairs(pair(spark, "a\nb", "a\nb"))), "added", "removed", "old_lines", "identical") == [(0, 0, 2, True)]


def test_distant_changes_make_two_hunks_and_near_ones_one(spark, rows):
    old = [f"line {i}" for i in range(1, 41)]
    far = list(old)
    far[2], far[29] = "x", "y"
    got = H.hunks(H.diff_pairs(pair(spark, "\n".join(old), "\n".join(far)))).orderBy("hunk").collect()
    assert [(h["old_start"], h["new_start"], len(h["lines"])) for h in got] == [(1, 1, 7), (27, 27, 8)]
    near = list(old)
    near[10], near[14] = "x", "y"
    assert H.hunks(H.diff_pairs(pair(spark, "\n".join(old), "\n".join(near)))).count() == 1


def test_too_expensive_pair_does_not_stop_the_others(spark, rows):
    both = pair(spark, "a\nb\nc", "x\ny\nz", 1).unionByName(pair(spark, *FOX, 2))
    lines = H.diff_pairs(both, max_edits=4)
    assert rows(lines.filter("status <> 'OK'"), "pair_id", "status") == [(1, "TOO_EXPENSIVE")]
    assert rows(H.diff_stats(lines), "pair_id", "status", "added") == [(1, "TOO_EXPENSIVE", None), (2, "OK", 1)]
    assert rows(H.hunks(lines), "pair_id", "hunk", "status") == [(1, None, "TOO_EXPENSIVE"), (2, 1, "OK")]
    assert rows(H.word_changes(lines), "pair_id", "status") == [(1, "TOO_EXPENSIVE"), (2, "OK")]


def test_every_pair_keeps_a_row(spark, rows):
    df = spark.createDataFrame([(1, None, "a", "OK"), (2, "a", "b", "TOO_LARGE"), (3, "x", "x", "OK"), (4, "x\n", "x", "OK"), (5, "", "\n", "OK"), (6, "a\nb", "a\nc", "OK")],
                               "pair_id bigint, old_text string, new_text string, status string")
    lines = H.diff_pairs(df)
    want = [(1, "CONTENT_HIDDEN", None), (2, "TOO_LARGE", None), (3, "IDENTICAL", True), (4, "OK", True), (5, "OK", False), (6, "OK", False)]
    assert rows(H.diff_stats(lines), "pair_id", "status", "identical") == want
    for out in (H.hunk_lines(lines), H.hunks(lines), H.word_changes(lines), H.line_bag_delta(df)):
        assert sorted(r["pair_id"] for r in out.select("pair_id").distinct().collect()) == [1, 2, 3, 4, 5, 6]
    assert rows(H.diff_stats(lines).filter("pair_id = 3"), "added", "old_lines", "new_lines") == [(0, 1, 1)]


def test_few_edits_in_a_long_text():
    a = [f"line {k}" for k in range(70_000)]
    b = [*a[:500], *a[501:30_000], "new", *a[30_000:69_000], "other", *a[69_001:]]
    s = shortest_edit(a, b)
    assert len(s) - s.count("=") == 4 and s.count("=") == 69_998


@pytest.mark.parametrize("greedy", [0, 2, 1500])
def test_both_searches_are_shortest(greedy, monkeypatch):
    from twinclock.functions import texts

    monkeypatch.setattr(texts, "_GREEDY_EDITS", greedy)
    r = random.Random(greedy)
    for _ in range(400):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 12))] for _ in range(2))
        s, k = shortest_edit(a, b), r.randint(0, 10)
        assert s.count("=") == brute_lcs(a, b)
        assert (shortest_edit(a, b, k) is None) == (len(s) - s.count("=") > k)


def test_long_lines_get_no_word_parts(spark):
    lines = H.diff_pairs(pair(spark, "a " * 4000, "b " * 4000))
    assert H.word_changes(lines, max_chars=6000).first()["old_parts"] == [] and len(H.word_changes(lines).first()["old_parts"]) == 8000


def test_status_before_the_job(spark):
    df = spark.createDataFrame([(1, 1, None, "a", "b"), (2, 1, 1, "a", "a"), (3, 1, 2, None, "b"), (4, 1, 2, "a" * 11, "b"), (5, 1, 2, "a", "b")],
                               "pair_id bigint, old_rev bigint, new_rev bigint, old_text string, new_text string")
    got = [r["s"] for r in df.withColumn("s", H.diff_status(10)).orderBy("pair_id").collect()]
    assert got == ["NO_REVISION", "SAME_REVISION", "CONTENT_HIDDEN", "TOO_LARGE", "OK"]


def test_sentences(spark, rows):
    df = spark.createDataFrame([(1, 'One here. Two "there"? Three e.g. this one.\r\n\n  Four! 5 is next. (Six) done ')], "k int, text string")
    got = [r["line"] for r in H.sentence_lines(df, "k").orderBy("seq").collect()]
    assert got == ["One here.", 'Two "there"?', "Three e.g. this one.", "Four!", "5 is next.", "(Six) done"]


def test_sentences_are_parted_and_trimmed_by_any_white_space(spark):
    df = spark.createDataFrame([(1, "\u00a0One here.\u2003Two there.\u3000\ufeff")], "k int, text string")
    assert [r["line"] for r in H.sentence_lines(df, "k").orderBy("seq").collect()] == ["One here.", "Two there."]


def test_word_changes_read_the_comparison_once(spark):
    plan = H.word_changes(H.diff_pairs(pair(spark, *FOX)))._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("MapInPandas") == 1


def test_bag_of_lines(spark, rows):
    assert rows(H.line_bag_delta(pair(spark, "a\nb\nb\n", "b\na\nc\n"))) == [(1, 1, 1)]
    assert rows(H.line_bag_delta(pair(spark, "a\n\n", "a"))) == [(1, 0, 1)]
    assert rows(H.line_bag_delta(pair(spark, "", "a\n"))) == [(1, 1, 0)]


def test_split_lines_and_words():
    assert split_lines("a\nb\n") == ["a", "b"] and split_lines("") == [] and split_lines("a\n\n") == ["a", ""]
    assert word_parts("a", "a") == ([("a", False)], [("a", False)])


@pytest.mark.parametrize("max_rows", [None, 3])
def test_consecutive_pairs(spark, rows, max_rows):
    ev = data.events(spark).withColumn("hidden", F.col("content_hidden"))
    got = rows(H.consecutive_pairs(ev, "entity", max_rows).filter("entity = 7"), "old_rev", "new_rev")
    ids = [r[0] for r in data.BUSY]
    assert got == list(zip(ids, ids[1:]))


# ---- packs ---------------------------------------------------------------------------------------

def texts_of(spark, lengths, entity=1):
    out = [(entity, hashlib.sha1(f"{entity}-{i}".encode()).hexdigest(), n, ) for i, n in enumerate(lengths)]
    df = spark.createDataFrame([(*o, i) for i, o in enumerate(out)], "entity bigint, sha1 string, byte_length bigint, first_rev bigint")
    return df.withColumn("first_ts", F.lit("2020-01-01").cast("timestamp_ntz"))


def brute_packs(lengths, max_bytes, max_texts):
    out, pack, filled, texts = [], 0, 0, 0
    for n in lengths:
        if texts == 0 or filled + n > max_bytes or texts >= max_texts:
            pack, filled, texts = pack + 1, 0, 0
        out.append((pack, filled, n))
        filled, texts = filled + n, texts + 1
    return out


def test_count_bound(spark, rows):
    got = rows(G.pack_summary(G.pack_texts(texts_of(spark, [10] * 10), 1 << 20, 4)), "pack", "texts")
    assert got == [(1, 4), (2, 4), (3, 2)]


def test_oversize_text_is_alone(spark, rows):
    assert rows(G.pack_summary(G.pack_texts(texts_of(spark, [5, 50, 5, 5]), 20, 4)), "pack", "texts") == [(1, 1), (2, 1), (3, 2)]


@pytest.mark.parametrize("block,max_rows", [(1000, None), (7, None), (16, 20), (64, 30)])
def test_packs_equal_the_greedy_loop_for_any_block_size(spark, rows, block, max_rows):
    r = random.Random(block)
    lengths = {e: [r.choice([1, 5, 20, 90]) for _ in range(n)] for e, n in ((1, 150), (2, 40), (3, 1), (4, 7))}
    df = None
    for e, ls in lengths.items():
        one = texts_of(spark, ls, e)
        df = one if df is None else df.unionByName(one)
    packs = G.pack_texts(df, 100, 6, block, max_rows).join(df.select("sha1", "first_rev"), "sha1")
    got = rows(packs, "entity", "first_rev", "pack", "byte_offset", "byte_length")
    want = sorted((e, i, *p) for e, ls in lengths.items() for i, p in enumerate(brute_packs(ls, 100, 6)))
    assert got == want


def test_dedup_lookup_and_damage(spark, rows):
    rev = data.events(spark).withColumns({"hidden": F.col("content_hidden"), "size_bytes": F.lit(2).cast("bigint")})
    texts = G.distinct_texts(rev)
    assert texts.count() == 11
    assert rows(texts.filter("text = 'second'"), "first_rev") == [(47,)]
    got = {r["rev_id"]: (r["text"], r["content_status"]) for r in G.text_of(rev.drop("text"), texts).collect()}
    assert got[70] == ("second", "available") and got[82] == (None, "hidden") and len(got) == 13
    at = {r["entity"]: r["text"] for r in G.texts_at(rev, texts, "2018-01-01 00:00:00").collect()}
    assert at == {7: None, 8: "b-two", 9: "c-only"}
    assert G.damaged_texts(texts).count() == 0
    assert G.damaged_texts(texts.withColumn("text", F.when(F.col("text") == "second", "sécond").otherwise(F.col("text")))).count() == 1
    assert rows(G.size_report(rev, texts), "revisions", "revision_bytes", "texts", "text_bytes") == [(13, 26, 11, 62)]


def test_global_rank_and_picks(spark, rows):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("entity"), F.col("id").alias("size_bytes"))
    ranked = G.global_rank(df.repartition(7), ["entity"])
    assert ranked.filter("rank <> entity").count() == 0 and ranked.select("total").distinct().count() == 1
    got = rows(G.pick_by_size(df, [0.1, 0.5]), "rank", "bytes")
    assert got == [(100, 100), (500, 500)]


@pytest.mark.parametrize("bits", [0, 1 << 25])
def test_rows_find_the_script_of_the_greedy_search(bits, monkeypatch):
    from twinclock.functions import texts

    monkeypatch.setattr(texts, "_BITS_KEPT", bits)
    r = random.Random(bits)
    for n in [*[40] * 300, *[700] * 3]:
        a, b = ([r.randrange(r.choice([2, 5, 30])) for _ in range(r.randint(0, n))] for _ in range(2))
        late = texts._deletions_first(texts._greedy(a, b, len(a) + len(b)))
        assert texts._deletions_first(texts._by_rows(a, b, None, len(a) + len(b))) == late
        early = texts._by_rows(a, b, None, -1)
        assert early.count("=") == late.count("=")


def test_blanks_of_a_long_line_are_masked_once(monkeypatch):
    from twinclock.functions import texts

    asked = []
    real = texts._mask
    monkeypatch.setattr(texts, "_mask", lambda places: asked.append(len(places)) or real(places))
    old, new = (" ".join(f"{side}{k}" for k in range(2000)) for side in "ab")
    left, right = word_parts(old, new)
    assert "".join(t for t, _ in left) == old and "".join(t for t, _ in right) == new
    assert sum(asked) < 10 * 4000


def test_comparison_holds_and_hands_on_few_texts_at_a_time(spark, monkeypatch):
    H.diff_pairs(pair(spark, *FOX))
    conf = spark.conf.get
    assert int(conf("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000 and int(conf("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    many = spark.createDataFrame([(k, f"a{k}" * 30, f"b{k}" * 30) for k in range(50)], "pair_id bigint, old_text string, new_text string")
    monkeypatch.setattr(H, "CHARS_PER_BATCH", 500)
    assert H.diff_pairs(many).count() == 100
