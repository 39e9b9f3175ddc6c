import random
import re

import pytest

from twinclock.llm import decontaminate as D


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {" ".join(words[k: k + width]) for k in range(len(words) - width + 1)} if width else set()


def brute(docs, items):
    out = []
    for i, item in items:
        width = min(5, len(re.findall(r"[^\x20\x09-\x0D]+", item or "")))
        own = shingles(item, width)
        for d, text in docs:
            n = len(own & shingles(text, width))
            if own and n >= 0.8 * len(own) - 1e-9:
                out.append((d, i, n, len(own)))
    return sorted(out, key=str)


@pytest.fixture
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id bigint, text string")
    return make


def found(df):
    return sorted(((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in df.collect()), key=str)


def test_against_brute_force(docs, items, prose):
    r = random.Random(7)
    tests = [(k, prose(f"i{k}", r.choice([1, 3, 5, 6, 12, 30, 60]))) for k in range(30)] + [(30, ""), (31, None), (32, "A  b\tC d e f")]
    texts = {}
    for d in range(80):
        words = prose(f"d{d}", r.choice([0, 4, 20, 300])).split()
        for _ in range(r.randint(0, 2)):
            part = r.choice(tests)[1] or ""
            part = part.split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if part:
                    part[r.randrange(len(part))] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = part[: len(part) // 2] + (["cut"] if r.random() < 0.3 else []) + part[len(part) // 2:]
        texts[d] = " ".join(words).upper() if d % 7 == 0 else "\n".join(words)
    texts[80] = "a b c d e f"
    want = brute(texts.items(), tests)
    assert len(want) > 40
    assert found(D.contamination(docs(texts), items(tests))) == want


def test_several_passes_give_the_same(docs, items, prose, monkeypatch):
    tests = [(k, prose(f"i{k}", 20)) for k in range(12)]
    texts = {k: prose(f"x{k}", 50) + " " + tests[k % 12][1] for k in range(24)}
    want = found(D.contamination(docs(texts), items(tests)))
    monkeypatch.setattr(D, "PASS_BYTES", 400)
    assert len(list(D._blocks(items(tests)))) > 3
    assert found(D.contamination(docs(texts), items(tests))) == want == brute(texts.items(), tests)


def test_item_at_a_seam_of_pieces(docs, items, prose, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 16)
    item = prose("item", 12)
    for before in range(10, 20):
        sketches = D.Sketches([item.encode()])
        text = (prose("b", before) + " " + item + " " + prose("e", 40)).encode()
        assert [f["shared"] for f in sketches.find(text, D._Words())] == [8]


def test_drop_keeps_columns_and_clean_rows(clashing, items, edge_rows):
    kept = D.drop_contaminated(clashing, items([(0, "one two three"), (1, None), (2, "")]))
    assert kept.columns == clashing.columns
    gone = {7, 8, None}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in edge_rows if r[0] not in gone)


def test_empty_tables(edge, empty, items):
    assert D.contamination(empty, items([(0, "one two")])).count() == 0
    assert D.contamination(edge, items([])).count() == 0
    assert D.drop_contaminated(edge, items([])).count() == edge.count()


def test_null_item_id_and_repeated_rows(edge, items):
    out = found(D.contamination(edge, items([(None, "one"), (5, "one"), (5, "one")])))
    assert out.count((6, None, 1, 1)) == 2 and out.count((6, 5, 1, 1)) == 4
