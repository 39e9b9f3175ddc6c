import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from twinclock.llm import strings, toxicity, toxicity_model
from twinclock.llm.common import table

BAD = ["numbskull", "dimwit", "blockhead"]


def corpus(n, seed=1):
    r = random.Random(seed)
    syllables = ["ta", "ri", "mo", "ne", "lu", "ka", "so", "vi", "th", "er"]
    out = []
    for k in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))]
        toxic = int(k % 5 == 0)
        if toxic:
            words.insert(r.randint(0, len(words)), r.choice(BAD))
        out.append((" ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity_model.fit(corpus(600))


def naive_features(token):
    """Every choice of characters that skips few enough, one by one."""
    codes, _, _ = strings.encode([token])
    out = {}
    for n in strings.ORDERS:
        for at in itertools.combinations(range(len(codes)), n):
            skipped = at[-1] - at[0] + 1 - n
            if skipped <= strings.GAP:
                key = tuple(int(codes[k]) for k in at)
                out[key] = out.get(key, 0) + strings.DECAY ** skipped
    return out


def test_kernel_is_the_subsequence_kernel():
    for a, b in [("idiot", "idxiot"), ("banana", "bandana"), ("abc", "abc"), ("a", "b"), ("mississippi", "missing")]:
        fa, fb = naive_features(a), naive_features(b)
        want = sum(v * fb.get(k, 0) for k, v in fa.items())
        dense = np.zeros((2, strings.FEATURES))
        who, feature, value = strings.features([a, b])
        np.add.at(dense, (who, feature), value * np.array([strings._norm(len(a) + 2), strings._norm(len(b) + 2)])[who])
        assert dense[0] @ dense[1] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_score_is_the_landmark_form(model):
    """One weight per feature gives the value that kernels with the landmarks give."""
    words = ["numbskull", "tarimo", "numb.skull", "dimwits"]
    k, basis, live = toxicity_model._kernel(words, model.landmarks)
    assert np.allclose(toxicity_model._kernel(model.landmarks, model.landmarks)[0], basis @ basis.T, atol=1e-4)
    beta = np.linalg.lstsq(basis.T.astype(float), model.weights[live].astype(float), rcond=None)[0]
    assert np.allclose(k @ beta + model.bias, model.decide(words), atol=1e-2)


def test_inserted_and_gapped_insults(model):
    margins = toxicity_model.Scorer(model).margins
    clean = np.quantile(margins([t for t, y in corpus(300, seed=5) if not y]), 0.95)
    for text in ["you numbskull", "n.u.m.b.s.k.u.l.l", "num*bskull", "numbxskull", "d i m w i t", "DIMWIT!!", "blockkhead", "dimwvit", "tari bl0ockhead"]:
        assert margins([text])[0] > max(0.5, clean), text
    for text in ["numbskull", "n.u.m.b.s.k.u.l.l", "D I M W I T", "block-head!!"]:
        assert model.probability(margins([text]))[0] >= 0.7, text
    assert model.probability(margins(["tarimo nelu kasovi", "", None])).max() < 0.3


def test_disguised_insults_reach_the_threshold(model):
    score = lambda *texts: model.probability(toxicity_model.Scorer(model).margins(list(texts)))
    for text in ["numbxskull", "blockkhead", "dimwvit", "tari bl0ockhead", "numb skull", "tari dim wit mo", "blo ckhead", "d i  m w i t"]:
        assert score(text)[0] >= 0.7, text
    assert score("tarimo nelu kasovi", "ta ri mo ne", "", None).max() < 0.3


def test_held_out_accuracy(model):
    texts, labels = zip(*corpus(300, seed=2), strict=True)
    p = model.probability(toxicity_model.Scorer(model).margins(list(texts)))
    assert ((p >= 0.7) == np.array(labels)).mean() > 0.97


def test_batches_and_memory_do_not_change_margins(model):
    texts = [t for t, _ in corpus(60, seed=3)] + [None, "", " \n"]
    whole = toxicity_model.Scorer(model).margins(texts)
    assert np.allclose(whole, toxicity_model.Scorer(model, remember=20).margins(texts))
    assert np.allclose(whole, [toxicity_model.Scorer(model).margins([t])[0] for t in texts])


def test_one_class_and_no_sample():
    for sample in ([], [("a b", 0)] * 5, [("a b", 1)] * 5):
        m = toxicity_model.fit(sample)
        assert (m.probability(toxicity_model.Scorer(m).margins(["a", None])) < 0.7).all()


def test_query_never_learns_from_held_out_rows(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    held = toxicity.held_out(F.col("doc_id"))
    a = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, flipped).collect()}
    assert a == b and len(a) == docs.count() and all(0 <= s <= 1 for s in a.values())


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    seen = []
    monkeypatch.setattr(toxicity.toxicity_model, "fit", lambda texts: seen.append(texts))
    toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 5_000)
    toxicity.train(docs, labels)
    whole, part = seen
    assert 0 < len(part) < len(whole) and max(len(t.encode()) for t, _ in part) <= 5_000


def test_driver_holds_neither_texts_nor_fit(spark, monkeypatch):
    """The machine is that of the same texts fitted here, but the driver neither reads the sample nor fits."""
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    fit, taken = toxicity_model.fit, []
    monkeypatch.setattr(toxicity.toxicity_model, "fit", lambda texts: taken.append(texts))
    toxicity.train(docs, labels)
    want = fit(list(taken[0]))
    monkeypatch.setattr(toxicity.toxicity_model, "fit", fit)
    for name in ("_newton", "_kernel", "words"):
        monkeypatch.setattr(toxicity_model, name, None)
    monkeypatch.setattr(toxicity.Sample, "__iter__", None)
    got = toxicity.train(docs, labels)
    assert got.landmarks == want.landmarks and got.whole == want.whole and got.insults == want.insults and len(got.landmarks) > 0
    assert np.allclose(got.weights, want.weights, atol=1e-4) and got.bias == pytest.approx(want.bias, abs=1e-4)


def test_edges(spark, clashing, empty, edge_rows):
    labels = spark.createDataFrame([(2, 0, 0), (8, 0, 1), (8, 0, 1), (9, 0, 0), (9, 0, 1), (6, 0, None), (None, 0, 1), (99, 0, 1), (4, 0, 7)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score_documents(clashing, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(edge_rows)
    assert toxicity.drop_toxic(clashing, labels).columns == clashing.columns
    assert toxicity.score_documents(empty, labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(clashing, labels.limit(0)).count() == len(edge_rows)


def test_texts_without_spaced_words_are_not_searched_for_them(monkeypatch):
    class Never:
        def findall(self, text):
            raise AssertionError(text)
    text = "a plain text | with b a few | lone characters a b c but never four"
    plain = toxicity_model.parts(text, frozenset(["plain", "text"]), frozenset(["aplain"]))
    monkeypatch.setattr(toxicity_model, "SPACED", Never())
    assert toxicity_model.parts(text, frozenset(["plain", "text"]), frozenset(["aplain"])) == plain
