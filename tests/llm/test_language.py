import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from twinclock.llm import language as G
from twinclock.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = G.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert n > 150 and right / n > 0.97


def test_held_out_rows_teach_nothing(spark):
    docs = table(spark, FOLDER, "documents")
    wrong = docs.withColumn("lang", F.when(G.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, G.identify(docs).collect())) == sorted(map(tuple, G.identify(wrong).collect()))


def test_matches_a_plain_count(spark):
    """The batch score is the sum of the n-grams' log-probabilities."""
    model = G.train(table(spark, FOLDER, "documents"))
    for text in ["der die das", "the of and", "l'été à Paris!", "a", "x" * 300_000]:
        total = model.prior.copy()
        for codes in G._pieces(text):
            for g in G._grams(codes):
                total = total + model.log[g]
        names, scores = model.predict([text])
        assert names[0] == model.languages[int(np.argmax(total))] and 0 <= scores[0] <= 1


def test_edges(spark, clashing, edge_rows, empty):
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in G.identify(clashing).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and len(out) == len({r[0] for r in edge_rows})
    assert set(v[0] for v in out.values()) <= {"und", "en", "de", "fr"}
    assert G.identify(clashing).count() == len(edge_rows)
    assert G.identify(empty).count() == 0
    nothing = G.identify(clashing.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


@pytest.mark.parametrize("text, letters", [("123 !?", False), ("１２", False), ("ª", True), ("日", True), ("̀", False), ("😀", False), ("5x", True)])
def test_letters(text, letters):
    assert bool(len(G._codes(text))) == letters == any(c.isalpha() for c in text)


def test_too_many_languages(spark, docs, monkeypatch):
    monkeypatch.setattr(G, "MOST_LANGUAGES", 2)
    df = docs(["a", "b", "c"]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    with pytest.raises(ValueError, match="languages"):
        G.train(df)
