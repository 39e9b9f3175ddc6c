import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, long, "en", "a", len(long)),
        (5, long, "en", "b", len(long)), (6, "one", None, "b", 3), (6, "one", None, "b", 3), (7, "one  two\nthree", "de", None, 14),
        (8, "one two three", "de", "c", 13), (None, "one two three", "de", "c", 13), (9, "x" * 20_000, "en", "c", 20_000),
        (10, "Ünïcödé 日本語 text 😀 \u00a0 end", "fr", "c", 20), (11, "a\x00b \x1f c", "en", "c", 6)]


@pytest.fixture
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(spark, edge):
    """Extra columns under the names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["digest", "keep_id", "score", "fp", "key", "copy", "mix_key", "hit", "item", "lead", "root", "label", "row", "pos", "gone", "cdf", "n", "kept_id", "best", "line"]
    return edge.withColumns({n: F.lit(n) for n in names})


@pytest.fixture
def docs(spark):
    def make(texts, **columns):
        rows = [(k, t, "en", columns.get("source", "s"), len(t or "")) for k, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
        return spark.createDataFrame(rows, SCHEMA)
    return make


@pytest.fixture
def prose():
    """Random words from a seed; fewer syllables make more repeats."""
    def make(seed, n, syllables=("ta", "ri", "mo", "ne", "lu", "ka", "so", "vi")):
        r = random.Random(seed)
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
    return make
