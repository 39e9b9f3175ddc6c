"""The pipeline against a plain version of its stages, and the contract of the subpackage."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import FOLDER
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_exact_dedup import norm
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_near_copies import survivors as near
from twinclock.llm import toxicity
from twinclock.llm.common import table

ROOT = Path(__file__).parents[2]


def test_run_equals_a_plain_pipeline(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = toxicity.train(docs, labels)
    score = dict(map(tuple, docs.select("doc_id", toxicity.scorer(docs, model)(F.col("text"))).collect()))
    rows = [tuple(r) for r in docs.collect() if score[r["doc_id"]] < toxicity.THRESHOLD]
    first = {}
    for r in sorted(rows):
        first.setdefault(norm(r[1]), r)
    rows = list(first.values())
    keep = set(near([r[:2] for r in rows]))
    rows = [r for r in rows if r[0] in keep]
    dirty = {d for d, *_ in leaks([r[:2] for r in rows], map(tuple, table(spark, FOLDER, "benchmark").collect()))}
    rows = [r for r in rows if r[0] not in dirty]
    out = P.run(spark, FOLDER)
    assert sorted(((r["doc_id"], r["copy"]) for r in out.collect()), key=str) == mixed(rows)
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r["doc_id"]] == r["text"] for r in out.collect())


def test_stages_keep_the_columns(clashing, spark, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, FOLDER, name).write.parquet(f"{tmp_path}/{name}.parquet")
    frame = clashing
    for name, stage in P.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == clashing.columns, name
    assert P.STAGES[-1][1](spark, frame, str(tmp_path)).count() >= 0


def test_stages_take_empty_documents(empty, spark):
    for _, stage in P.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_stages_are_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]


@pytest.mark.parametrize("folder", ["functions", "operators", "plans", "registry", "sources", "streaming"])
def test_nothing_else_imports_the_subpackage(folder):
    for path in (ROOT / "twinclock" / folder).glob("*.py"):
        assert not re.search(r"twinclock(\.|\s+import\s+)llm|corpus_pipeline", path.read_text()), path
