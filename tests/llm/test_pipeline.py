"""The pipeline as a whole, on the small tables, against its stages done by hand."""

import re

import public_tokenizers
import pytest

from tests.llm import test_text_operators as small
from tests.llm.test_similar import brute_similar

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from driftmesh.storage import materialize

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name)
        made.append(docs)
    return made


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage(stages, spark):
    from driftmesh.llm import quality

    path = public_tokenizers.path("piece_bpe_32k.model")
    bands = quality.fit_bands(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"), path)
    judged = quality.quality_rules(stages[0], path, bands).filter("kept")
    assert [i for i, _ in texts(stages[1])] == sorted(r["doc_id"] for r in judged.collect())
    before = dict(texts(stages[0]))
    assert all(before[i] == t and not small.brute_quality(t)[-1] for i, t in texts(stages[1]))


def test_line_stage(stages):
    assert texts(stages[2]) == sorted((i, t) for i, t, *_ in small.brute_lines(texts(stages[1])))


def test_near_copies_stage(stages):
    expected = sorted({c for *_, c in brute_similar(texts(stages[2]))})
    assert [i for i, _ in texts(stages[3])] == expected


def test_contamination_stage(stages, spark):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = sorted(i for i, _, n, _ in small.brute_hits(texts(stages[3]), items) if n == 0)
    assert [i for i, _ in texts(stages[4])] == clean


def test_mix_stage(stages):
    rows = stages[5].collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts(stages[4])}
    assert {r["doc_id"] for r in rows} <= set(size)
    assert all(r["size"] == size[r["doc_id"]] and 1 <= r["copy"] <= r["copies"] <= 2 for r in rows)


def test_run(stages, spark):
    import corpus_pipeline

    key = lambda r: (r["doc_id"], r["copy"], r["text"])
    assert sorted(map(key, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(key, stages[5].collect()))
