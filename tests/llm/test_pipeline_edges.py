"""The pipeline's stages on awkward rows and on empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

GOOD = "The harbour was quiet when the ferry came in, and two fishermen were mending a net on the wall while a dog slept between the crates. Nobody had told them that the bridge would be closed for the summer."
OTHER = "A library closes at eight in the evening, but the guard lets students in who come late from work, and on the second floor there is a table beside the window from which one sees the whole port and its cranes."
LINE = "Licensed under terms that every one of these documents repeats"
ITEM = "what is the name of the river that flows through the old town of this story"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, copy string, kept string"
DOCS = [
    (1, GOOD, "en", "a"), (2, GOOD, "en", "a"), (3, GOOD + " It rained later.", "en", "b"), (4, f"{OTHER}\n{LINE}", None, None), (5, f"{LINE}\nOnce more a text of its own that has words enough for the rules of quality and is not like others here", "en", "b"),
    (6, f"Another story again\n{LINE}\nwith some more words that nobody else has written down before today in any of the texts around it", "xx", "a"), (7, f"{ITEM} asked the teacher, and all the children in the class looked out of the window", "en", "a"),
    (None, f"{ITEM} said the guide, who had forgotten the answer and hoped that somebody in the group would know it", "en", "a"), (None, "A row without an id that holds a text of its own, about mountains, goats and the long road to the pass", "en", None),
    (8, None, "en", "a"), (9, "", None, "b"), (10, " \n\t", "en", "a"), (4, f"{OTHER}\n{LINE}", None, None), (11, "word " * 20_000, "en", "a"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(*r, len(r[1] or ""), "clash", "clash", "clash") for r in DOCS]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_awkward_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name != "mix_sources":
            assert made.columns == docs.columns
            docs = spark.createDataFrame(made.collect(), made.schema)
            seen.append(sorted((r["doc_id"] or -1, (r["text"] or "")[:12]) for r in docs.collect()))
    ids = [[i for i, _ in rows] for rows in seen]
    # no words, or the same ones again and again
    assert ids[0] == ids[1] == [-1, -1, 1, 2, 3, 4, 4, 5, 6, 7]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    # copies and the near copy go, of the repeated row one stays; what holds the benchmark's windows goes, with an id or without
    assert ids[2] == [-1, -1, 1, 4, 5, 6, 7] and ids[3] == [-1, 1, 4, 5, 6]
    assert LINE in texts[6] and LINE not in texts[4] + texts[5]
    mixed = made.collect()
    assert {r["doc_id"] for r in mixed} <= set(texts) and all(1 <= r["copy"] <= r["copies"] for r in mixed)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    made = corpus_pipeline.run(spark, str(tmp_path))
    assert made.count() == 0 and {"doc_id", "text", "copies", "copy"} <= set(made.columns)


def test_rerun_agrees(spark, folder):
    key = lambda df: sorted(map(str, df.select("doc_id", F.md5("text").alias("m"), "copies", "copy").collect()))
    assert key(corpus_pipeline.run(spark, folder)) == key(corpus_pipeline.run(spark, folder))
