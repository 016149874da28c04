"""Benchmarks that no broadcast holds: the same rows as brute force and as the broadcast index, in two passes."""

import random

import numpy as np
import pytest

from driftmesh.llm import contamination, windowjoin
from driftmesh.storage import materialize
from tests.llm.test_text_operators import brute_hits, by_text


def counted(df, passes):
    def run(batches):
        for batch in batches:
            passes.add(len(batch))
            yield batch

    return df.mapInPandas(run, df.schema)


def found(spark, docs, items, window, block_bytes):
    table = spark.createDataFrame(items, "item_id string, text string")
    rows = contamination.find_contamination(docs, table, window=window, block_bytes=block_bytes).collect()
    return [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows], sorted((str(r["doc_id"]), r["n_words"], str(r["spans"])) for r in rows)


@pytest.mark.parametrize("window", [1, 2, 4])
def test_both_ways_agree(spark, window):
    rng = random.Random(window)
    vocabulary = ["a", "B", "c", "d", "é", "日本", "g7", "hh"]
    text = lambda n: rng.choice([" ", "-", ".\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k % 9}", text(rng.choice([0, 1, 2, 3, 4, 9, 40]))) for k in range(14)]
    texts = [(k % 50, text(rng.choice([0, 1, 3, 8, 60]))) for k in range(60)] + [(None, text(9)), (None, None), (3, "a b c d"), (3, "a b c d")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    joined, spans = found(spark, docs, items, window, 0)
    assert by_text(joined) == brute_hits(texts, items, window)
    assert spans == found(spark, docs, items, window, 1 << 20)[1]


def test_ten_blocks_take_two_passes_and_a_passage_in_all_documents_is_split(spark, monkeypatch):
    """Every document holds the same passage, next to words of its own and a few shared ones."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(30))
    items = [("hot", passage), ("again", passage[: len(passage) // 2])] + [(f"i{k}", " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for k in range(100)]
    texts = [(k, f"own{k} {passage} own{k + 1} " + (items[2 + k % 100][1][10:120] if k % 7 == 0 else "")) for k in range(300)]
    size = sum(len(t) for _, t in items)
    shares = []
    monkeypatch.setattr(windowjoin, "materialize", lambda df, name: shares.append((name, materialize(df, name))) or shares[-1][1])
    passes = spark.sparkContext.accumulator(0)
    docs = counted(spark.createDataFrame(texts, "doc_id long, text string"), passes)
    joined, _ = found(spark, docs, items, 10, size // 10)
    assert passes.value == 2 * len(texts)
    assert by_text(joined) == brute_hits(texts, items)
    hits = dict(shares)["window-hits"]
    most = hits.groupBy("window", "part").count().agg({"count": "max"}).first()[0]
    assert most < len(texts) / 3 and hits.groupBy("window").count().agg({"count": "max"}).first()[0] == len(texts)


def test_screen_knows_all_keys_and_few_others(spark):
    keys = [0, -1, 1 << 62, -(1 << 63), 63, 64, windowjoin.SCREEN_BITS - 1, windowjoin.SCREEN_BITS]
    table = windowjoin._screen(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert windowjoin._known(table, np.array(keys, np.int64)).all()
    others = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 10_000)
    assert not windowjoin._known(table, others).any()
    assert len(table) * 8 == 16 << 20
