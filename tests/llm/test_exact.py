"""Exact dedup against grouping by the text itself, and the filters it screens with."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmesh.llm import catalogue, exact
from driftmesh.llm.fuse import BinaryFuse
from tests.test_queries import values

FOLDER = "/root/testdata/sf0.001"


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def slow(table):
    groups = {}
    for k, (i, t) in enumerate(table):
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, k))
    made = []
    for text, rows in groups.items():
        best = min(rows)
        for row in rows:
            keep = table[best[3]][0]
            made.append((table[row[3]][0], keep, len(rows), row == best, hashlib.sha256(text.encode()).hexdigest(), -row[0]))
    return sorted(map(str, made))


def table(seed=4):
    rng = random.Random(seed)
    made = [(None, "a b"), (None, None), (7, None), (8, ""), (9, " \t\n\x0b\x0c\r"), (3, "ab"), (3, "ab"), (2, "a b"), (1, "A b"), (11, "é 😀" * 5000), (12, "é😀" * 5000), (None, "alone")]
    made += [(100 + k, "".join(rng.choice("ab \n") for _ in range(rng.randrange(6)))) for k in range(300)]
    return made + [(1000 + k, "hot  text" if k % 3 else "hottext") for k in range(400)]


@pytest.mark.parametrize("batches, digest_bytes", [(1, 32), (3, 32), (2, 1), (3, 2)])
def test_against_grouping(spark, batches, digest_bytes):
    rows = table()
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, row int, digest string").repartition(3)
    got = exact.dedup_exact(docs, batches, digest_bytes=digest_bytes, shard=16).collect()
    assert sorted(str(tuple(r)) for r in got) == slow(rows)


def test_rows_that_stay(spark):
    rows = table()
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    kept = exact.drop_copies(docs).collect()
    assert len(kept) == len({bare(t) for _, t in rows}) == len({bare(r["text"]) for r in kept})
    best = {bare(t): max(len(u or "") for _, u in rows if bare(u) == bare(t)) for _, t in rows}
    assert all(len(r["text"] or "") == best[bare(r["text"])] for r in kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.dedup_exact(docs).count() == 0 and exact.drop_copies(docs).count() == 0


def test_filters_screen_batches(spark):
    """What a filter lets through is what the snapshot has, and little else."""
    made = spark.range(6000).select("id", F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    old = exact.freeze(made.filter("id < 4000"), shard=256)
    new = exact.freeze(made.filter("id >= 3000"), 1)
    assert old.shards == 16 and old.filters.count() == 16
    passed = {bytes(r["digest"]) for r in exact.screened(new.buckets, old).collect()}
    held = {bytes(r["digest"]) for r in old.buckets.join(new.buckets, "digest").select("digest").collect()}
    assert len(held) == 1000 and held <= passed and len(passed - held) < 40


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 3000, 100_000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**63), 2**63 - 1, 100_000)
    held = BinaryFuse.load(BinaryFuse.of(np.concatenate([keys, keys])).dump())
    assert held.contains(keys).all() and held.contains(others).mean() < 0.006
    assert n < 100_000 or len(held.cells) < 1.25 * n


def test_twin(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got, expected = catalogue.op11_exact_dedup(spark, FOLDER), duck.sql(catalogue.OP11_SQL)
    assert got.columns == expected.columns
    found = values(got.collect(), got.columns)
    assert found == values(expected.fetchall(), expected.columns) and any(r[2] != "1" for r in found)
