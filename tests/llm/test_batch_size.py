from driftmesh.llm.arrow import map_batches


def test_batches_are_as_small_as_asked(spark):
    docs = spark.createDataFrame([("x" * 40_000,)] * 20 + [(None,), ("y" * 300_000,)], "text string").coalesce(1)

    def held(batch):
        n = sum(len(t or "") for t in batch.column("text").to_pylist())
        return {"rows": [batch.num_rows], "held": [n]}

    made = map_batches(docs, held, "rows long, held long", 100_000).collect()
    assert sum(r["rows"] for r in made) == 22
    assert all(r["held"] <= 100_000 or r["rows"] <= 2 for r in made)
