"""Sweeps with limits that go on where they were stopped, and what stages report of themselves."""

import time

import pytest
from pyspark.sql import functions as F

from driftmesh.model import Level
from driftmesh.operators import mining, patterns
from driftmesh.plans import sweep
from driftmesh.plans.discovery import Discovery
from driftmesh.sources.tables import event_samples


def endless(spark):
    return spark.range(0, 10**13, 1, 8).filter(F.sha2(F.col("id").cast("string"), 256) == "x").count()


def test_a_set_that_would_run_on_ends_at_its_limit(spark):
    begin = time.perf_counter()

    def run(values):
        if values["k"] == 3:
            raise ValueError("no such set")
        return endless(spark) if values["k"] == 1 else spark.range(values["k"]).count()

    made = sweep.run_sweep([{"set_id": k, "k": k} for k in range(5)], run, slots=1, limit=8.0)
    assert [(r["status"], r["rows"]) for r in made] == [("completed", 0), ("timed out", 0), ("completed", 2), ("failed", 0), ("completed", 4)]
    assert time.perf_counter() - begin < 60
    assert spark.range(7).count() == 7  # later jobs are not cancelled


def test_miners_end_at_their_limit(spark):
    """All sets of 26 items would be 67 million; the closed ones are two."""
    baskets = spark.createDataFrame([(list(range(26)),)] * 30 + [([1],)], "items array<long>")
    status, found, _ = sweep.limited(lambda: mining.frequent_itemsets(baskets, 2).count(), 4.0)
    assert (status, found) == ("timed out", None)
    assert sweep.limited(lambda: patterns.closed_itemsets(baskets, 2).count(), None) == ("completed", 2, "")
    assert sweep.limited(lambda: patterns.maximal_itemsets(baskets, 2).count(), 120.0) == ("completed", 1, "")


def test_a_run_of_many_jobs_ends_too(spark):
    def run(values):
        while True:
            spark.range(10).count()

    assert sweep.run_sweep([{"set_id": 0}], run, limit=1.0)[0]["status"] == "timed out"


def test_a_killed_sweep_goes_on(spark, tmp_path):
    sets = spark.range(10).select(F.col("id").alias("set_id"), (F.col("id") * 2).alias("value"))
    status, ran = sweep.SweepStatus(spark, f"file://{tmp_path}/status"), []

    def run(values, batch):
        if len(ran) == 5:
            ran.append("killed")
            raise KeyboardInterrupt
        ran.append((values["set_id"], sweep.fill_template("%0 on %N", [values["value"]], batch)))
        if values["set_id"] == 1:
            raise ValueError("flagged")
        return values["value"]

    assert status.read().count() == 0
    with pytest.raises(KeyboardInterrupt):
        sweep.run_batches(sets, status, 4, run, slots=1)
    assert {r["set_id"] for r in status.read().collect()} == {0, 1, 2, 3}
    begun = len(ran)
    made = sweep.run_batches(sets, status, 4, run, slots=1)
    assert ran[:5] == [(k, f"{2 * k} on {k // 4}") for k in range(5)]
    assert ran[begun:] == [(k, f"{2 * k} on {k // 4}") for k in range(4, 10)]
    got = {r["set_id"]: (r["batch"], r["status"], r["n_groups"]) for r in made.collect()}
    assert got == {k: (k // 4, "failed" if k == 1 else "completed", 0 if k == 1 else 2 * k) for k in range(10)}
    assert sweep.run_batches(sets, status, 4, run, slots=1).count() == 10 and len(ran) == begun + 6


def test_stages_count_themselves(spark):
    search = Discovery(event_samples(spark, "/root/testdata/sf0.001"))
    found = {"enumerated": search.enumerated(Level(5, 5, 5)), "itemsets": search.itemsets(Level(5, 5, 5), 4), "cliques": search.cliques(Level(5, 5, 5), 4)}
    got = {r["stage"]: r for r in search.stage_metrics().collect()}
    for stage, df in found.items():
        assert got[stage]["rows"] == df.count()
        assert got[stage]["chars"] == sum(len(str(v).replace(" ", "")) + (len(v) - 1 if isinstance(v, list) else 0) for r in df.collect() for v in r)
    none = Discovery(event_samples(spark, "/root/testdata/sf0.001"))
    none.cliques(Level(0, 0, 0), 1000)
    assert [r["rows"] for r in none.stage_metrics().orderBy("line").collect()][1:] == [0, 0]
