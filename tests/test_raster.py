"""The first rows of hot groups, and drawn groups."""

import random

import pytest
from pyspark.sql import functions as F

from driftmesh.model import Viewport
from driftmesh.operators import raster, viewport
from driftmesh.operators.ranking import first_of

SCHEMA = "trajectory_idx long, trajectory_id long, seq long, x long, y long, t long"


def test_a_group_of_all_rows_is_cut_in_parts(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("g"), (F.col("id") * 7919 % 20_011).alias("v"))
    got = sorted(tuple(r) for r in first_of(rows, ["g"], ["v"], 4, "v", "r").collect())
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r["g"], []).append(r["v"])
    assert got == sorted((g, v, k + 1) for g, vs in by_group.items() for k, v in enumerate(sorted(vs)[:4]))
    plan = first_of(rows, ["g"], ["v"], 4, "v", "r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # rows are cut before each exchange


def test_shown_members(spark):
    groups = spark.createDataFrame([(0, k) for k in range(50, 0, -1)] + [(1, 5), (2, 7), (2, 6), (40, 1), (40, 2)], "group_id long, trajectory_idx long")
    view = Viewport(10, 10, 0, 0, 10, 10, mask=0b111)
    assert sorted(map(tuple, viewport.shown_members(groups, view).collect())) == [(0, 1), (0, 2), (0, 3), (0, 4), (2, 6), (2, 7)]


def slow_pixels(path, size, pixels):
    at = [(x * pixels // size, int(pixels - y * pixels / size // 1) if (y * pixels) % size == 0 else pixels - y * pixels // size - 1) for x, y in path]
    found = {at[0]}
    for (ax, ay), (bx, by) in zip(at, at[1:]):
        n = max(abs(bx - ax), abs(by - ay))
        found |= {(ax + (2 * k * (bx - ax) + n) // (2 * n), ay + (2 * k * (by - ay) + n) // (2 * n)) for k in range(n + 1) if n}
    return found


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(4)
    paths = [[(rng.randrange(64), rng.randrange(64)) for _ in range(rng.choice([1, 2, 9]))] for _ in range(8)]
    samples = spark.createDataFrame([(i, i, s, *p, s) for i, path in enumerate(paths) for s, p in enumerate(path)], SCHEMA)
    return paths, raster.strokes(samples, F.lit(64), 32, 32)


def test_strokes(drawn):
    paths, made = drawn
    rows = made.collect()
    assert len(rows) == len(set(map(tuple, rows)))
    for i, path in enumerate(paths):
        assert {(r["px"], r["py"]) for r in rows if r["trajectory_idx"] == i} == slow_pixels(path, 64, 32)


def test_images(spark, drawn):
    paths, made = drawn
    results = spark.createDataFrame([(0, 5, 0), (0, 5, 1), (0, 3, 2), (0, 3, 3), (0, 9, 4), (0, 8, 5), (1, 1, 6)], "set_id long, group_id long, trajectory_idx long")
    top = raster.top_of_each(results, 3)
    assert sorted(map(tuple, top.collect())) == [(0, 1, 3, 2), (0, 2, 5, 2), (0, 3, 8, 1), (1, 1, 1, 1)]
    layers = raster.layers(results, top)
    held = {(0, 1, 3): ((2, 3), 0), (0, 2, 5): ((0, 1), 1), (0, 3, 8): ((5,), raster.SINGLE), (1, 1, 1): ((6,), raster.SINGLE)}
    cover = [slow_pixels(p, 64, 32) for p in paths]
    split = {tuple(r) for r in raster.paint(made, layers, True).collect()}
    assert split == {(*key, *p, colour) for key, (own, colour) in held.items() for t in own for p in cover[t]}
    last = {}
    for (s, _, _), (own, colour) in sorted(held.items()):
        last |= {(s, *p): colour for t in own for p in cover[t]}
    assert {tuple(r)[:3]: r["colour"] for r in raster.paint(made, layers, False).collect()} == last
    assert {(r["px"], r["py"]) for r in raster.ground(made).collect()} == set().union(*cover)
    counted = raster.tiles(raster.paint(made, layers, False), ["set_id"], 8).agg(F.sum("n_pixels")).first()[0]
    assert counted == len(last)
