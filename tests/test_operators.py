"""Preparation, grid, slices, components, viewport, codecs, sweeps and generated data."""

import random

import pytest
from pyspark.sql import functions as F

from driftmesh.functions import geometry, grid
from driftmesh.model import Box, GeneratorConfig, Level, Viewport
from driftmesh.operators import agglomerate, cells, generate, prepare, slices, viewport
from driftmesh.operators.components import connected_components
from driftmesh.operators.ranking import rank_keys
from driftmesh.plans import sweep
from driftmesh.plans.discovery import Discovery
from driftmesh.sources import binary, lines

SCHEMA = "trajectory_idx long, trajectory_id long, seq long, x long, y long, t long"


def samples(spark, paths):
    rows = [(i, 100 + i, s, *p) for i, path in enumerate(paths) for s, p in enumerate(path)]
    return spark.createDataFrame(rows, SCHEMA)


def points(df, *more):
    return sorted(tuple(r) for r in df.select(*more, "trajectory_idx", "seq", "x", "y", "t").collect())


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, grid.rollup(lit(-5), 2), grid.rollup(lit(13), 2)) == (-8, 12)
    assert one(spark, *[grid.bit_length(lit(v)) for v in (0, 1, 1023, 1024)]) == (0, 1, 10, 11)
    assert one(spark, grid.rollup_shifted(lit(6), 3), grid.rollup_shifted(lit(1), 1)) == (8, 0)
    assert one(spark, grid.cell_centre(lit(8), 3, 1), grid.cell_centre(lit(8), 1)) == (13, 8)
    assert one(spark, grid.interleave([lit(3), lit(5)], 4)) == (0b100111,)
    assert one(spark, grid.floor_log2(lit(9))) == (3,)
    assert one(spark, grid.in_mask(lit(0b101), lit(2)), grid.in_mask(lit(0b101), lit(1)), grid.in_mask(lit(-1), lit(40))) == (True, False, False)
    x, y = geometry.rotate(lit(10), lit(0), 3.141592653589793 / 2, (0, 0))
    assert one(spark, x, y) == (0, 10)
    assert one(spark, geometry.heading(lit(0), lit(0), lit(0), lit(-3)), geometry.heading(lit(1), lit(1), lit(1), lit(1)))[1] == 0.0
    assert one(spark, geometry.scale(lit(64), lit(128)))[0] == 512.0
    assert one(spark, *[geometry.to_pixel(lit(v), 0, 10, 10, 4) for v in (-5, -3, 7)]) == (-4, 0, 4)
    with pytest.raises(Exception):
        one(spark, grid.bit_length(lit(-1)))


def test_interpolate(spark):
    df = prepare.interpolate_gaps(samples(spark, [[(0, 0, 0), (3, 6, 3)], [(0, 0, 0), (5, 5, 0)]]))
    assert points(df) == [(0, 0, 0, 0, 0), (0, 1, 0, 0, 1), (0, 2, 1, 2, 2), (0, 3, 3, 6, 3), (1, 0, 0, 0, 0), (1, 1, 5, 5, 0)]


def test_interpolated_rows_are_numbered_without_being_sorted(spark):
    paths = [[(0, 0, 0), (3, 6, 3), (4, 6, 3), (9, 9, 9)], [(1, 1, 5)]]
    df = prepare.interpolate_gaps(samples(spark, paths))
    assert [p[:2] for p in points(df)] == [(0, k) for k in range(11)] + [(1, 0)]
    assert [(t, x) for k, _, x, _, t in points(df) if k == 0][3:6] == [(3, 3), (3, 4), (4, 4)]
    made = df._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in made[: made.index("Generate explode")]


def test_padding(spark):
    df = prepare.pad_paths(samples(spark, [[(1, 1, 2)], [(0, 0, 0), (4, 4, 4)]]))
    assert [(t, x) for i, _, x, _, t in points(df) if i == 0] == [(t, 1) for t in range(5)]
    assert [t for i, _, _, _, t in points(df) if i == 1] == list(range(5))


def test_boxes(spark):
    df = samples(spark, [[(1, 1, 0), (2, 2, 1), (50, 1, 2), (3, 3, 3)], [(1, 1, 0)]]).withColumn("ord", F.col("seq"))
    box = Box.parse("0,0,10,10")
    assert [p[:2] for p in points(prepare.box_filter_reset(df, box, "ord"))] == [(0, 3), (1, 0)]
    assert [p[:2] for p in points(prepare.box_filter(df, box))] == [(0, 0), (0, 1), (0, 3), (1, 0)]


def test_paths(spark):
    df = samples(spark, [[(1, 1, 0), (1, 1, 1), (2, 1, 2), (2, 1, 5)], [(7, 7, 3), (7, 7, 4)]])
    assert [p[:2] for p in points(prepare.compress_path(df, ("x", "y")))] == [(0, 0), (0, 2), (1, 0)]
    assert {tuple(r) for r in prepare.singular_paths(df).collect()} == {(0, False), (1, True)}
    assert [tuple(r) for r in prepare.verify_path(df).collect()] == [(0, 3, 5, 3)]
    assert tuple(prepare.path_lengths(df).first()) == (2, 4, 3.0)
    assert min(p[2] for p in points(prepare.normalize_origin(df))) == 0


def test_cells(spark):
    df = samples(spark, [[(x, x * x % 50, x) for x in range(40)], [(x, 3, x) for x in range(0, 40, 7)]])
    sizes = []
    for bits in range(6):
        rolled = cells.rollup_samples(df, Level(bits, bits, bits))
        assert points(cells.rollup_samples(rolled, Level(bits, bits, bits))) == points(rolled)
        sizes.append(cells.cell_dictionary(rolled).count())
    assert sizes == sorted(sizes, reverse=True)
    known = cells.cell_dictionary(df)
    ordered = [tuple(r) for r in known.orderBy("item_id").collect()]
    assert [r[0] for r in ordered] == list(range(len(ordered)))
    assert [r[1:] for r in ordered] == sorted(r[1:] for r in ordered)
    assert cells.enumerate_cells(df).count() == cells.enumerate_cells(df, known).count()
    with pytest.raises(Exception, match="dictionary"):
        cells.enumerate_cells(df, known.limit(1)).collect()


def test_slices(spark):
    def of(ticks, size, step):
        df = slices.tick_slices(samples(spark, [[(0, 0, t) for t in ticks]]), size, step)
        found = {}
        for r in df.collect():
            found.setdefault(r["slice_id"], []).append(r["t"])
        return [sorted(found[k]) for k in sorted(found)]

    assert of(range(5), 2, 2) == [[0, 1], [2, 3], [4]]
    assert of([0, 10, 20], 2, 1) == [[0, 10], [10, 20], [20]]
    assert of(range(5), 1, 2) == [[0], [2], [4]]
    df = samples(spark, [[(0, 0, t) for t in range(6)], [(1, 1, 0)]])
    assert slices.timeslice(df, 2, 2).count() == df.count()
    assert {tuple(r) for r in slices.slice_sizes(df, 3, 3).collect()} == {(0, 0, 3), (1, 0, 3), (0, 1, 1), (1, 1, 0)}


def test_ranking(spark):
    values = random.Random(1).sample(range(10000), 500)
    df = spark.createDataFrame([(v // 10, v % 10) for v in values + values], "a long, b long")
    got = sorted((r["n"], r["a"], r["b"]) for r in rank_keys(df, ["a", "b"], "n").collect())
    assert got == [(n, *k) for n, k in enumerate(sorted({(v // 10, v % 10) for v in values}))]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(7, 7), (500, 501), (501, 500)]
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    while True:
        change = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                change = True
        if not change:
            break
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_merge(groups, strength, threshold, update=None):
    """Merging by its definition: all pairs again after every merge, in list order."""
    groups = [(k, sorted(set(g))) for k, g in enumerate(groups)]
    table = {(a[0], b[0]): strength(groups, i, j, threshold) for i, a in enumerate(groups) for j, b in enumerate(groups)}
    while True:
        best, pair = 0.0, None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                if table[groups[i][0], groups[j][0]] > best:
                    best, pair = table[groups[i][0], groups[j][0]], (i, j)
        if pair is None:
            return [g for _, g in groups]
        (name, a), (_, b) = (groups[k] for k in pair)
        groups = [g for k, g in enumerate(groups) if k not in pair] + [(name, sorted({*a, *b}))]
        for i, (other, _) in enumerate(groups[:-1]):
            table[other, name] = table[name, other] = strength(groups, i, len(groups) - 1, threshold)
        if update:
            update(name, best)


@pytest.mark.parametrize("seed", range(25))
def test_merging(seed):
    rng = random.Random(seed)
    groups = [sorted(rng.sample(range(9), rng.randint(1, 4))) for _ in range(rng.randint(2, 8))]
    weights = {(a, b): rng.choice([0.0, 0.25, 0.5, 1.0]) for a in range(9) for b in range(a, 9)}
    weights |= {(b, a): w for (a, b), w in weights.items()}
    threshold = rng.choice([0.0, 0.25, 0.5, 0.75])

    def by_weight(gs, i, j, th):
        a, b = gs[i][1], gs[j][1]
        rows = [sum(weights[y, x] for y in b) for x in a]
        cols = [sum(weights[y, x] for x in a) for y in b]
        if any(r / len(b) < th for r in rows) or any(c / len(a) < th for c in cols):
            return 0.0
        return sum(rows) + sum(cols)

    assert agglomerate.merge_by_weight(groups, weights, threshold) == brute_merge(groups, by_weight, threshold)
    for index in ("position", "id"):
        values = [float(rng.randint(1, 5)) for _ in groups]
        own = list(values)

        def attached(gs, i, j, th, own=own, index=index):
            a, b = set(gs[i][1]), set(gs[j][1])
            shared = len(a & b)
            if shared / len(a) < th or shared / len(b) < th:
                return 0.0
            x, y = (i, j) if index == "position" else (gs[i][0], gs[j][0])
            return (own[x] + own[y]) / 2

        def update(name, best, own=own):
            own[name] = best

        assert agglomerate.merge_by_attachment(groups, values, threshold, index) == brute_merge(groups, attached, threshold, update)


def test_directed_components():
    upper = {(0, 1), (0, 2), (1, 2)}
    assert agglomerate.directed_components([0, 1, 2], upper) == [[0, 1]]
    assert agglomerate.directed_components([0, 1, 2], upper | {(b, a) for a, b in upper}) == [[0, 1, 2]]


def test_many_groups_merge():
    """More groups than a square table of pairs would hold; only those with common members meet."""
    groups = [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(6000)] + [[3 * k, 3 * k + 1] for k in range(0, 6000, 2)]
    made = agglomerate.merge_by_attachment(groups, [float(len(g)) for g in groups], 0.5, "id")
    assert sorted(made) == sorted(groups[:6000])
    assert len(agglomerate.merge_by_connections(groups[:6000], {(a, b) for g in groups for a in g for b in g}, 0.9)) == 6000


def test_polylines(spark):
    df = samples(spark, [[(0, 0, 0), (-5, 5, 1), (5, 5, 2), (5, 5, 3), (50, 5, 4), (60, 5, 5), (6, 6, 6)], [(1, 1, 0), (2, 2, 1)], [(3, 3, 0), (4, 4, 1)]])
    groups = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (2, 0), (2, 1)], "group_id long, trajectory_idx long")
    view = Viewport(10, 10, 0, 0, 10, 10, mask=0b011)
    got = {}
    for r in viewport.polylines(df, groups, view).orderBy("segment", "ord").collect():
        got.setdefault((r["group_id"], r["trajectory_idx"], r["segment"]), []).append((r["px"], r["py"]))
    assert got == {(0, 0, 1): [(-5, 5), (5, 5), (50, 5)], (0, 0, 2): [(60, 5), (6, 6)], (0, 1, 1): [(2, 2)]}


def test_binary(spark, tmp_path):
    df = samples(spark, [[(1, -2, 3), (4, 5, 6)], [], [(7, 8, 9)]][::2])
    groups = spark.createDataFrame([(4, 0), (4, 1), (9, 1)], "group_id long, trajectory_idx long")
    path = str(tmp_path / "data.dat")
    binary.write_dataset(path, df, groups, 64, 9)
    assert points(binary.read_samples(spark, path)) == points(df)
    assert sorted(map(tuple, binary.read_known_groups(spark, path).collect())) == [(4, 0), (4, 1), (9, 1)]
    assert tuple(binary.read_header(spark, path).first()) == (64, 9, 2)
    binary.write_map(str(tmp_path / "cells.map"), df, (1, 2, 3))
    assert points(binary.read_samples(spark, str(tmp_path / "cells.map"), header=4)) == points(df)


def test_text(spark, tmp_path):
    def text(*rows):
        return spark.createDataFrame(list(enumerate(rows)), "line long, text string")

    found = lines.decode_itemsets(text("3 1 x 2 (7)", "4 (2)", "broken"), 2).collect()
    assert [(r["itemset_id"], r["items"], r["support"]) for r in found] == [(0, [1, 2, 3], 7)]
    assert sorted(map(tuple, lines.decode_cliques(text("5: 1 2", "bad: 3", "6: 4 y")).collect())) == [(5, 1), (5, 2), (6, 4)]
    assert sorted(map(tuple, lines.decode_points(text("# c", "1,2,3,4,5", "  # d", "7,8,9,10", "zz")).select("trajectory_id", "x", "y", "t").collect())) == [(1, 3, 4, 2), (7, 9, 10, 8)]
    assert [tuple(r) for r in lines.decode_cells(text("(1, -2, 3)")).collect()] == [(0, 1, -2, 3)]
    assert sorted(map(tuple, lines.decode_groups(text("1 2", "3")).collect())) == [(0, 1), (0, 2), (1, 3)]
    assert [tuple(r) for r in lines.decode_transactions(text("2 1", "", "x")).collect()] == [(0, [2, 1])]
    assert [tuple(r) for r in lines.decode_lists(text("a, b", "c")).orderBy("line", "pos").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    enumerated = spark.createDataFrame([(t, t * i) for t in range(1, 30) for i in range(1, 5)], "trajectory_idx long, item_id long")
    encoded = lines.encode_enumerated(enumerated)
    assert sorted(map(tuple, lines.decode_enumerated(encoded).collect())) == sorted({(t, t * i) for t in range(1, 30) for i in range(1, 5)})
    path = str(tmp_path / "text")
    lines.write_lines(encoded, path)
    read = lines.read_lines(spark, path).orderBy("line").collect()
    assert [r["line"] for r in read] == list(range(29))
    assert [r["text"] for r in read] == [r["text"] for r in encoded.orderBy("line").collect()]


def test_sweep(spark):
    params = sweep.combinations(spark, {"space": ["1", "9"], "time": ["2"]})
    assert sorted(tuple(r) for r in params.collect()) == [(0, "1", "2"), (1, "9", "2")]
    assert [tuple(r) for r in sweep.feasible(params, 5, 4).collect()] == [(0, "1", "2", 4, 2)]
    assert [r["set_id"] for r in sweep.pending(params, spark.createDataFrame([(0,)], "set_id long")).collect()] == [1]
    assert sweep.fill_template("run %0 -t %1 on %N %%7", ["a", "b"], 3) == "run a -t b on 3 %%7"
    done = sweep.run_sweep([{"n": 1}, {"n": 0}], lambda p: 1 // p["n"])
    assert [d["status"] for d in done] == ["completed", "failed"]


@pytest.mark.parametrize("movement", list(generate.MOVEMENTS))
def test_generator(spark, movement):
    config = GeneratorConfig(movement=movement, grid_size=512, n_groups=4, group_size=5, avg_distance=10, steps=12, max_speed=40, noise=0.5, seed=7)
    made, known = generate.generate(spark, config)
    rows = points(made)
    assert len({r[0] for r in rows}) == 20 + 20 and len(rows) == 40 * 12
    assert {r[0] for r in rows} == set(range(40))
    for index in range(40):
        assert [r[4] for r in rows if r[0] == index] == list(range(12))
    sizes = sorted(r["count"] for r in known.groupBy("group_id").count().collect())
    assert sizes == [1] * 20 + [5] * 4
    assert points(generate.generate(spark, config)[0]) == rows
    assert GeneratorConfig.load(config.dump()) == config


@pytest.mark.parametrize("turned", [False, True])
def test_arcs_are_parabolas(turned):
    """Equal steps along an arc have equal second differences, and arcs get flatter and stay in the frame."""
    config = GeneratorConfig(movement="parabola", n_groups=6, steps=21)
    for nested in (False, True):
        walk, bends = generate._arc(nested, turned), []
        for k in range(6):
            path = [complex(*p) for p in walk(config, random.Random(1), (10, 10, 500, 500), k, 21)]
            second = [a - 2 * b + c for a, b, c in zip(path, path[1:], path[2:])]
            assert max(abs(s - second[0]) for s in second) < 1e-9
            assert all(10 <= p.real <= 500 and 10 <= p.imag <= 500 for p in path)
            bends.append(abs(second[0]))
        arcs = bends if nested else bends[::2]
        assert arcs == sorted(arcs, reverse=True) and (nested or max(bends[1::2]) < 1e-9)


def test_noise_of_one_is_refused():
    with pytest.raises(ValueError):
        GeneratorConfig(noise=1.0).n_singletons()


def test_planted_groups_are_found(spark):
    config = GeneratorConfig(movement="random", grid_size=1024, n_groups=3, group_size=6, avg_distance=2, deviation=[[0, 1.0]], steps=12, max_speed=150, noise=0.0, seed=3)
    made, known = generate.generate(spark, config)
    groups = Discovery(made).groups(Level(6, 6, 0), 3, 3, strategy="cc")
    planted = {r["trajectory_idx"]: r["group_id"] for r in known.collect()}
    for r in groups.groupBy("group_id").agg(F.collect_set("trajectory_idx").alias("m")).collect():
        assert len({planted[m] for m in r["m"]}) == 1


def test_streaming(spark, tmp_path):
    from driftmesh.streaming.ticks import windowed_cells

    folder = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,id) as ts, id * 10 as x, 5L as y from range(6)").write.parquet(folder)
    stream = spark.readStream.schema("ts timestamp, x long, y long").parquet(folder)
    query = windowed_cells(stream, 4).writeStream.format("memory").queryName("cells").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(n_samples) s from cells").first()["s"] == 24


def test_entry_without_optional_parts(spark):
    import __spark_entry__

    named = __spark_entry__.queries()
    assert "flagship" in named and set(__spark_entry__.oracle_sql()) <= set(named)


def test_printing(spark, tmp_path, capsys):
    from driftmesh.sources import printing

    df = samples(spark, [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9)]])
    binary.write_dataset(str(tmp_path / "d.dat"), df, None, 16, 9)
    printing.scan_and_print(spark, str(tmp_path / "d.dat"))
    assert capsys.readouterr().out.splitlines() == ["  100: (1, 2, 3) (4, 5, 6)", "  101: (7, 8, 9)"]
    groups = spark.createDataFrame([(2, 7), (2, 5)], "group_id long, trajectory_idx long")
    assert [r["text"] for r in printing.format_members(groups).collect()] == ["2 (2): 5 7"]
    sets = spark.createDataFrame([(0, [3, 4], 2)], "itemset_id long, items array<long>, support long")
    assert [r["text"] for r in printing.format_itemsets(sets).collect()] == ["0: {3 4} x 2"]
    edges = spark.createDataFrame([(1, 3, 0.5), (1, 2, 1.0)], "t1 long, t2 long, w double")
    assert [r["text"] for r in printing.format_edges(edges).collect()] == ["2:1.000000 3:0.500000"]
