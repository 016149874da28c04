"""Named queries over the driver tables."""

from __future__ import annotations

import builtins
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.functions import geometry
from driftmesh.functions.grid import floor_log2, interleave
from driftmesh.model import Box, GeneratorConfig, Level, Viewport
from driftmesh.operators import cells, cliques, generate, grouping, mining, patterns, prepare, raster, slices, viewport
from driftmesh.plans import discovery, sweep
from driftmesh.plans.discovery import Discovery
from driftmesh.sources import binary, lines, printing, tables
from driftmesh.storage import fresh_path, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LEVEL = Level(5, 5, 5)
FINE = Level(2, 3, 2)
FINER = Level(2, 2, 2)
BOX = Box(2, 10, 200, 90)
VIEW = Viewport(width=400, height=300, top_x=0, top_y=10, bottom_x=150, bottom_y=90, resolution=4, mask=0b10111)
#: Largest groups of a result that are drawn.
TOP = 15
LISTS = {"space": ["3", "5", "9"], "time": ["2", "10"], "support": ["4", "15"]}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return tables.event_samples(spark, d)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return cells.rollup_samples(_samples(spark, d), LEVEL)


class _Found:
    """The stages that most queries begin with."""

    def __init__(self, spark: SparkSession, d: str, min_length: int = 1, kind: str = "all", level: Level = LEVEL, support: int | None = None):
        self.samples = materialize(_samples(spark, d), "samples")
        self.support = discovery.min_support(self.samples) if support is None else support
        search = Discovery(self.samples)
        self.search, self.kind, self.min_length, self.level = search, kind, min_length, level

    @property
    def enumerated(self) -> DataFrame:
        return self.search.enumerated(self.level)

    @property
    def itemsets(self) -> DataFrame:
        return mining.at_least(self.search.itemsets(self.level, self.support, self.kind), self.min_length)

    @property
    def linked(self) -> DataFrame:
        return self.search.linked(self.level, self.support, self.min_length, self.kind)

    @property
    def cliques(self) -> DataFrame:
        return self.search.cliques(self.level, self.support, self.min_length, self.kind)


def _fine(spark: SparkSession, d: str) -> _Found:
    """Pairs of small cells that two objects share: many small groups instead of one of all."""
    return _Found(spark, d, 2, level=FINE, support=2)


def _text(items: str = "items"):
    return F.array_join(F.transform(items, lambda i: i.cast("string")), ",")


# samples and statistics


@query
def load_samples(spark, d):
    return _samples(spark, d).drop("ord")


@query
def dataset_stats(spark, d):
    return prepare.dataset_meta(_samples(spark, d))


@query
def grid_extent(spark, d):
    return prepare.grid_extent(prepare.normalize_origin(_samples(spark, d)))


@query
def path_length_stats(spark, d):
    return prepare.path_lengths(_samples(spark, d))


@query
def trajectory_bbox(spark, d):
    return prepare.trajectory_bbox(_samples(spark, d))


@query
def box_filter(spark, d):
    return prepare.box_filter(_samples(spark, d), BOX).select("trajectory_idx", "seq", "x", "y", "t")


@query
def box_filter_reset(spark, d):
    wide = Box(0, 0, 200, 99)
    return prepare.box_filter_reset(_samples(spark, d), wide, "ord").select("trajectory_idx", "seq", "x", "y", "t")


@query
def normalize_origin(spark, d):
    return prepare.normalize_origin(_samples(spark, d)).select("trajectory_idx", "seq", "x", "y", "t")


@query
def interpolate_gaps(spark, d):
    return prepare.interpolate_gaps(_samples(spark, d)).drop("trajectory_id")


@query
def interpolate_orders(spark, d):
    return prepare.interpolate_gaps(tables.order_samples(spark, d)).drop("trajectory_id")


@query
def pad_paths(spark, d):
    return prepare.pad_paths(_samples(spark, d)).drop("trajectory_id")


@query
def compress_path(spark, d):
    rolled = cells.rollup_samples(_samples(spark, d), Level(7, 6, 5))
    return prepare.compress_path(rolled).select("trajectory_idx", "seq", "x", "y", "t")


@query
def singular_paths(spark, d):
    return prepare.singular_paths(cells.rollup_samples(_samples(spark, d), Level(9, 7, 5)))


@query
def verify_path(spark, d):
    return prepare.verify_path(_samples(spark, d))


@query
def heading_distance(spark, d):
    moved = prepare.moves(_samples(spark, d))
    return moved.select("trajectory_idx", "seq", F.round("distance", 6).alias("distance"), F.round("heading", 6).alias("heading"))


# grid


@query
def levels(spark, d):
    return cells.level_bits(_samples(spark, d))


@query
def rollup(spark, d):
    return _cells(spark, d).select("trajectory_idx", "seq", "x", "y", "t", *[F.col(c).cast("long").alias(c) for c in ("lx", "ly", "lt")])


@query
def rollup_shift(spark, d):
    return cells.rollup_samples(_samples(spark, d), LEVEL, shifted=True).select("trajectory_idx", "seq", "x", "y", "t")


@query
def cell_centres(spark, d):
    return cells.centre_cells(_cells(spark, d), LEVEL, Level(1, 2, 0)).select("trajectory_idx", "seq", "x", "y", "t")


@query
def unique_cells(spark, d):
    return cells.cell_dictionary(_cells(spark, d))


@query
def enumerate(spark, d):
    return cells.enumerate_cells(_cells(spark, d))


@query
def morton_codes(spark, d):
    code = interleave([F.col("x"), F.col("y")], 10)
    return _samples(spark, d).select("trajectory_idx", "seq", code.alias("code"))


# slices


@query
def timeslice(spark, d):
    return slices.timeslice(_samples(spark, d), 48, 36).select("slice_id", "trajectory_idx", "seq", "x", "y", "t")


@query
def timeslice_counts(spark, d):
    return slices.slice_sizes(_samples(spark, d), 48, 36)


# itemsets


@query
def item_support(spark, d):
    found = cells.enumerate_cells(_cells(spark, d))
    return mining.item_support(found, 5)


@query
def frequent_itemsets(spark, d):
    found = _Found(spark, d)
    return found.itemsets.select("itemset_id", _text().alias("items"), "n_items", "support")


@query
def itemset_histogram(spark, d):
    return mining.length_histogram(_Found(spark, d).itemsets)


def _supply(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Baskets of nations and regions, and a tenth of their number."""
    baskets = materialize(cells.baskets(tables.supply_items(spark, d)), "baskets")
    return baskets, -(-baskets.count() // 10)


@query
def closed_itemsets(spark, d):
    return patterns.closed_itemsets(*_supply(spark, d)).select(_text().alias("items"), "support")


@query
def maximal_itemsets(spark, d):
    return patterns.maximal_itemsets(*_supply(spark, d)).select(_text().alias("items"), "support")


# cliques and edges


@query
def match_cliques(spark, d):
    return _Found(spark, d).cliques


@query
def match_min_length(spark, d):
    return _Found(spark, d, min_length=3).cliques


@query
def comembership_bool(spark, d):
    return cliques.connections(_Found(spark, d, min_length=3).cliques)


def _rounded(edges: DataFrame) -> DataFrame:
    return edges.select("t1", "t2", F.round("w", 9).alias("w"))


@query
def weight_last(spark, d):
    found = _Found(spark, d, min_length=2)
    return _rounded(cliques.weight_last(found.cliques, found.itemsets, found.enumerated))


@query
def weight_max(spark, d):
    found = _Found(spark, d, min_length=2)
    return _rounded(cliques.weight_max(found.cliques, found.itemsets, found.enumerated, 0.045))


@query
def group_overlap(spark, d):
    return cliques.clique_overlap(_Found(spark, d, min_length=3).cliques)


# groups


@query
def group_cc(spark, d):
    return _fine(spark, d).linked


@query
def group_overlap_components(spark, d):
    found = _fine(spark, d)
    return found.search.overlapping(found.level, found.support, found.min_length, found.kind, 0.03)


@query
def topk_groups(spark, d):
    return grouping.topk_groups(_fine(spark, d).linked, 5)


@query
def group_both_symmetric(spark, d):
    found = _fine(spark, d)
    return found.search.groups(found.level, found.support, found.min_length, found.kind, "both", overlap=0.03, attach=0.5, edge_mode="symmetric")


@query
def group_both(spark, d):
    found = _fine(spark, d)
    return grouping.group_both(found.cliques, found.itemsets, found.enumerated, 0.03, 0.5)


@query
def group_nc(spark, d):
    return grouping.group_nc(_fine(spark, d).cliques, [0.3, 0.8])


@query
def group_wc(spark, d):
    found = _fine(spark, d)
    return grouping.group_wc(found.cliques, found.itemsets, found.enumerated, [0.01, 0.025])


@query
def group_attachment(spark, d):
    found = _fine(spark, d)
    return grouping.group_attachment(found.cliques, found.itemsets, [0.3, 0.5])


@query
def group_attachment_by_id(spark, d):
    found = _fine(spark, d)
    return grouping.group_attachment(found.cliques, found.itemsets, [0.2, 0.4], "id")


@query
def group_per_clique(spark, d):
    return grouping.clique_groups(_fine(spark, d).cliques)


@query
def merged_members(spark, d):
    """The union of the members of every two cliques that share one."""
    found = _fine(spark, d).cliques
    members = found.groupBy("itemset_id").agg(F.array_sort(F.collect_list("trajectory_idx")).alias("m"))
    pairs = cliques.clique_overlap(found).select("g1", "g2")
    both = pairs.join(members.toDF("g1", "a"), "g1").join(members.toDF("g2", "b"), "g2")
    return both.select("g1", "g2", _text(grouping.merge_members("a", "b")).alias("members"))


@query
def weight_mean(spark, d):
    found = _fine(spark, d)
    return _rounded(cliques.weighted(found.cliques, F.avg("w"), found.itemsets, found.enumerated))


@query
def edge_matrix(spark, d):
    """Weights to the first four trajectories, a column for each."""
    found = _fine(spark, d)
    edges = found.search.weights_to(found.level, found.support, found.min_length, [0, 1, 2, 3])
    made = cliques.edge_matrix(edges.withColumn("w", F.round("w", 9)), [0, 1, 2, 3])
    return made.select("t1", *[F.col(f"`{k}`").alias(f"w{k}") for k in range(4)])


@query
def supplied_groups(spark, d):
    """Groups found, unless others are supplied: here those of five."""
    known, samples = _fine(spark, d).linked, materialize(_samples(spark, d), "samples")
    return grouping.choose_groups(known, _groups_of_five(samples)).select("group_id", "trajectory_idx")


@query
def all_levels(spark, d):
    """How many groups there are at every spatial level, in slices of 32 hours."""
    samples = materialize(_samples(spark, d), "samples")
    search, support = Discovery(samples), discovery.min_support(samples)
    found = search.all_levels(3, 5, min_support=support, kind="all", strategy="cc")
    counts = [g.agg(F.count_distinct("group_id").alias("n_groups"), F.count("*").alias("n_members")).select(F.lit(n).cast("long").alias("n"), "*") for n, g in found.items()]
    return reduce(DataFrame.unionAll, counts)


@query
def fine_levels(spark, d):
    """Groups of objects that meet at least twice, at every spatial level of small cells, in slices of 4 hours."""
    search = Discovery(materialize(_samples(spark, d), "samples"))
    found = search.all_levels(3, 2, min_support=2, min_length=2, kind="closed", strategy="cc")
    counts = [
        g.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_members"), F.max("n").alias("largest")).select(F.lit(n).cast("long").alias("n"), "*")
        for n, g in found.items()
    ]
    return reduce(DataFrame.unionAll, counts)


@query
def largest_fine_groups(spark, d):
    """The whole search on small cells: closed sets, overlap of members' cells, components, the largest fifteen."""
    search = Discovery(materialize(_samples(spark, d), "samples"))
    return grouping.topk_groups(search.groups(FINER, 2, 2, "closed", "overlap", overlap=0.02), 15)


# views


def _groups_of_five(samples: DataFrame) -> DataFrame:
    return samples.select((F.col("trajectory_idx") % 5).alias("group_id"), "trajectory_idx").distinct()


@query
def viewport_points(spark, d):
    return viewport.pixels(_samples(spark, d), VIEW).select("trajectory_idx", "seq", "px", "py", "in_view")


@query
def viewport_polylines(spark, d):
    samples = materialize(_samples(spark, d), "samples")
    return viewport.polylines(samples, _groups_of_five(samples), VIEW)


@query
def canvas_points(spark, d):
    made = viewport.canvas_points(_samples(spark, d), F.lit(1024), 640, 480)
    return made.select("trajectory_idx", "seq", "cx", "cy")


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples, and the groups of three results as one table: by number, by components, one for each of the largest cliques."""
    found = _fine(spark, d)
    largest = found.search.largest_cliques(found.level, found.support, found.min_length, TOP)  # first, as links need shorter sets only
    made = [_groups_of_five(found.samples), found.linked, largest]
    named = [g.select(F.lit(k).cast("long").alias("set_id"), F.col("group_id").cast("long").alias("group_id"), "trajectory_idx") for k, g in builtins.enumerate(made)]
    return found.samples, materialize(reduce(DataFrame.unionAll, named), "results")


@query
def top_group_tiles(spark, d):
    """The largest groups of every result, an image for each: what they cover of its tiles."""
    samples, results = _results(spark, d)
    layers = raster.layers(results, raster.top_of_each(results, TOP))
    painted = raster.paint(raster.lines(samples, F.lit(1024), 300, 300), layers, split=True)
    return raster.tiles(painted, ["set_id", "rank", "group_id"], 30)


@query
def top_overlay_tiles(spark, d):
    """The largest groups of every result on one image each, and the layer of all trajectories below."""
    samples, results = _results(spark, d)
    drawn = materialize(raster.lines(samples, F.lit(1024), 300, 300), "drawn")
    painted = raster.paint(drawn, raster.layers(results, raster.top_of_each(results, TOP)), split=False)
    return raster.tiles(painted.select("set_id", "px", "py", "colour").unionAll(raster.ground(drawn)), ["set_id"], 30)


# sweeps


@query
def sweep_params(spark, d):
    return sweep.combinations(spark, LISTS)


def _bits(spark: SparkSession, d: str):
    return cells.level_bits(_samples(spark, d)).first()


@query
def sweep_feasible(spark, d):
    bits = _bits(spark, d)
    return sweep.feasible(sweep.combinations(spark, LISTS), bits["lx"], bits["lt"])


@query
def sweep_pending(spark, d):
    status = spark.range(12).filter("id % 3 = 0").withColumnRenamed("id", "set_id")
    return sweep.pending(sweep.combinations(spark, LISTS), status)


@query
def sweep_batches(spark, d):
    return sweep.batches(sweep.combinations(spark, LISTS), 5)


@query
def stage_stats(spark, d):
    found = _Found(spark, d, min_length=3)
    return found.search.stage_stats(LEVEL, found.support, 3, "all")


@query
def stage_metrics(spark, d):
    """Rows of each stage, as observed while it was written."""
    found = _Found(spark, d, min_length=3)
    found.cliques  # noqa: B018
    return found.search.stage_metrics().select("line", "stage", "rows")


def _level_sets(samples: DataFrame) -> DataFrame:
    """set_id, lt, support: the sets of a sweep over two time levels, from the ticks of the samples."""
    bits = cells.level_bits(samples).select(F.posexplode(F.array(F.col("lt") - 7, F.col("lt") - 5)).alias("k", "lt"))
    sets = bits.select("k", "lt", F.posexplode(F.array(F.lit(2), F.lit(3))).alias("j", "support"))
    return sets.select((F.col("k") * 2 + F.col("j")).cast("long").alias("set_id"), "lt", "support")


def _swept_levels(spark: SparkSession, d: str, stop_after: int | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    samples, status = materialize(_samples(spark, d), "samples"), sweep.SweepStatus(spark, fresh_path(spark, "sweep-status"))
    search, ran = Discovery(samples), []

    def run(values: dict, batch: int) -> int:
        if stop_after is not None and len(ran) >= stop_after:
            raise KeyboardInterrupt
        ran.append((values["set_id"], batch))
        return search.groups(Level(2, 3, values["lt"]), values["support"], 2, "closed").select("group_id").distinct().count()

    sets = _level_sets(samples)
    try:
        made = sweep.run_batches(sets, status, 2, run, slots=1)
    except KeyboardInterrupt:  # killed: what is done is kept, and the sweep goes on from there
        stop_after = None
        made = sweep.run_batches(sets, status, 2, run, slots=1)
    return made, ran


@query
def sweep_resumed(spark, d):
    """Groups at every set of a sweep that is killed in its second range and called again."""
    return _swept_levels(spark, d, stop_after=3)[0].select("set_id", "batch", "status", "n_groups")


# formats


@query
def dat_roundtrip(spark, d):
    return binary.unpack_trajectories(binary.pack_trajectories(_samples(spark, d)))


@query
def unq_text(spark, d):
    return lines.encode_cells(cells.cell_dictionary(_cells(spark, d)))


@query
def emp_text(spark, d):
    return lines.encode_enumerated(cells.enumerate_cells(_cells(spark, d)))


@query
def fi_text(spark, d):
    return lines.encode_itemsets(_Found(spark, d).itemsets)


@query
def cl_text(spark, d):
    return lines.encode_cliques(_Found(spark, d, min_length=3).cliques)


@query
def grp_text(spark, d):
    return lines.encode_groups(_fine(spark, d).linked)


# files, written and read again


def _dataset(spark: SparkSession, d: str) -> str:
    samples = materialize(_samples(spark, d), "samples")
    extent, path = prepare.grid_extent(samples).first(), fresh_path(spark, "dataset.dat")
    binary.write_dataset(path, samples, _groups_of_five(samples), extent["grid_size"], extent["max_t"])
    return path


def _text_file(made: DataFrame, name: str) -> DataFrame:
    path = fresh_path(made.sparkSession, name)
    lines.write_lines(made, path)
    return lines.read_lines(made.sparkSession, path)


@query
def dat_file(spark, d):
    return binary.read_samples(spark, _dataset(spark, d))


@query
def dat_file_header(spark, d):
    return binary.read_header(spark, _dataset(spark, d))


@query
def dat_file_groups(spark, d):
    return binary.read_known_groups(spark, _dataset(spark, d))


@query
def map_file(spark, d):
    made, path = materialize(_cells(spark, d), "cells"), fresh_path(spark, "cells.map")
    binary.write_map(path, made, (LEVEL.x, LEVEL.y, LEVEL.t))
    return binary.read_samples(spark, path, header=4).select("trajectory_idx", "seq", "x", "y", "t")


@query
def map_file_header(spark, d):
    made, path = materialize(_cells(spark, d), "cells"), fresh_path(spark, "cells.map")
    binary.write_map(path, made, (LEVEL.x, LEVEL.y, LEVEL.t))
    return binary.read_header(spark, path, ("lx", "ly", "lt", "n_trajectories"))


@query
def unq_file(spark, d):
    return lines.decode_cells(_text_file(lines.encode_cells(cells.cell_dictionary(_cells(spark, d))), "cells.unq"))


@query
def emp_file(spark, d):
    return lines.decode_enumerated(_text_file(lines.encode_enumerated(cells.enumerate_cells(_cells(spark, d))), "visits.emp"))


@query
def transaction_file(spark, d):
    made = _text_file(lines.encode_enumerated(cells.enumerate_cells(_cells(spark, d))), "visits.emp")
    return lines.decode_transactions(made).select("line", _text(F.array_sort("items")).alias("items"))


@query
def fi_file(spark, d):
    made = lines.decode_itemsets(_text_file(lines.encode_itemsets(_Found(spark, d).itemsets), "sets.fi"), 2)
    return made.select("itemset_id", _text().alias("items"), "n_items", "support")


@query
def cl_file(spark, d):
    return lines.decode_cliques(_text_file(lines.encode_cliques(_Found(spark, d, min_length=3).cliques), "cliques.cl"))


@query
def grp_file(spark, d):
    """Groups are named by their line, so by their order."""
    return lines.decode_groups(_text_file(lines.encode_groups(_fine(spark, d).linked), "groups.grp"))


@query
def csv_file(spark, d):
    """Raw points with a comment line before each trajectory's first one."""
    made = lines.encode_points(_samples(spark, d))
    noted = made.withColumn("text", F.when(F.col("line") % 7 == 0, F.concat(F.lit(" # seven\n"), "text", F.lit(",extra"))).otherwise(F.col("text")))
    return tables.as_samples(lines.decode_points(_text_file(noted, "points.csv"))).drop("ord")


@query
def sweep_list_file(spark, d):
    texts = spark.range(len(LISTS)).select(F.col("id").alias("line"), F.get(F.array(*[F.lit(", ".join(v)) for v in LISTS.values()]), F.col("id").cast("int")).alias("text"))
    return lines.decode_lists(_text_file(texts, "sweep.txt")).select("line", F.col("pos").cast("long").alias("pos"), "value")


# readable lines


@query
def print_dataset(spark, d):
    return printing.format_samples(binary.read_samples(spark, _dataset(spark, d)))


@query
def print_itemsets(spark, d):
    return printing.format_itemsets(_Found(spark, d, min_length=3).itemsets)


@query
def print_groups(spark, d):
    return printing.format_members(_fine(spark, d).linked)


@query
def print_edges(spark, d):
    found = _fine(spark, d)
    return printing.format_edges(cliques.weight_max(found.cliques, found.itemsets, found.enumerated))


# single functions


@query
def rotated_points(spark, d):
    x, y = geometry.rotate(F.col("x"), F.col("y"), 0.75, (100, 50))
    return _samples(spark, d).select("trajectory_idx", "seq", x.alias("rx"), y.alias("ry"))


@query
def scaled_points(spark, d):
    return _samples(spark, d).select("trajectory_idx", "seq", F.round(geometry.scale(F.col("x"), F.lit(600)), 6).alias("sx"))


@query
def log2_values(spark, d):
    return _samples(spark, d).filter("x > 0").select("trajectory_idx", "seq", floor_log2(F.col("x")).cast("long").alias("bits"))


@query
def path_without_time(spark, d):
    """Runs of one place, whatever the time: the dimensions are a choice."""
    return prepare.compress_path(cells.rollup_samples(_samples(spark, d), FINE), ("x", "y")).select("trajectory_idx", "seq", "x", "y", "t")


@query
def support_order(spark, d):
    return mining.by_support(mining.item_support(cells.enumerate_cells(_cells(spark, d)))).select("rank", "item_id", "support")


@query
def group_colours(spark, d):
    groups = _fine(spark, d).linked
    sized = groups.groupBy("group_id").agg(F.count("*").alias("n_members"))
    return sized.select("group_id", viewport.palette_index(F.col("group_id"), F.col("n_members")).cast("long").alias("colour"))


@query
def filled_templates(spark, d):
    made = [(k, sweep.fill_template("run %0 of %1 on %N, 100%%2 %9", [str(k), "b"], node=k + 7)) for k in range(3)]
    return spark.createDataFrame(made, "line long, text string")


@query
def parsed_levels(spark, d):
    made = [Level.parse(text) for text in ("5,5,3", "0,1,12")]
    return spark.createDataFrame([(level.x, level.y, level.t) for level in made], "x long, y long, t long")


@query
def swept_groups(spark, d):
    """Every feasible set of a sweep, run beside each other, with the groups it gave."""
    samples = materialize(_samples(spark, d), "samples")
    search, support = Discovery(samples), discovery.min_support(samples)

    def run(values: dict) -> int:
        level = Level(int(values["space"]), int(values["space"]), int(values["time"]))
        return search.groups(level, support, 1, "all").select("group_id").distinct().count()

    params = [r.asDict() for r in sweep.combinations(spark, {"space": ["4", "5"], "time": ["4", "5"]}).orderBy("set_id").collect()]
    made = sweep.run_sweep(params, run)
    return spark.createDataFrame([(r["set_id"], r["status"], r["rows"]) for r in made], "set_id long, status string, n_groups long")


@query
def generator_config(spark, d):
    """A configuration written and read back, and the noise objects it asks for."""
    config = GeneratorConfig.load(GeneratorConfig(movement="spiral", n_groups=3, group_size=10, noise=0.25, steps=80).dump())
    return spark.createDataFrame([(config.movement, config.n_groups, config.group_size, config.steps, config.n_singletons())], "movement string, n_groups long, group_size long, steps long, n_singletons long")


# generated data


def _generated(movement: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        config = GeneratorConfig(movement=movement, grid_size=1024, n_groups=6, group_size=8, avg_distance=20, steps=24, max_speed=60, noise=0.25, seed=999)
        return generate.generate(spark, config)[0]

    return run


for _name in generate.MOVEMENTS:
    QUERIES[f"datagen_{_name}"] = _generated(_name)


@query
def flagship(spark, d):
    return discovery.flagship(_samples(spark, d), 0.06)
