"""From samples to sets of grid cells: roll-up, dictionary, enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.functions.grid import bit_length, cell_centre, rollup, rollup_shifted
from driftmesh.model import DIMS, Level
from driftmesh.operators.ranking import rank_keys


def rollup_samples(samples: DataFrame, level: Level, shifted: bool = False) -> DataFrame:
    """Samples moved to the corners of their cells, with the level they are on."""
    cut = rollup_shifted if shifted else rollup
    cells = {d: cut(F.col(d), getattr(level, d)).cast("long") for d in DIMS}
    return samples.withColumns(cells).withColumns({f"l{d}": F.lit(getattr(level, d)) for d in DIMS})


def centre_cells(cells: DataFrame, level: Level, offset: Level = Level(0, 0, 0)) -> DataFrame:
    return cells.withColumns({d: cell_centre(F.col(d), getattr(level, d), getattr(offset, d)) for d in DIMS})


def level_bits(samples: DataFrame) -> DataFrame:
    """One row: the bits that the largest value of each dimension needs."""
    most = samples.agg(*[F.max(d).alias(d) for d in DIMS])
    return most.select(*[bit_length(F.col(d)).cast("long").alias(f"l{d}") for d in DIMS])


def cell_dictionary(cells: DataFrame) -> DataFrame:
    """item_id, x, y, t: distinct cells numbered in order of x, y, t."""
    return rank_keys(cells, list(DIMS), "item_id").select("item_id", *DIMS)


def enumerate_cells(cells: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """trajectory_idx, item_id: the distinct cells that each trajectory visits.

    A cell that a given dictionary lacks raises. Samples are made distinct before
    they meet the dictionary, so the join carries one row per visit at most.
    """
    known = cell_dictionary(cells) if dictionary is None else dictionary
    visits = cells.select("trajectory_idx", *DIMS).distinct()
    if dictionary is None:
        return visits.join(known, list(DIMS)).select("trajectory_idx", "item_id")
    lost = F.raise_error(F.lit("a cell is not in the dictionary")).cast("long")
    return visits.join(known, list(DIMS), "left").select("trajectory_idx", F.coalesce("item_id", lost).alias("item_id"))


def baskets(enumerated: DataFrame) -> DataFrame:
    """trajectory_idx, items: the sorted cells of each trajectory."""
    return enumerated.groupBy("trajectory_idx").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
