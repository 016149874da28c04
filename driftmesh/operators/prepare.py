"""Cleaning and completing trajectories: one row per sample in, one per sample out.

Sequence operators window over one trajectory at a time in (t, seq) order, so they
share one exchange on trajectory_idx; statistics are combined before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from driftmesh.functions.geometry import distance, heading
from driftmesh.model import DIMS, Box

def path_window() -> WindowSpec:
    """A trajectory's samples in order; made late, as a window needs a session."""
    return Window.partitionBy("trajectory_idx").orderBy("t", "seq")


def in_box(box: Box) -> Column:
    x, y = F.col("x"), F.col("y")
    return (x >= box.left) & (x < box.right) & (y >= box.top) & (y < box.bottom)


def box_filter(samples: DataFrame, box: Box) -> DataFrame:
    return samples.filter(in_box(box))


def box_filter_reset(samples: DataFrame, box: Box, order: str) -> DataFrame:
    """What follows a trajectory's last row outside the box, in the order of ``order``."""
    last_out = samples.filter(~in_box(box)).groupBy("trajectory_idx").agg(F.max(order).alias("__out"))
    joined = samples.join(last_out, "trajectory_idx", "left")
    return joined.filter(F.col("__out").isNull() | (F.col(order) > F.col("__out"))).drop("__out")


def dataset_meta(samples: DataFrame) -> DataFrame:
    """One row: least and largest coordinates, rows and trajectories."""
    bounds = [f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("min", F.min), ("max", F.max))]
    return samples.agg(*bounds, F.count("*").alias("n_samples"), F.count_distinct("trajectory_idx").alias("n_trajectories"))


def normalize_origin(samples: DataFrame) -> DataFrame:
    """Coordinates counted from the least of each dimension."""
    least = samples.agg(*[F.min(d).alias(f"__{d}") for d in DIMS])
    moved = samples.join(F.broadcast(least))  # one row
    return moved.select(*[(F.col(c) - F.col(f"__{c}")).alias(c) if c in DIMS else F.col(c) for c in samples.columns])


def grid_extent(samples: DataFrame) -> DataFrame:
    """grid_size and max_t of a dataset whose origin is normalised."""
    size = samples.agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("t").alias("t"))
    return size.select(F.greatest("x", "y").cast("long").alias("grid_size"), F.col("t").cast("long").alias("max_t"))


def _renumbered(samples: DataFrame) -> DataFrame:
    return samples.withColumn("seq", (F.row_number().over(path_window()) - 1).cast("long"))


def interpolate_gaps(samples: DataFrame) -> DataFrame:
    """A row for every tick between two samples, on the line between them.

    The first filled tick repeats the sample before the gap. Samples of one tick
    are all kept. Rows are numbered from the gaps before them, so only samples are
    sorted, not the many more rows that are made of them.
    """
    before = {d: F.lag(d).over(path_window()) for d in DIMS}
    with_gap = samples.select("*", *[before[d].alias(f"__{d}") for d in DIMS]).withColumn("__gap", F.col("t") - F.col("__t"))
    with_gap = with_gap.withColumn("__made", F.greatest(F.coalesce("__gap", F.lit(1)), F.lit(1)))
    so_far = F.sum("__made").over(path_window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.sequence(F.lit(0).cast("long"), F.col("__made") - 1)
    rows = with_gap.withColumn("__before", so_far - F.col("__made")).withColumn("__i", F.explode(at))
    is_end = F.coalesce(F.col("__gap"), F.lit(1)) - 1 <= F.col("__i")

    def on_line(d: str) -> Column:
        rate = (F.col(d) - F.col(f"__{d}")).cast("double") / F.col("__gap").cast("double")
        return F.when(is_end, F.col(d)).otherwise(F.col(f"__{d}") + (F.col("__i") * rate).cast("long"))

    t = F.when(is_end, F.col("t")).otherwise(F.col("__t") + F.col("__i") + 1)
    seq = (F.col("__before") + F.col("__i")).cast("long")
    return rows.select("trajectory_idx", "trajectory_id", seq.alias("seq"), on_line("x").alias("x"), on_line("y").alias("y"), t.alias("t"))


def pad_paths(samples: DataFrame) -> DataFrame:
    """Interpolated paths that all start at the first tick and have a row per tick.

    The first position is repeated before, the last one after, until the path has as
    many rows as the dataset has ticks; a path with doubled ticks gets fewer.
    """
    span = samples.agg(F.min("t").alias("__min"), (F.max("t") - F.min("t") + 1).alias("__ticks"))
    path = interpolate_gaps(samples)
    whole = Window.partitionBy("trajectory_idx").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = path.join(F.broadcast(span)).select(  # one row
        "*", F.row_number().over(path_window()).alias("__row"), F.count("*").over(whole).alias("__n"), F.first("t").over(whole).alias("__first")
    )
    none = F.array().cast("array<bigint>")
    front = F.when((F.col("__row") == 1) & (F.col("t") > F.col("__min")), F.sequence(F.col("__min"), F.col("t") - 1)).otherwise(none)
    missing = F.col("__ticks") - F.col("__n") - (F.col("__first") - F.col("__min"))
    back = F.when((F.col("__row") == F.col("__n")) & (missing > 0), F.sequence(F.col("t") + 1, F.col("t") + missing)).otherwise(none)
    ticks = F.explode(F.concat(front, F.array(F.col("t")), back))
    padded = rows.select("trajectory_idx", "trajectory_id", "seq", "x", "y", ticks.alias("t"))
    return _renumbered(padded)


def compress_path(samples: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """The first row of every run of equal positions."""
    here = F.struct(*dims)
    return samples.withColumn("__same", F.lag(here).over(path_window()).eqNullSafe(here)).filter(~F.col("__same")).drop("__same")


def singular_paths(samples: DataFrame, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Per trajectory, whether it never changes in ``dims``."""
    still = [F.min(d).eqNullSafe(F.max(d)) for d in dims]
    together = still[0]
    for part in still[1:]:
        together = together & part
    return samples.groupBy("trajectory_idx").agg(together.alias("singular"))


def verify_path(samples: DataFrame) -> DataFrame:
    """Rows whose tick does not follow the one before: trajectory_idx, seq, t, step."""
    stepped = samples.withColumn("step", F.col("t") - F.lag("t").over(path_window()))
    return stepped.filter(F.col("step") != 1).select("trajectory_idx", "seq", "t", "step")


def path_lengths(samples: DataFrame) -> DataFrame:
    """One row: shortest, longest and mean number of samples."""
    lengths = samples.groupBy("trajectory_idx").agg(F.count("*").alias("n"))
    return lengths.agg(F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.avg("n").alias("avg_length"))


def trajectory_bbox(samples: DataFrame) -> DataFrame:
    bounds = [f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("min", F.min), ("max", F.max))]
    return samples.groupBy("trajectory_idx").agg(*bounds)


def moves(samples: DataFrame) -> DataFrame:
    """Every sample but a path's last with the distance and heading to the next."""
    nx, ny = F.lead("x").over(path_window()), F.lead("y").over(path_window())
    x, y = F.col("x"), F.col("y")
    ahead = samples.select("*", nx.alias("__x"), ny.alias("__y")).filter(F.col("__x").isNotNull())
    to = (x, y, F.col("__x"), F.col("__y"))
    return ahead.withColumn("distance", distance(*to)).withColumn("heading", heading(*to)).drop("__x", "__y")
