"""Column expressions on positions in the plane."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A full turn, to the precision that headings are reported in.
FULL_TURN = 3.141592654 * 2


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def heading(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The direction of a move in [0, full turn); 0 for no move or an unknown one."""
    far = distance(x1, y1, x2, y2)
    angle = F.acos((x2 - x1) / far)
    turned = F.when((y2 - y1) / far < 0, F.lit(FULL_TURN) - angle).otherwise(angle)
    return F.when(far > 0, turned).otherwise(F.lit(0.0))


def rotate(x: Column, y: Column, angle: float, centre: tuple[int, int]) -> tuple[Column, Column]:
    """A point turned about a centre; offsets are cut to whole numbers."""
    dx, dy = (x - centre[0]).cast("double"), (y - centre[1]).cast("double")
    cos, sin = math.cos(angle), math.sin(angle)
    return (dx * cos - dy * sin).cast("long") + centre[0], (dx * sin + dy * cos).cast("long") + centre[1]


def scale(value: Column, grid_size: Column, canvas: int = 1024) -> Column:
    return value * F.lit(float(canvas)) / grid_size


def to_canvas(x: Column, y: Column, grid_size: Column, width: int, height: int) -> tuple[Column, Column]:
    """Pixels of an image whose origin is at the upper left."""
    fx, fy = F.lit(float(width)) / grid_size, F.lit(float(height)) / grid_size
    return x * fx, F.lit(float(height)) - y * fy


def to_pixel(value: Column, top: int, bottom: int, pixels: int, resolution: int) -> Column:
    """The pixel of a coordinate in a viewport, cut towards zero to the resolution."""
    cut = ((value - top).cast("double") / F.lit((bottom - top) / pixels)).cast("long")
    step = F.lit(resolution).cast("long")
    return F.floor(F.abs(cut) / step).cast("long") * F.signum(cut.cast("double")).cast("long") * step
