"""Column expressions on integer grid coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rollup(value: Column, bits: int) -> Column:
    """The lower corner of the cell of side 2**bits; negatives round down."""
    return F.shiftleft(F.shiftright(value, bits), bits)


def rollup_shifted(value: Column, bits: int) -> Column:
    """As ``rollup`` on a grid moved by half a cell, where a cell can be halved."""
    return rollup(value + F.lit(1 << (bits - 1)), bits) if bits >= 2 else rollup(value, bits)


def cell_centre(corner: Column, bits: int, offset: int = 0) -> Column:
    """The middle of a cell of side 2**bits, moved by ``offset``."""
    return corner + F.lit((1 << (bits - 1) if bits >= 2 else 0) + offset)


def bit_length(value: Column) -> Column:
    """Bits needed for a number; 0 for 0; negatives raise."""
    bad = F.raise_error(F.lit("bit_length of a negative number"))
    return F.when(value == 0, F.lit(0)).when(value < 0, bad.cast("int")).otherwise(F.length(F.bin(value)))


def floor_log2(value: Column) -> Column:
    """The whole part of the binary logarithm of a positive number."""
    return bit_length(value) - 1


def interleave(columns: list[Column], bits: int = 16) -> Column:
    """Morton code: the low ``bits`` bits of all columns, taken in turn."""
    n = len(columns)
    parts = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(1), n * b + i) for b in range(bits) for i, c in enumerate(columns)]
    code = parts[0]
    for part in parts[1:]:
        code = code.bitwiseOR(part)
    return code


def in_mask(mask: Column, group: Column) -> Column:
    """Whether bit ``group`` of a 32-bit mask is set; groups from 32 on never are."""
    bit = F.call_function("shiftright", mask.cast("long"), F.least(group, F.lit(32)).cast("int"))
    return (group < 32) & (bit.bitwiseAND(1) == 1)
