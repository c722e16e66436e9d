"""Column expressions for voxel codes and 64-voxel words.

A voxel's code interleaves its coordinates, x in the lowest bit, so that `code >> 3` is the code of its octant one
level up and `code >> 6` (the block) is a 4 x 4 x 4 cube, whose voxels are the bits of one long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(x: Column, y: Column, z: Column, levels: int) -> Column:
    """Code of a voxel of a grid with 2 ** levels voxels a side."""
    code = F.lit(0)
    for bit in range(levels):
        for axis, c in enumerate((x, y, z)):
            one = F.shiftright(c, bit).bitwiseAND(F.lit(1))
            code = code.bitwiseOR(F.shiftleft(one, 3 * bit + axis))
    return code.cast("int")


def decode(code: Column, levels: int) -> tuple[Column, Column, Column]:
    def axis(a: int) -> Column:
        out = F.lit(0)
        for bit in range(levels):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(code, 3 * bit + a).bitwiseAND(F.lit(1)), bit))
        return out.cast("int")

    return axis(0), axis(1), axis(2)


def word(code: str) -> Column:
    """The long with the bit of a voxel set."""
    return F.expr(f"shiftleft(1L, cast({code} & 63 as int))")
