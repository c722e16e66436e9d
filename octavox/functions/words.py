"""Bit arithmetic on words: a word is a 4 x 4 x 4 cube whose bit 6 numbers are x0 y0 z0 x1 y1 z1 of the cell inside it.

A step along an axis moves bits inside a word by fixed amounts and carries one layer into the next block, so that 64
voxels are moved at a time. Blocks are numbered like voxels, by interleaved coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six directions: axis (0: x, 1: y, 2: z) and sign.
SIX = [(axis, sign) for axis in range(3) for sign in (1, -1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def layer(axis: int, at: int) -> int:
    """The cells of a word whose coordinate along the axis is `at` (0 to 3), as a signed long."""
    return _signed(sum(1 << b for b in range(64) if (b >> axis & 1) + 2 * (b >> (axis + 3) & 1) == at))


def _masked(word: Column, axis: int, *at: int) -> Column:
    return word.bitwiseAND(F.lit(_signed(sum(layer(axis, k) & (1 << 64) - 1 for k in at))))


def inner(word: Column, axis: int, sign: int) -> Column:
    """The word moved by one cell; the layer that leaves it is lost."""
    one, two = 1 << axis, 7 << axis
    if sign > 0:
        return F.shiftleft(_masked(word, axis, 0, 2), one).bitwiseOR(F.shiftleft(_masked(word, axis, 1), two))
    return F.shiftrightunsigned(_masked(word, axis, 1, 3), one).bitwiseOR(F.shiftrightunsigned(_masked(word, axis, 2), two))


def carried(word: Column, axis: int, sign: int) -> Column:
    """The layer that a step takes into the next block, at its place there."""
    return F.shiftrightunsigned(_masked(word, axis, 3), 9 << axis) if sign > 0 else F.shiftleft(_masked(word, axis, 0), 9 << axis)


def _axis_bits(axis: int, levels: int) -> int:
    return sum(1 << (3 * b + axis) for b in range(levels - 2))


def at_edge(block: Column, axis: int, sign: int, levels: int) -> Column:
    """True for blocks that have no next one in the direction."""
    own = block.bitwiseAND(F.lit(_axis_bits(axis, levels)))
    return own == (_axis_bits(axis, levels) if sign > 0 else 0)


def next_block(block: Column, axis: int, sign: int, levels: int) -> Column:
    bits, rest = _axis_bits(axis, levels), (1 << 3 * max(levels - 2, 1)) - 1 ^ _axis_bits(axis, levels)
    if sign > 0:
        moved = (block.bitwiseOR(F.lit(rest)) + 1).bitwiseAND(F.lit(bits))
    else:
        moved = (block.bitwiseAND(F.lit(bits)) - 1).bitwiseAND(F.lit(bits))
    return moved.bitwiseOR(block.bitwiseAND(F.lit(rest)))


def outside(block: Column, axis: int, sign: int, levels: int) -> Column:
    """The cells of a block whose neighbour in the direction is out of the grid."""
    return F.when(at_edge(block, axis, sign, levels), F.lit(layer(axis, 3 if sign > 0 else 0))).otherwise(F.lit(0)).cast("long")


def coordinate_sum(block: Column, word: Column, axis: int, levels: int) -> Column:
    """The sum of the axis's coordinates of a word's voxels."""
    low = F.bit_count(_masked(word, axis, 1, 3)) + 2 * F.bit_count(_masked(word, axis, 2, 3))
    place = sum(((F.shiftright(block, 3 * b + axis).bitwiseAND(F.lit(1))) * (4 << b) for b in range(levels - 2)), F.lit(0))
    return (low + place * F.bit_count(word)).cast("long")


def cells(word: str) -> Column:
    """The numbers of the bits that are set in the long column of this name."""
    return F.expr(f"filter(sequence(0, 63), b -> (shiftright({word}, b) & 1L) = 1L)")
