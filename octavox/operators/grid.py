"""Morphology and set operations on words (shape_id, block, bits): 64 voxels at a time, without voxel rows or neighbour joins.

A step sends each word's six moved copies to its own and the next blocks and merges them there. All of a shape's words
lie in one partition, so that STAGE_STEPS steps need one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octavox.functions import morton
from octavox.functions import words as w
from octavox.functions.ordered import checkpointed

#: Steps that share a stage; each holds an aggregate's memory until the stage ends.
STAGE_STEPS = 3



def _zero() -> Column:
    return F.lit(0).cast("long")


def together(words: DataFrame) -> DataFrame:
    """The words, those of a shape in one partition."""
    return words.repartition("shape_id")


def _moved(words: DataFrame, levels: int, directions, column: str, *keep: str) -> DataFrame:
    """shape_id, block, `keep`, and n0, n1, ...: for each direction the cells whose neighbour there is set in `column`."""
    names = [f"n{k}" for k in range(len(directions))]
    word, block = F.col(column), F.col("block")
    # The neighbour in a direction is set where the word, moved the other way, is set.
    own = F.struct(block.alias("block"), *[F.col(c).alias(c) for c in keep], *[w.inner(word, a, -s).alias(n) for n, (a, s) in zip(names, directions, strict=True)])
    sent = [own]
    for n, (a, s) in zip(names, directions, strict=True):
        carry = w.carried(word, a, -s)
        there = F.struct(w.next_block(block, a, -s, levels).cast("int").alias("block"), *[_zero().alias(c) for c in keep], *[(carry if m == n else _zero()).alias(m) for m in names])
        sent.append(F.when((carry != 0) & ~w.at_edge(block, a, -s, levels), there))
    rows = words.select("shape_id", F.explode(F.array(*sent)).alias("m")).where("m is not null").select("shape_id", "m.*")
    return rows.groupBy("shape_id", "block").agg(*[F.bit_or(c).alias(c) for c in (*keep, *names)])


def neighbours(words: DataFrame, levels: int) -> DataFrame:
    """shape_id, block, bits, n0 .. n5 (cells whose neighbour in direction k of `SIX` is set; out of the grid none is)."""
    return _moved(words, levels, w.SIX, "bits", "bits")


def _or(columns) -> Column:
    columns = list(columns)
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out


def _kept(words: DataFrame, levels: int, directions=w.SIX) -> Column:
    """Cells whose neighbours in all directions are set or out of the grid."""
    out = F.col("bits")
    for k, (a, s) in enumerate(directions):
        out = out.bitwiseAND(F.col(f"n{k}").bitwiseOR(w.outside(F.col("block"), a, s, levels)))
    return out


def _result(frame: DataFrame, bits: Column) -> DataFrame:
    return frame.select("shape_id", "block", bits.alias("bits")).where("bits <> 0")


def steps(amount: float, resolution: float) -> int:
    """Cells that an amount takes: every begun one counts."""
    return max(0, math.ceil(round(abs(amount) / resolution, 9)))


def _stepped(words: DataFrame, n: int, step) -> DataFrame:
    for k in range(n):
        if k % STAGE_STEPS == 0:
            words = together(checkpointed(words) if k else words)
        words = step(words)
    return words


def shrink(words: DataFrame, levels: int, n: int = 1) -> DataFrame:
    """n steps of erosion: cells whose six neighbours are all set; those out of the grid count as set."""
    def step(words: DataFrame) -> DataFrame:
        near = neighbours(words, levels)
        return _result(near, _kept(near, levels))

    return _stepped(words, n, step)


def grow(words: DataFrame, levels: int, n: int = 1) -> DataFrame:
    """n steps of dilation by the six neighbours, within the grid."""
    return _stepped(words, n, lambda words: _result(neighbours(words, levels), _or(F.col(c) for c in ("bits", *(f"n{k}" for k in range(6))))))


def exposed(words: DataFrame, levels: int) -> DataFrame:
    """Cells with a neighbour in the grid that is not set."""
    near = neighbours(together(words), levels)
    return _result(near, F.col("bits").bitwiseAND(F.bitwise_not(_kept(near, levels))))


def interior(words: DataFrame, levels: int) -> DataFrame:
    """Cells of whose 26 neighbours all are set or out of the grid: an erosion along each axis."""
    words = together(words)
    for axis in range(3):
        pair = [(axis, 1), (axis, -1)]
        near = _moved(words, levels, pair, "bits", "bits")
        words = _result(near, _kept(near, levels, pair))
    return words


def solitary(words: DataFrame, levels: int) -> DataFrame:
    """Cells none of whose 26 neighbours is set. `wide` grows axis by axis; what a step adds to a cell are its neighbours."""
    words = together(words).withColumn("wide", F.col("bits")).withColumn("near", _zero())
    for axis in range(3):
        moved = _moved(words, levels, [(axis, 1), (axis, -1)], "wide", "bits", "wide", "near")
        added = _or([F.col("n0"), F.col("n1")])
        words = moved.select("shape_id", "block", "bits", F.col("wide").bitwiseOR(added).alias("wide"), F.col("near").bitwiseOR(added).alias("near"))
    return _result(words, F.col("bits").bitwiseAND(F.bitwise_not("near")))


def face_counts(words: DataFrame, levels: int) -> DataFrame:
    """shape_id, faces: unit faces between a set cell and one that isn't set or is out of the grid."""
    near = neighbours(together(words), levels)
    each = sum((F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(f"n{k}"))) for k in range(6)), F.lit(0))
    return near.groupBy("shape_id").agg(F.sum(each).cast("long").alias("faces")).where("faces > 0")


def faces(words: DataFrame, levels: int) -> DataFrame:
    """The surface as a mesh: a row (shape_id, block, cell, axis, sign) for each exposed side of a cell; `square` has its corners."""
    near = neighbours(together(words), levels)
    side = [F.struct(F.lit(a).alias("axis"), F.lit(s).alias("sign"), F.col("bits").bitwiseAND(F.bitwise_not(f"n{k}")).alias("bits")) for k, (a, s) in enumerate(w.SIX)]
    each = near.select("shape_id", "block", F.explode(F.array(*side)).alias("s")).select("shape_id", "block", "s.*").where("bits <> 0")
    return each.select("shape_id", "block", F.explode(w.cells("bits")).alias("cell"), "axis", "sign")


def square(x: Column, y: Column, z: Column, axis: Column, sign: Column) -> Column:
    """The four corners (x, y, z) of a cell's side, in turn; corners 0 1 2 and 0 2 3 are its two triangles."""
    p = [x, y, z]

    def corner(u: int, v: int) -> Column:
        out = F.struct(*[F.lit(None).cast("int").alias(c) for c in "xyz"])
        for a in range(3):
            b, c = (a + 1) % 3, (a + 2) % 3
            at = {a: p[a] + F.when(sign > 0, 1).otherwise(0), b: p[b] + u, c: p[c] + v}
            out = F.when(axis == a, F.struct(*[at[k].cast("int").alias(n) for k, n in enumerate("xyz")])).otherwise(out)
        return out

    return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))


def envelopes(words: DataFrame, group: str) -> DataFrame:
    """group, block, miv, msv, n: intersection and union of the members' words; a member without a block empties its miv."""
    members = words.groupBy(group).agg(F.countDistinct("shape_id").alias("n"))
    blocks = words.groupBy(group, "block").agg(F.bit_and("bits").alias("all"), F.bit_or("bits").alias("msv"), F.count("*").alias("m"))
    return blocks.join(members, group).select(group, "block", F.when(F.col("m") == F.col("n"), F.col("all")).otherwise(F.lit(0).cast("long")).alias("miv"), "msv", "n")


def invert(words: DataFrame, levels: int) -> DataFrame:
    """Complement of each shape over all blocks of the cube, those that it lacks included."""
    spine = words.select("shape_id").distinct().select("shape_id", F.explode(F.sequence(F.lit(0), F.lit((1 << 3 * (levels - 2)) - 1))).alias("block"), F.lit(0).cast("long").alias("bits"))
    return together(words.select("shape_id", "block", "bits").union(spine)).groupBy("shape_id", "block").agg(F.bit_or("bits").alias("b")).select("shape_id", "block", F.bitwise_not("b").alias("bits")).where("bits <> 0")


def combine(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Shapes of the same id put together: `and`, `or` or `minus` (the left's cells that the right lacks)."""
    both = left.select("shape_id", "block", F.col("bits").alias("a"), F.lit(0).cast("long").alias("b")).union(right.select("shape_id", "block", F.lit(0).cast("long"), "bits"))
    one = both.groupBy("shape_id", "block").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    return _result(one, {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "minus": a.bitwiseAND(F.bitwise_not(b))}[how])


def shaped(words: DataFrame, levels: int, resolution: float, amount: float = 0.0, inverted: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """A query's shape: shrunk by an amount (grown by a negative one), inverted, and cut to a mask of the same ids, in this order."""
    n = steps(amount, resolution)
    if n:
        words = shrink(words, levels, n) if amount > 0 else grow(words, levels, n)
    if inverted:
        words = invert(words, levels)
    return combine(words, mask, "and") if mask is not None else words


def coarser(words: DataFrame, up: int, fill: bool) -> DataFrame:
    """shape_id, octant: cells of 2 ** up voxels a side that hold a voxel (`fill`), or that are full."""
    byte = lambda k: F.shiftrightunsigned("bits", 8 * k).bitwiseAND(F.lit(255))
    ok = lambda c, full: (c != 0) if fill else (c == full)
    if up == 0:
        return words.select("shape_id", F.col("block").cast("long").alias("b"), F.explode(w.cells("bits")).alias("c")).select("shape_id", (F.col("b") * 64 + F.col("c")).alias("octant"))
    if up == 1:
        each = F.filter(F.array(*[F.when(ok(byte(k), 255), F.lit(k)) for k in range(8)]), lambda k: k.isNotNull())
        return words.select("shape_id", F.col("block").cast("long").alias("b"), F.explode(each).alias("c")).select("shape_id", (F.col("b") * 8 + F.col("c")).alias("octant"))
    rest = 3 * (up - 2)
    kept = words.where(ok(F.col("bits"), -1)).groupBy("shape_id", F.shiftright(F.col("block").cast("long"), rest).alias("octant")).agg(F.count("*").alias("m"))
    return kept.where(F.lit(True) if fill else F.col("m") == 1 << rest).select("shape_id", "octant")


def occupied_by_depth(words: DataFrame, levels: int) -> DataFrame:
    """shape_id, depth, n: octants with a set voxel at every depth (0: the cube), counted in the words."""
    byte = lambda k: F.shiftrightunsigned("bits", 8 * k).bitwiseAND(F.lit(255))
    octants = sum(((byte(k) != 0).cast("int") for k in range(8)), F.lit(0))
    fine = words.groupBy("shape_id").agg(F.sum(F.bit_count("bits")).cast("long").alias("v"), F.sum(octants).cast("long").alias("o"), F.count("*").alias("b"), *[F.count_distinct(F.shiftright("block", 3 * (levels - 2 - d))).alias(f"d{d}") for d in range(levels - 2)])
    depths = [*[(d, F.col(f"d{d}")) for d in range(levels - 2)], (levels - 2, F.col("b")), (levels - 1, F.col("o")), (levels, F.col("v"))]
    return fine.select("shape_id", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), n.cast("long").alias("n")) for d, n in depths])).alias("e")).select("shape_id", "e.*")


def truncated(words: DataFrame, levels: int, cut: int, fill: bool) -> DataFrame:
    """shape_id, block, bits after the octree is cut at cubes of `cut` (a power of two) cells a side.

    The octree ends where the eighths of a cube are all full or empty. A cube of that side that the octree divides
    further, or that ends with a cube of just that side, becomes full if it holds a voxel (`fill`) or else empty, even if it
    is full; so without `fill` a full cube stays only where all eighths of the cube above are full or empty. The whole
    grid is such a cube itself. Cubes of up to one word are cut in their row; larger ones are counted up from words.
    """
    step = cut.bit_length() - 1
    if step == 0:
        return words.select("shape_id", "block", "bits")
    if step == 1:
        octants = [F.shiftrightunsigned("bits", 8 * o).bitwiseAND(F.lit(255)) for o in range(8)]
        whole = F.forall(F.array(*octants), lambda o: o.isin(0, 255))
        filled = F.aggregate(F.array(*[F.when(o != 0, F.lit((255 << (8 * k)) - ((1 << 64) if k == 7 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for k, o in enumerate(octants)]), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
        kept = filled if fill else F.when(whole & (levels > 1), F.col("bits")).otherwise(F.lit(0).cast("long"))
        return words.select("shape_id", "block", kept.alias("bits")).where("bits <> 0")
    inner = 3 * (step - 2)
    cube = F.shiftright("block", inner)
    cubes = words.where("bits <> 0").groupBy("shape_id", cube.alias("cube")).agg(F.count_if(F.col("bits") == -1).alias("full"))
    blocks = lambda c: F.explode(F.sequence(F.shiftleft(c, inner), F.shiftleft(c, inner) + F.lit((1 << inner) - 1)))
    if fill:
        out = cubes.select("shape_id", blocks(F.col("cube").cast("long")).alias("block"))
    elif step >= levels:
        return words.select("shape_id", "block", "bits").where(F.lit(False))
    else:
        above = cubes.groupBy("shape_id", F.shiftright("cube", 3).alias("above")).agg(F.collect_list("cube").alias("cubes"), F.min("full").alias("least"))
        out = above.where(F.col("least") == 1 << inner).select("shape_id", F.explode("cubes").alias("cube")).select("shape_id", blocks(F.col("cube").cast("long")).alias("block"))
    return out.select("shape_id", "block", F.lit(-1).cast("long").alias("bits"))


def ball_chords(radius: float) -> list[tuple[int, int, int, int]]:
    """x, y, lowest and highest z, from a cell's own, of the cells of a ball (radius in cells) around a cell's centre, chord by chord."""
    out = []
    for i in range(-math.floor(radius), math.floor(radius) + 1):
        across = math.sqrt(max(0.0, radius * radius - i * i))
        for j in range(-math.floor(across), math.floor(across) + 1):
            half = math.sqrt(max(0.0, across * across - j * j))
            out.append((i, j, math.floor(0.5 - half), math.floor(0.5 + half)))
    return out


def dilated(words: DataFrame, levels: int, radius: float) -> DataFrame:
    """Cells within a ball (radius in cells) around any cell, drawn chord by chord; a chord that leaves the grid is left out.

    Cells of one shape that many balls reach are joined into words before they are shuffled.
    """
    side = 1 << levels
    cells = words.select("shape_id", F.col("block").cast("long").alias("block"), F.explode(w.cells("bits")).alias("c"))
    x, y, z = morton.decode(F.col("block") * 64 + F.col("c"), levels)
    chords = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("i", "j", "a", "b"), c, strict=True)]) for c in ball_chords(radius)])
    drawn = cells.select("shape_id", x.alias("x"), y.alias("y"), z.alias("z"), F.explode(chords).alias("o"))
    drawn = drawn.select("shape_id", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), (F.col("z") + F.col("o.a")).alias("low"), (F.col("z") + F.col("o.b")).alias("high"))
    drawn = drawn.where(f"x between 0 and {side - 1} and y between 0 and {side - 1} and low >= 0 and high < {side}")
    coded = drawn.select("shape_id", "x", "y", F.explode(F.sequence("low", "high")).alias("z")).select("shape_id", morton.encode(F.col("x"), F.col("y"), F.col("z"), levels).alias("code"))
    return coded.groupBy("shape_id", F.shiftright("code", 6).alias("block")).agg(F.expr("bit_or(shiftleft(1L, code & 63))").alias("bits"))


def surface(words: DataFrame, levels: int, probe: float) -> DataFrame:
    """The solvent-excluded shape from the solvent-accessible one: what no probe (radius in cells) around the rim's cells reaches.

    The rim is what a step of shrinking takes off, without cells whose neighbours all are set.
    """
    rim = combine(combine(words, shrink(words, levels), "minus"), interior(words, levels), "minus")
    return combine(words, dilated(rim, levels, probe), "minus")
