"""Shapes from tables: signs of vectors, and molecules of spheres, as words (shape_id, block, bits) or voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octavox.functions import morton

SIDE, LEVELS = 16, 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sign_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 4 x 4 x 4 shape a vector: voxel v is set where component v is positive. Made in the scan, without a shuffle."""
    bits = F.expr("aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("shape_id"), "label", F.lit(0).alias("block"), bits.alias("bits"))


def order_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sphere a line of an order, on the 16 x 16 x 16 grid of its molecule."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("shape_id"),
        F.col("l_linenumber").alias("atom"),
        (F.col("l_quantity").cast("int") % SIDE).alias("gx"),
        F.round(F.col("l_discount") * 100).cast("int").alias("gy"),
        F.round(F.col("l_tax") * 100).cast("int").alias("gz"),
        (1 + F.col("l_linenumber") % 2).alias("r"),
    )


def order_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the order molecules: voxels of a block are or-ed before the shuffle."""
    atoms = order_atoms(spark, sf_dir)
    return to_words(sphere_voxels(atoms))


def sphere_voxels(atoms: DataFrame, side: int = SIDE) -> DataFrame:
    """Voxels (shape_id, x, y, z) within spheres of whole centres and any radius r (0: the centre alone), cut to the grid.

    Lines along x are counted out of each sphere; cells are repeated where spheres overlap, as words don't need them
    distinct. A null or negative radius gives none.
    """
    atoms = atoms.where("r >= 0").withColumn("r", F.col("r").cast("double"))
    span = lambda c, far: F.sequence(F.greatest(-F.floor(far), -F.col(c)).cast("int"), F.least(F.floor(far), F.lit(side - 1) - F.col(c)).cast("int"))
    ok = lambda c, far: (F.col(c) + F.floor(far) >= 0) & (F.col(c) - F.floor(far) <= side - 1)
    left = lambda *gone: F.sqrt(F.greatest(F.lit(0.0), F.col("r") * F.col("r") - sum((F.col(g) * F.col(g) for g in gone), F.lit(0))))
    out = atoms.select("shape_id", "gx", "gy", "gz", "r")
    for axis, gone in (("z", ()), ("y", ("dz",)), ("x", ("dz", "dy"))):
        far = left(*gone)
        out = out.where(ok(f"g{axis}", far)).select("*", F.explode(span(f"g{axis}", far)).alias(f"d{axis}"))
    return out.select("shape_id", *[(F.col(f"g{c}") + F.col(f"d{c}")).cast("int").alias(c) for c in "xyz"])


def to_words(voxels: DataFrame, levels: int = LEVELS) -> DataFrame:
    coded = voxels.withColumn("code", morton.encode(F.col("x"), F.col("y"), F.col("z"), levels))
    return coded.groupBy("shape_id", F.shiftright("code", 6).alias("block")).agg(F.expr("bit_or(shiftleft(1L, code & 63))").alias("bits"))


def to_voxels(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Voxels (shape_id, x, y, z) of words."""
    bits = F.expr("filter(sequence(0, 63), b -> (shiftright(bits, b) & 1L) = 1L)")
    coded = words.select("shape_id", "block", F.explode(bits).alias("b")).select("shape_id", (F.col("block") * 64 + F.col("b")).alias("code"))
    x, y, z = morton.decode(F.col("code"), levels)
    return coded.select("shape_id", x.alias("x"), y.alias("y"), z.alias("z"))
