"""An index of packed shapes: nearest centres, leaves of near shapes, and envelopes of every level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octavox.functions.ordered import before, checkpointed
from octavox.operators import search

#: Shapes of a leaf, and ties (shapes of one centre and distance) that one sort may number; more are numbered by ranges of ids.
LEAF, SORTED = 16, 32_768


def nearest_centre(centres: DataFrame, shapes: DataFrame) -> DataFrame:
    """shape_id, centre, dist: each shape's nearest centre (both packed), ties to the smaller id."""
    near = search.scored(centres, shapes).groupBy("object_id").agg(F.min(F.struct("dist", "query_id")).alias("m"))
    return near.select(F.col("object_id").alias("shape_id"), F.col("m.query_id").alias("centre"), F.col("m.dist").alias("dist"))


def _numbered(near: DataFrame) -> DataFrame:
    """Adds `at`, from 0: the place of each shape in the order (dist, shape_id) of its centre.

    Distances of a centre are counted and summed up. The ties of one distance are few, or are cut into equal ranges
    of ids, which are counted and summed up too; a window holds a range of ties only.
    """
    tie = ["centre", "dist"]
    lower = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ties = near.groupBy(*tie).agg(F.count("*").alias("ties"), F.min("shape_id").alias("low"), F.max("shape_id").alias("high"))
    ties = ties.withColumn("first", F.coalesce(F.sum("ties").over(lower("centre").orderBy("dist")), F.lit(0)))
    step = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("ties") / SORTED)))
    cut = near.join(ties.select(*tie, "low", "first", step.alias("step")), tie).withColumn("range", F.expr("(shape_id - low) div step"))
    sizes = cut.groupBy(*tie, "range").agg(F.count("*").alias("n"))
    sizes = sizes.select(*tie, "range", F.coalesce(F.sum("n").over(lower(*tie).orderBy("range")), F.lit(0)).alias("skipped"))
    own = Window.partitionBy(*tie, "range").orderBy("shape_id")
    return cut.join(sizes, [*tie, "range"]).select("shape_id", "centre", (F.col("first") + F.col("skipped") + F.row_number().over(own) - 1).alias("at"))


def pack(centres: DataFrame, shapes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """shape_id, centre, leaf: leaves of `leaf` shapes in the order of their distance from their centre."""
    return _numbered(nearest_centre(centres, shapes)).select("shape_id", "centre", F.floor(F.col("at") / leaf).cast("int").alias("leaf"))


def levels(packed: DataFrame, words: DataFrame) -> DataFrame:
    """level (0: leaf, 1: centre, 2: root), centre, leaf, block, miv, msv, n: envelopes, each level from the one below."""
    n = packed.groupBy("centre", "leaf").agg(F.count("*").alias("n"))
    meet = lambda own, size: F.when(F.col(own) == F.col(size), F.col("miv")).otherwise(F.lit(0).cast("long"))
    key = ["centre", "leaf"]
    low = words.join(packed, "shape_id").groupBy(*key, "block").agg(F.bit_and("bits").alias("miv"), F.bit_or("bits").alias("msv"), F.count("*").alias("m")).join(n, key)
    low = low.select(F.lit(0).alias("level"), *key, "block", meet("m", "n").alias("miv"), "msv", "n")
    sizes = n.groupBy("centre").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    mid = low.groupBy("centre", "block").agg(F.bit_and("miv").alias("miv"), F.bit_or("msv").alias("msv"), F.count("*").alias("m")).join(sizes, "centre")
    none = F.lit(None).cast("int").alias("leaf")
    mid = mid.select(F.lit(1).alias("level"), "centre", none, "block", meet("m", "c").alias("miv"), "msv", F.col("t").alias("n"))
    all_ = sizes.agg(F.count("*").alias("c"), F.sum("t").alias("t"))
    top = mid.groupBy("block").agg(F.bit_and("miv").alias("miv"), F.bit_or("msv").alias("msv"), F.count("*").alias("m")).join(F.broadcast(all_), F.lit(True))
    top = top.select(F.lit(2).alias("level"), F.lit(None).cast("long").alias("centre"), none, "block", meet("m", "c").alias("miv"), "msv", F.col("t").alias("n"))
    return low.unionByName(mid).unionByName(top)


def packed_nodes(envelopes: DataFrame) -> DataFrame:
    """Envelopes (node_id, block, miv, msv, n) as `search.bounds` takes them."""
    return envelopes.groupBy("node_id", "n").agg(
        F.map_from_entries(F.collect_list(F.struct("block", "miv"))).alias("miv"),
        F.map_from_entries(F.collect_list(F.struct("block", "msv"))).alias("msv"),
        F.sum(F.bit_count("miv")).cast("long").alias("vmiv"),
        F.sum(F.bit_count("msv")).cast("long").alias("vmsv"),
    )


def packed_leaves(envelopes: DataFrame) -> DataFrame:
    """Leaves of `levels` as `search.bounds` takes them, named by node_id."""
    return packed_nodes(envelopes.where("level = 0").withColumn("node_id", F.struct("centre", "leaf")))


def envelopes_of(members: DataFrame, words: DataFrame) -> DataFrame:
    """node_id, block, miv, msv, n of nodes given by their members (shape_id, node_id); a block that a member lacks has no miv."""
    n = members.groupBy("node_id").agg(F.count("*").alias("n"))
    low = words.join(members, "shape_id").groupBy("node_id", "block").agg(F.bit_and("bits").alias("a"), F.bit_or("bits").alias("msv"), F.count("*").alias("m")).join(n, "node_id")
    return low.select("node_id", "block", F.when(F.col("m") == F.col("n"), F.col("a")).otherwise(F.lit(0).cast("long")).alias("miv"), "msv", "n")


def tree(packed: DataFrame, words: DataFrame, key: list[str], fan: int = LEAF, drop_top: int = 0) -> DataFrame:
    """level (0: leaves), node, block, miv, msv, n, first_leaf, last_leaf, of all levels up to one root.

    Leaves (`packed` has shape_id and the columns of `key`) are numbered in the order of their keys, so that `fan`
    neighbours of a level make a node of the next and a node's leaves are a range. Each level comes from the one below,
    whose nodes are fewer by `fan`. `drop_top` levels at the top are left out: then several roots remain.
    """
    leaves = before(packed.groupBy(*key).agg(F.count("*").alias("n")), [F.col(c) for c in key], {"node": F.lit(1)})
    members = packed.join(leaves.select(*key, "node"), key).select("shape_id", F.col("node").alias("node_id"))
    level = checkpointed(envelopes_of(members, words).withColumnRenamed("node_id", "node").withColumns({"first_leaf": F.col("node"), "last_leaf": F.col("node")}))
    out, depth = [level.withColumn("level", F.lit(0))], 0
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        depth += 1
        up = F.expr(f"node div {fan}").alias("node")
        one = level.select("node", "n", "first_leaf", "last_leaf").distinct().groupBy(up).agg(F.count("*").alias("kids"), F.sum("n").alias("n"), F.min("first_leaf").alias("first_leaf"), F.max("last_leaf").alias("last_leaf"))
        words_up = level.groupBy(up, "block").agg(F.bit_and("miv").alias("a"), F.bit_or("msv").alias("msv"), F.count("*").alias("m"))
        level = checkpointed(words_up.join(one, "node").select("node", "block", F.when(F.col("m") == F.col("kids"), F.col("a")).otherwise(F.lit(0).cast("long")).alias("miv"), "msv", "n", "first_leaf", "last_leaf"))
        out.append(level.withColumn("level", F.lit(depth)))
    whole = out[0]
    for frame in out[1 : max(1, len(out) - drop_top)]:
        whole = whole.unionByName(frame)
    return whole
