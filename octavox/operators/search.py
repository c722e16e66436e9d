"""Searches: overlaps of query shapes with all shapes, metrics as column expressions, top-k, containment, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def packed(words: DataFrame, key: str = "shape_id") -> DataFrame:
    """One row a shape: key, words (map of block to bits), volume."""
    return words.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("volume"))


def common(a: str, b: str) -> Column:
    """Voxels that two packed shapes share; blocks that one lacks are empty."""
    return F.expr(f"aggregate(map_entries({a}), 0L, (t, e) -> t + bit_count(e.value & coalesce({b}[e.key], 0L)))")


def shared(frame: DataFrame, a: str, b: str) -> Column:
    """`common` of two columns of a frame. Shapes of one block may have its bits, a long, in place of the map: plain arithmetic."""
    if frame.schema[a].dataType == LongType():
        return F.bit_count(F.col(a).bitwiseAND(F.col(b))).cast("long")
    return common(a, b)


def against(queries: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every query of a stated set beside every shape, so that pairs without a common voxel are not lost.

    Without a hint: Spark broadcasts a side whose bytes are under its threshold, else it meets the two in blocks of
    partitions. Conditions on the pair that follow become part of the join.
    """
    return shapes.join(queries, F.lit(True), "cross")


def tanimoto(i: Column, a: Column, b: Column) -> Column:
    """Relative volume distance 1 - shared / joint; 0 of two empty shapes."""
    joint = a + b - i
    return F.when(joint == 0, F.lit(0.0)).otherwise(1.0 - i / joint)


def left_out(i: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(1.0 - i / n)


#: Metrics of a shape against (small, big), by name, over volumes n, ns, nb and overlaps xs, xb. The triples take the
#: shape itself as both of its envelopes.
METRICS = {
    "rel_volume": lambda n, ns, nb, xs, xb: tanimoto(xs, n, ns) + tanimoto(xb, n, nb),
    "abs_volume": lambda n, ns, nb, xs, xb: ((n + ns - 2 * xs) + (n + nb - 2 * xb)).cast("double"),
    "rel_triple": lambda n, ns, nb, xs, xb: tanimoto(xs, n, ns) + tanimoto(xb, n, nb) + left_out(xs, n + nb - xb),
    "abs_triple": lambda n, ns, nb, xs, xb: ((n + ns - 2 * xs) + (n + nb - 2 * xb) + (n + nb - xb - xs)) / 3.0,
    "include_exclude": lambda n, ns, nb, xs, xb: left_out(xs, ns) + left_out(xb, n),
    "relvol_exclude": lambda n, ns, nb, xs, xb: tanimoto(xs, n, ns) + left_out(xb, n),
}


def scored(queries: DataFrame, shapes: DataFrame, of_query: tuple[str, ...] = (), of_shape: tuple[str, ...] = ()) -> DataFrame:
    """query_id, object_id, overlap, joint, dist over all pairs; `queries` and `shapes` are packed.

    Columns named in `of_query` and `of_shape` go along, so that pairs needn't be joined with their ends again.
    """
    q = queries.select(F.col("shape_id").alias("query_id"), F.col("words").alias("qw"), F.col("volume").alias("qn"), *of_query)
    p = against(q, shapes)
    p = p.withColumn("overlap", shared(p, "qw", "words"))
    return p.select("query_id", F.col("shape_id").alias("object_id"), "overlap", (F.col("qn") + F.col("volume") - F.col("overlap")).alias("joint"), tanimoto(F.col("overlap"), F.col("qn"), F.col("volume")).alias("dist"), *of_query, *of_shape)


def top_k(pairs: DataFrame, k: int, score: str = "dist") -> DataFrame:
    """The k nearest of each query, ties to smaller ids; k = 0 means all."""
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score, "object_id")))
    return ranked.where(F.col("rank") <= k) if k else ranked


def with_bounds(constraints: DataFrame, shapes: DataFrame) -> DataFrame:
    """All pairs of constraints (query_id, small, big: packed words, like the shapes'; ns, nb: volumes) and shapes, with their overlaps."""
    p = against(constraints, shapes)
    return p.select("query_id", F.col("shape_id").alias("object_id"), F.col("volume").alias("n"), "ns", "nb", shared(p, "small", "words").alias("xs"), shared(p, "words", "big").alias("xb"))


def metric(pairs: DataFrame, name: str) -> DataFrame:
    columns = [F.col(c) for c in ("n", "ns", "nb", "xs", "xb")]
    return pairs.withColumn("score", METRICS[name](*columns))


def between(pairs: DataFrame) -> DataFrame:
    """Shapes that hold all of small and lie within big."""
    return pairs.where("xs = ns and xb = n")


def bounds(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node_id, lo, hi: least and greatest distance of a query to any member of a node (packed miv and msv)."""
    q = queries.select(F.col("shape_id").alias("query_id"), F.col("words").alias("qw"), F.col("volume").alias("qn"))
    p = against(q, nodes).select("query_id", "node_id", "n", "qn", "vmiv", "vmsv", common("qw", "miv").alias("imiv"), common("qw", "msv").alias("imsv"))
    lo_joint, hi_joint = F.col("qn") + F.col("vmiv") - F.col("imiv"), F.col("qn") + F.col("vmsv") - F.col("imsv")
    lo = F.when(lo_joint == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("imsv") / lo_joint))
    hi = F.when(hi_joint == 0, 0.0).otherwise(1.0 - F.col("imiv") / hi_joint)
    return p.select("query_id", "node_id", "n", lo.alias("lo"), hi.alias("hi"))


def pruned_top_k(queries: DataFrame, shapes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """`top_k` by envelopes: nodes whose least distance exceeds the k-th guaranteed one are left out before members are read.

    Nodes in the order of their greatest distance hold k members within some tau; any member of a node with lo > tau
    is farther. `shapes` has node_id.
    """
    b = bounds(queries, nodes)
    order = Window.partitionBy("query_id").orderBy("hi", "node_id").rowsBetween(Window.unboundedPreceding, 0)
    tau = b.withColumn("held", F.sum("n").over(order)).where(F.col("held") >= k).groupBy("query_id").agg(F.min("hi").alias("tau"))
    live = b.join(tau, "query_id", "left").where(F.col("tau").isNull() | (F.col("lo") <= F.col("tau"))).select("query_id", "node_id")
    q = queries.select(F.col("shape_id").alias("query_id"), F.col("words").alias("qw"), F.col("volume").alias("qn"))
    p = live.join(q, "query_id").join(shapes, "node_id").withColumn("overlap", common("qw", "words"))
    p = p.select("query_id", F.col("shape_id").alias("object_id"), tanimoto(F.col("overlap"), F.col("qn"), F.col("volume")).alias("dist"))
    return top_k(p, k)
