"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; the rows here hold a few numbers each.
BROADCAST_ROWS = 200_000
#: Rows of ids that one partition of a counted frame holds.
LINKS_A_PARTITION = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(id_column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(modulus))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; in local mode (tests) set one of our own where none is set, else fail."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions for work whose cost a partition's bytes do not show, so that they are not merged."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def materialise(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def counted(frame: DataFrame) -> tuple[DataFrame, int]:
    """The materialised frame, read in partitions that suit its rows, and their number.

    Tables of links and components have a few longs a row. In as many partitions as the joins that made them, and
    their unions, most files of the shuffles that follow would be nearly empty. Rows are counted while they are written.
    """
    seen = Observation()
    kept = materialise(frame.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return kept.coalesce(max(2 * frame.sparkSession.sparkContext.defaultParallelism, -(-n // LINKS_A_PARTITION))), n


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files, broadcasts and checkpoints of frames that nothing refers to any more.

    Spark drops them when the driver's JVM finds those frames unreachable. With tables of millions of rows its heap
    grows to its limit before it looks; operators of many steps call this between them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_order(frame: DataFrame, *order, **sums) -> DataFrame:
    """The frame with, for each name in `sums`, the sum of its expression over all earlier rows of the order.

    Two passes instead of one window over all rows: the rows are dealt out by ranges of the order, each range is
    summed, and a window within a range starts from the sum of the ranges before it. One row a range is windowed whole.
    """
    n = frame.sparkSession.sparkContext.defaultParallelism * 2
    dealt = materialise(frame.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(*[F.sum(e).alias(f"_{c}") for c, e in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(ranges), "_range").select(*frame.columns, *[(F.col(f"_{c}") + F.coalesce(F.sum(e).over(own), F.lit(0))).alias(c) for c, e in sums.items()])


def small(frame: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the counted rows are within the bound; otherwise the join shuffles."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def labelled_sample(rows: DataFrame, label: str, key: str, per_class: int, max_classes: int = 256) -> DataFrame:
    """About `per_class` rows of every label value, picked by a hash of `key`, so that reruns agree.

    The result is bounded by 2 * per_class * max_classes rows whatever the input's size.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label)
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_classes).collect()
    if not counts:
        return rows.limit(0)
    rate = F.coalesce(*[F.when(F.col(label) == r[label], F.lit(min(1.0, per_class / r["count"]))) for r in counts], F.lit(0.0))
    order = F.xxhash64(F.col(key), F.lit(17))
    share = F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(share < rate).orderBy(order, key, label).limit(2 * per_class * len(counts))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, without a copy of each value; null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the segments [start, start + length), one segment after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def rested(batches):
    """The function on an iterator of batches, with freed memory given back at its end: a worker that waits for its next task holds little."""

    def run(it):
        yield from batches(it)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of an edge reaches, by neighbours' minima and pointer jumps.

    `edges` has longs src and dst. Work is a join and a pre-aggregated minimum a round; a node with very many
    edges is the skewed side of a join whose other side has one row a key, which adaptive execution splits.
    """
    both, _ = counted(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels, _ = counted(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("low"))
        lower = labels.join(near.withColumnRenamed("src", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        lower, _ = counted(lower)
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels, _ = counted(lower.join(jump, "component").select("node", "was", F.col("root").alias("component")))
        if labels.where("component < was").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
