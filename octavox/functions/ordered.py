"""Running sums and maxima over a whole table, in two passes instead of one window in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, its lineage cut in the shared folder of spark.checkpoint.dir; local mode (tests) may do without that setting."""
    session: SparkSession = frame.sparkSession
    context = session.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return frame.checkpoint(eager=True)


def ranged(frame: DataFrame, *order) -> DataFrame:
    """The frame dealt out by ranges of the order, with the range's number in `_range`."""
    return checkpointed(frame.repartitionByRange(2 * frame.sparkSession.sparkContext.defaultParallelism, *order).withColumn("_range", F.spark_partition_id()))


def before(frame: DataFrame, order: list, sums: dict | None = None, tops: dict | None = None) -> DataFrame:
    """The frame with, for each name, the sum (0 at first) or maximum (null at first) of a column over all earlier rows.

    Ranges of the order are summed up; a window within a range starts from what the ranges before it came to. One row
    a range is windowed whole. The order must not tie.
    """
    sums, tops = sums or {}, tops or {}
    dealt = ranged(frame, *order)
    whole = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_{n}") for n, c in tops.items()])
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_range", *[F.coalesce(F.sum(f"_{n}").over(lower), F.lit(0)).alias(f"_{n}") for n in sums], *[F.max(f"_{n}").over(lower).alias(f"_{n}") for n in tops])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = [(F.col(f"_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(n) for n, c in sums.items()]
    return dealt.join(F.broadcast(whole), "_range").select(*frame.columns, *added, *[F.greatest(f"_{n}", F.max(c).over(own)).alias(n) for n, c in tops.items()])
