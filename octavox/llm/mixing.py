"""Mixing sources to target weights by entropy balancing, in DataFrame functions.

Of all document rates w with sum(size * w) = target in each source, the ones nearest to 1 in relative entropy are
w = exp(lambda * size). The dual is convex and has one lambda a source; distributed Newton iterations solve it on a
histogram of sizes, which is all that the rates depend on. Rates stop at MOST, and are rounded into copies so that
running sums over documents of like size stay within one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, materialise, small

#: Copies of a document at most; weights of sources in order, repeating.
MOST, WEIGHTS = 3, (1, 2, 3)
#: Newton iterations at most (a bracket that only halves is at the end of double precision long before), and relative
#: error of a source's words at which they end.
ITERATIONS, ENOUGH = 200, 1e-9
#: Documents of a part on average, where those of one source and like size are parted for prefix sums.
PART_ROWS = 250
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def targets(per_source: DataFrame) -> DataFrame:
    """source, source_size, target: all words shared by weight, a source's share ending at MOST times its size.

    Nulls come last in the order of sources. A source is full where the level of the open ones (words left by weight)
    reaches MOST * size / weight; filling sources raises the level, so rounds of one aggregate end when none is added.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (F.pmod(F.col("place"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = materialise(in_order(per_source, F.col("source").asc_nulls_last(), place=F.lit(1)).withColumn("weight", weight))
    full_at = MOST * F.col("source_size") / F.col("weight")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = full_at <= level
        sums = s.agg(F.sum(F.when(full, MOST * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        after = (total - (sums[0] or 0)) / sums[1] if sums[1] else level
        if after <= level:
            break
        level = after
    target = F.when(full_at <= level, (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level)
    return s.select("source", "source_size", target.alias("target"))


def rate(multiplier, x):
    """exp(multiplier * x), at most MOST."""
    return F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * x, F.lit(50.0))))


def solve(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with `multiplier` and `scale`: Newton steps on the dual, halving a bracket where a step leaves it.

    `histogram` has key, size, n. A source whose target is MOST times its size, or that has no words, has rate MOST.
    """
    scale = histogram.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("scale"))
    state = goals.join(scale, "key").withColumn("full", F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12))
    state = state.withColumns({"multiplier": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6), "error": F.lit(1.0)})
    state = materialise(state)
    count = state.count()
    for _ in range(ITERATIONS):
        h = histogram.join(small(state.where(~F.col("full")), count), "key").withColumn("x", F.col("size") / F.col("scale"))
        w = rate(F.col("multiplier"), F.col("x"))
        words = h.groupBy("key").agg(
            F.sum(F.col("n") * F.col("size") * w).alias("g"),
            F.sum(F.when(w < MOST, F.col("n") * F.col("size") * F.col("x") * w).otherwise(0.0)).alias("slope"),
        )
        s = state.join(words, "key", "left")
        off = F.col("g") - F.col("target")
        s = s.withColumn("high", F.when(off > 0, F.col("multiplier")).otherwise(F.col("high"))).withColumn("low", F.when(off < 0, F.col("multiplier")).otherwise(F.col("low")))
        step = F.col("multiplier") - off / F.col("slope")
        # Where the bracket has no own end yet, a step may go three units of the mean size at most.
        step = F.when(F.col("slope") > 0, F.greatest(F.least(step, F.col("multiplier") + 3.0), F.col("multiplier") - 3.0)).otherwise(F.col("multiplier") - F.signum(off) * 3.0)
        inside = (step > F.col("low")) & (step < F.col("high"))
        s = s.withColumn("error", F.coalesce(F.abs(off) / F.greatest("target", F.lit(1.0)), F.lit(0.0)))
        s = s.withColumn("multiplier", F.when(F.col("g").isNull() | (off == 0), F.col("multiplier")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
        state = materialise(s.select(*state.columns))
        # Where a step no longer moves a multiplier, its error is that of double precision.
        if not (state.agg(F.max(F.when(F.col("high") - F.col("low") > 1e-15 * F.abs("multiplier"), F.col("error")).otherwise(0.0))).first()[0] or 0.0) > ENOUGH:
            break
    else:
        raise ArithmeticError(f"the rates of some source did not settle in {ITERATIONS} iterations")
    return state.select("key", "source_size", "target", "full", "scale", "multiplier")


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, part, taken of every row.

    size counts words (a null text has none); null is a source of its own. copies are whole documents; one document
    of a source gives or takes back part of a copy (`part`, in words, may be negative), so that the source's words
    come to its target as near as whole words can; taken = copies * size + part, between 0 and MOST * size. Rows
    that repeat an id are documents of their own. An empty table gives no rows. Rounding depends on values alone,
    so reruns agree.
    """
    key = F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())
    rows = materialise(sizes(documents).withColumn("key", key))
    histogram = materialise(rows.groupBy("key", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    per_source = histogram.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(per_source.select("source", "source_size")).withColumn("key", key)
    solved = materialise(solve(histogram, goals))
    # Mean rates of sizes: running sums of the fractions over a source, by size, then document.
    x = F.col("size") / F.col("scale")
    w = F.when(F.col("full") | (F.col("size") == 0), F.lit(float(MOST))).otherwise(rate(F.col("multiplier"), x))
    band = F.floor(4 * F.log2(F.col("size") + 1.0)).cast("int")
    parts = histogram.groupBy("key", band.alias("band")).agg(F.ceil(F.sum("n") / PART_ROWS).cast("int").alias("parts"))
    parts = materialise(parts)
    part_of = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("parts")).cast("int")
    # Rates as whole numbers of 2^-40 copies: sums are exact, so their order does not matter.
    unit = 1 << 40
    docs = rows.join(small(solved, solved.count()), "key").withColumn("rate", w).withColumn("band", band)
    docs = docs.join(small(parts, parts.count()), ["key", "band"]).withColumn("part_no", part_of).drop("parts")
    docs = docs.withColumn("units", F.round(F.col("rate") * unit).cast("long"))
    docs = docs.withColumn("copies", F.shiftright("units", 40)).withColumn("fraction", F.col("units") - F.shiftleft("copies", 40))
    docs = materialise(docs)
    # What comes before a part: the source's lower bands (few), then the band's lower parts (one row for PART_ROWS documents).
    whole = F.lit(unit).cast("decimal(38,0)")
    cells = docs.groupBy("key", "band", "part_no").agg(F.pmod(F.sum(F.col("fraction").cast("decimal(20,0)")).cast("decimal(38,0)"), whole).cast("long").alias("total"))
    bands = cells.groupBy("key", "band").agg(F.sum("total").alias("total"))
    lower = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("key", "band", F.coalesce(F.sum("total").over(lower("key", "band")), F.lit(0)).alias("base"))
    cells = cells.join(bands, ["key", "band"]).withColumn("own", F.coalesce(F.sum("total").over(lower("key", "band", "part_no")), F.lit(0)))
    cells = materialise(cells.select("key", "band", "part_no", F.pmod(F.col("base") + F.col("own"), F.lit(unit)).alias("before")))
    docs = docs.join(small(cells, cells.count()), ["key", "band", "part_no"])
    running = Window.partitionBy("key", "band", "part_no").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + unit // 2 + F.sum("fraction").over(running)
    docs = docs.withColumn("upto", upto)
    extra = F.shiftright("upto", 40) - F.shiftright(F.col("upto") - F.col("fraction"), 40)
    docs = docs.withColumn("copies", F.least(F.lit(MOST), F.col("copies") + extra).cast("long"))
    docs = docs.select("key", "doc_id", "source", "size", "source_size", "target", "rate", "copies")
    return _settle(docs)


def _settle(docs: DataFrame) -> DataFrame:
    """Give what is left of each target to one document, or take it back from one: the largest that allows it."""
    docs = materialise(docs)
    left = docs.groupBy("key").agg((F.round(F.max("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    left = materialise(left)
    few = small(left, left.count())
    able = docs.join(few, "key").where(((F.col("left") > 0) & (F.col("copies") * F.col("size") + F.col("left") <= MOST * F.col("size"))) | ((F.col("left") < 0) & (F.col("copies") * F.col("size") + F.col("left") >= 0)))
    # An id that repeats with its size can't be told from its equals, so it isn't chosen.
    able = able.where("left <> 0 and doc_id is not null").groupBy("key", "size", "doc_id").agg(F.count("*").alias("n"), F.first("left").alias("left")).where("n = 1")
    chosen = able.groupBy("key").agg(F.max(F.struct("size", "doc_id")).alias("best"), F.first("left").alias("left"))
    chosen = materialise(chosen.select("key", F.col("best.size").alias("size"), F.col("best.doc_id").alias("doc_id"), "left"))
    docs = docs.join(small(chosen, chosen.count()), ["key", "size", "doc_id"], "left")
    part = F.coalesce(F.col("left"), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", part.alias("part"), (F.col("copies") * F.col("size") + part).alias("taken"))


def repeated(documents: DataFrame) -> DataFrame:
    """The rows of `documents`, each as often as the mix takes it whole, all columns as they are; those it doesn't take are gone."""
    copies = mix(documents).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("n")).where("n > 0")
    copies = materialise(copies.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), "size", "n"))
    rows = documents.select(F.struct("*").alias("d"))
    words = F.coalesce(F.regexp_count("d.text", F.lit(WORDS)), F.lit(0)).cast("long")
    same = F.col("d.doc_id").eqNullSafe(F.col("i")) & F.col("d.source").eqNullSafe(F.col("s")) & (words == F.col("size"))
    both = rows.join(small(copies, copies.count()), same).select("d", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("turn"))
    return both.select(*[F.col("d")[c].alias(c) for c in documents.columns])
