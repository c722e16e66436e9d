"""Screening analytics on labelled scores (positive: boolean, score: double; higher is better)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octavox.functions.ordered import before, ranged

#: Resamples of a bootstrap, and its interval.
REPLICATES, LOWER, UPPER = 2000, 0.05, 0.95
#: Arguments of the commands in job lists of molecules.
ARGUMENTS = {"DCSearch": 4, "NNSearch": 2, "DCSearch2": 3}


def by_score(scored: DataFrame) -> DataFrame:
    """One row a distinct score: positives and negatives there."""
    return scored.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))


def roc(scored: DataFrame) -> DataFrame:
    """score, tp, fp, tpr, fpr at every threshold `at least score`, and p, n at the score itself."""
    counts = by_score(scored)
    s = before(counts, [F.desc("score")], {"tp": "p", "fp": "n"}).select("score", "p", "n", (F.col("tp") + F.col("p")).alias("tp"), (F.col("fp") + F.col("n")).alias("fp"))
    s = s.join(F.broadcast(counts.agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))), F.lit(True))
    return s.select("score", "tp", "fp", F.try_divide("tp", "ps").alias("tpr"), F.try_divide("fp", "ns").alias("fpr"), "p", "n", "ps", "ns")


def auc(scored: DataFrame) -> DataFrame:
    """positives, negatives, auc: wins of positives over negatives, ties count half; integers until the division; null without both classes."""
    s = before(by_score(scored), [F.col("score")], {"below": "n"})
    s = s.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(2 * F.col("p") * F.col("below") + F.col("p") * F.col("n")).alias("twice"))
    return s.select("positives", "negatives", F.try_divide(F.col("twice"), 2.0 * F.col("positives") * F.col("negatives")).alias("auc"))


def auc_by(scored: DataFrame, *groups: str) -> DataFrame:
    """`groups`, auc of each group; a group's distinct scores are summed up in a window of their own."""
    s = scored.groupBy(*groups, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*groups).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("below", below).groupBy(*groups).agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"), F.sum(2 * F.col("p") * F.col("below") + F.col("p") * F.col("n")).alias("twice"))
    return s.select(*groups, F.try_divide(F.col("twice"), 2.0 * F.col("ps") * F.col("ns")).alias("auc"))


def partial_auc(scored: DataFrame, limits=(0.01, 0.05, 0.1)) -> DataFrame:
    """fpr_limit, partial, standardised: area up to each false-positive rate, and McClish's scaling of it to 0.5 to 1; null without both classes."""
    seg = roc(scored).select(F.try_divide(F.col("fp") - F.col("n"), "ns").alias("x0"), F.try_divide(F.col("tp") - F.col("p"), "ps").alias("y0"), F.col("fpr").alias("x1"), F.col("tpr").alias("y1"))
    cut = seg.select("*", F.explode(F.array(*[F.lit(float(x)) for x in limits])).alias("fpr_limit")).where("x0 < fpr_limit and x1 > x0")
    end = F.least("x1", "fpr_limit")
    y = F.col("y0") + (F.col("y1") - F.col("y0")) * (end - F.col("x0")) / (F.col("x1") - F.col("x0"))
    area = cut.groupBy("fpr_limit").agg(F.sum((end - F.col("x0")) * (F.col("y0") + y) / 2.0).alias("partial"))
    low, high = F.col("fpr_limit") * F.col("fpr_limit") / 2.0, F.col("fpr_limit")
    every = scored.sparkSession.createDataFrame([(float(x),) for x in limits], "fpr_limit double")
    area = every.join(area, "fpr_limit", "left")
    return area.select("fpr_limit", F.round("partial", 10).alias("partial"), F.round(0.5 * (1.0 + (F.col("partial") - low) / (high - low)), 10).alias("standardised"))


def pareto(points: DataFrame) -> DataFrame:
    """Points of which none has as low an fpr and as high a tpr: tpr rises strictly with fpr."""
    best = points.groupBy("fpr").agg(F.max("tpr").alias("tpr"))
    return before(best, [F.col("fpr")], tops={"top": "tpr"}).where("top is null or tpr > top").select("fpr", "tpr")


def tail(hits: int, drawn: int, positives: int, total: int) -> float:
    """P(at least `hits` positives among `drawn` of `total` with `positives`), by ratios of neighbouring terms from the nearer end."""
    low, high = max(0, drawn - (total - positives)), min(drawn, positives)
    if hits <= low:
        return 1.0
    if hits > high:
        return 0.0
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    log_p = lambda k: choose(positives, k) + choose(total - positives, drawn - k) - choose(total, drawn)
    up = (positives - hits) * (drawn - hits) <= (hits + 1) * (total - positives - drawn + hits + 1)
    k, term, sums = (hits, 1.0, 1.0) if up else (hits - 1, 1.0, 1.0)
    first = k
    while (k < high) if up else (k > low):
        if up:
            term *= (positives - k) * (drawn - k) / ((k + 1) * (total - positives - drawn + k + 1))
            k += 1
        else:
            term *= k * (total - positives - drawn + k) / ((positives - k + 1) * (drawn - k + 1))
            k -= 1
        sums += term
        if term < 1e-18 * sums:
            break
    p = sums * math.exp(log_p(first))
    return min(1.0, p) if up else max(0.0, 1.0 - p)


def enrichment(counts: DataFrame, searches: int | None = None) -> DataFrame:
    """search, hits, drawn, positives, total, p_value: hypergeometric tail, times the searches (all rows by default), at most 1."""
    times = counts.count() if searches is None else searches
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select("search", "hits", "drawn", "positives", "total").schema)

    def value(batches):
        for part in batches:
            part["p_value"] = [min(1.0, times * tail(int(h), int(d), int(p), int(t))) for h, d, p, t in zip(part["hits"], part["drawn"], part["positives"], part["total"], strict=True)]
            yield part

    return counts.select("search", "hits", "drawn", "positives", "total").mapInPandas(value, f"{schema}, p_value double")


def bootstrap_auc(scored: DataFrame, replicates: int = REPLICATES, lower: float = LOWER, upper: float = UPPER, seed: int = 1) -> DataFrame:
    """lower, upper of the AUC over Poisson resamples; those with one class are left out.

    Rows of one score and class resampled together are one Poisson draw of their number. Draws are seeded by the
    score, so that reruns agree. Ranges of scores sum up all resamples at once; a row a range and resample is gathered.
    """

    def resample(batches):
        place, (p, n, twice) = None, (np.zeros(replicates, np.int64) for _ in range(3))
        for part in batches:
            place = int(part["_range"].iat[0]) if len(part) else place
            for score, a, b in zip(part["score"].to_numpy(float), part["p"], part["n"], strict=True):
                rng = np.random.default_rng([seed, int(np.float64(score).view(np.uint64))])
                own, other = rng.poisson(a, replicates), rng.poisson(b, replicates)
                twice += own * (2 * n + other)
                p += own
                n += other
        if place is not None:
            yield pd.DataFrame({"place": place, "rep": range(replicates), "p": p, "n": n, "twice": twice})

    ranges = ranged(by_score(scored), F.col("score")).sortWithinPartitions("score").mapInPandas(resample, "place int, rep int, p long, n long, twice long")
    under = F.coalesce(F.sum("n").over(Window.partitionBy("rep").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = ranges.withColumn("under", under).groupBy("rep").agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"), F.sum(F.col("twice") + 2 * F.col("p") * F.col("under")).alias("twice"))
    a = a.where("ps > 0 and ns > 0").select((F.col("twice") / (2.0 * F.col("ps") * F.col("ns"))).alias("auc"))
    return a.agg(F.percentile("auc", F.lit(lower)).alias("lower"), F.percentile("auc", F.lit(upper)).alias("upper"))


def reduced_counts(hits: DataFrame, search: str, title: str) -> DataFrame:
    """`search`, hits, titles: answers of a search, and compounds among them, of which conformers share a title."""
    return hits.groupBy(search).agg(F.count("*").alias("hits"), F.countDistinct(title).alias("titles"))


def table(values: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """One row a `row`, a column for each of the names, holding the value."""
    return values.groupBy(row).pivot(column, names).agg(F.first(value))


def parse_log(lines: DataFrame, arguments: dict[str, int] = ARGUMENTS) -> DataFrame:
    """file, line, part, kind, text, trial, seconds: timing lines of logs (`file`, `line` number, `value`).

    A line `# DCPTS n` begins part n of its file. `Batch <command> <arguments> t1 t2 ...` gives a row for each time; a
    command has as many arguments as `arguments` says (lists of voxel files give DCSearch three). `Found ... t s ...` gives
    one of kind Found. The last mark is carried in two passes over ranges of lines, so a file may go over many tasks.
    """
    mark = F.regexp_extract("value", r"^# DCPTS (\d+)", 1)
    marked = lines.withColumn("_mark", F.when(mark != "", F.struct("file", "line", F.expr("cast(regexp_extract(value, '^# DCPTS (\\\\d+)', 1) as int)").alias("part"))))
    parts = before(marked, [F.col("file"), F.col("line")], tops={"_last": "_mark"})
    parts = parts.withColumn("part", F.when(F.col("_last.file") == F.col("file"), F.col("_last.part")))
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for pair in arguments.items() for x in pair])
    batch = parts.where(F.col("value").startswith("Batch ")).withColumn("_w", words).withColumn("_n", F.coalesce(F.try_element_at(known, F.get("_w", F.lit(1))), F.lit(0)))
    told = F.array_join(F.slice("_w", F.lit(2), F.col("_n") + 1), " ")
    times = F.slice("_w", F.col("_n") + 3, F.greatest(F.size("_w") - F.col("_n") - 2, F.lit(0)))
    batch = batch.select("file", "line", "part", F.get("_w", F.lit(1)).alias("kind"), told.alias("text"), F.posexplode(times).alias("trial", "t"))
    batch = batch.select("file", "line", "part", "kind", "text", "trial", F.expr("try_cast(t as double)").alias("seconds"))
    taken = F.regexp_extract("value", r"Found.* (\S+) s ", 1)
    found = parts.where(taken != "").select("file", "line", "part", F.lit("Found").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("trial"), F.expr("try_cast(regexp_extract(value, 'Found.* (\\\\S+) s ', 1) as double)").alias("seconds"))
    return batch.unionByName(found)


def part_times(parsed: DataFrame) -> DataFrame:
    """part, seconds: what each part's searches took, the last `Found` time of every file that has the part."""
    last = parsed.where("kind = 'Found'").groupBy("file", "part").agg(F.max_by("seconds", "line").alias("seconds"))
    return last.groupBy("part").agg(F.sum("seconds").alias("seconds"))
