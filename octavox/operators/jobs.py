"""Job lists over voxel files: nearest-neighbour and constraint searches of files met by name, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octavox.operators import grid, joins, search

#: Commands of a job list, with the arguments of each: a file and amounts, a file and a number, three files.
COMMANDS = ("DCSearch", "NNSearch", "DCSearch2")


def _file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _of(jobs: DataFrame, shapes: DataFrame, argument: int) -> DataFrame:
    """Words of the file that an argument names, under the job's number; an empty word for a file without voxels."""
    named = jobs.withColumn("_file", _file(F.get("args", F.lit(argument)))).join(shapes, "_file")
    return named.select(F.col("job").cast("long").alias("shape_id"), F.explode_outer("words").alias("w")).select("shape_id", *[F.coalesce(F.col(f"w.{c}").cast("long"), F.lit(0).cast("long")).alias(c) for c in ("block", "bits")])


def _changed(jobs: DataFrame, shapes: DataFrame, argument: int, change, resolution: float) -> DataFrame:
    """The jobs' first files, changed by as many steps as the amount in an argument needs; jobs of one number of steps together.

    The amounts of a list are its parameters, so their different values are few.
    """
    amount = F.get("args", F.lit(argument)).cast("double")
    own = jobs.withColumn("_amount", F.coalesce(amount, F.lit(0.0)))
    whole = None
    for r in own.select("_amount").distinct().orderBy("_amount").collect():
        words = _of(own.where(F.col("_amount") == r["_amount"]), shapes, 0)
        n = grid.steps(r["_amount"], resolution)
        none = words.select("shape_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("bits")).distinct()
        made = (change(words, n).select("shape_id", F.col("block").cast("long").alias("block"), "bits").unionByName(none) if n else words).groupBy("shape_id", "block").agg(F.bit_or("bits").alias("bits"))
        whole = made if whole is None else whole.unionByName(made)
    return whole


def run(jobs: DataFrame, read: DataFrame, words: DataFrame, levels: int, resolution: float) -> DataFrame:
    """job, file, object_id, score, rank of the answers of all jobs.

    `jobs` is a parsed list, `read` its voxel files, which are met by their names, `words` the shapes that are searched, with a
    word for empty ones too. NNSearch takes the k nearest, all for a k below 1; DCSearch the shapes between its file shrunk and
    grown by two amounts, DCSearch2 those between two other files. Scores are distances from the first file; ranks go by
    score, then id. An unknown command, a file that isn't there or one of another grid is an error.
    """
    jobs = jobs.where(F.length("command") > 0)
    bad = jobs.where(~F.col("command").isin(*COMMANDS)).first()
    if bad:
        raise ValueError(f"job {bad['job']} has the unknown command {bad['command']}")
    shapes = read.select(_file(F.col("title")).alias("_file"), "side", "words")
    files = F.when(F.col("command") == "DCSearch2", F.col("args")).otherwise(F.slice("args", 1, 1))
    named = jobs.select("job", F.explode(files).alias("_path")).withColumn("_file", _file(F.col("_path"))).join(shapes, "_file", "left")
    bad = named.where(F.col("side").isNull() | (F.col("side") != 1 << levels)).first()
    if bad:
        raise ValueError(f"job {bad['job']}: {bad['_path']} is missing or not of the searched shapes' grid")
    packed = search.packed(words)
    asked = search.packed(_of(jobs, shapes, 0)).withColumnRenamed("shape_id", "query_id").select("query_id", F.col("words").alias("qw"), F.col("volume").alias("qn"))
    of = lambda command: jobs.where(F.col("command") == command)
    found = search.scored(search.packed(_of(of("NNSearch"), shapes, 0)), packed).select("query_id", "object_id", "dist")
    whole = [(found, True)]
    shrunk = _changed(of("DCSearch"), shapes, 1, lambda w, n: grid.shrink(w, levels, n), resolution)
    if shrunk is not None:
        whole.append((joins.between(shrunk, words, _changed(of("DCSearch"), shapes, 2, lambda w, n: grid.grow(w, levels, n), resolution)), False))
    whole.append((joins.between(_of(of("DCSearch2"), shapes, 1), words, _of(of("DCSearch2"), shapes, 2)), False))
    out = None
    for hits, scored in whole:
        if not scored:
            hits = hits.join(asked, "query_id").select("query_id", "object_id", search.tanimoto(search.common("qw", "ow"), F.col("qn"), F.col("n")).alias("dist"))
        out = hits if out is None else out.unionByName(hits)
    k = F.when(F.col("command") == "NNSearch", F.coalesce(F.get("args", F.lit(1)).cast("int"), F.lit(1))).otherwise(0)
    out = search.top_k(out, 0).join(jobs.select(F.col("job").cast("long").alias("query_id"), F.get("args", F.lit(0)).alias("file"), k.alias("k")), "query_id")
    return out.where("k < 1 or rank <= k").select(F.col("query_id").alias("job"), "file", "object_id", F.col("dist").alias("score"), "rank")


def lines(answers: DataFrame, objects: DataFrame, text: str = "title") -> DataFrame:
    """job, rank, value: an answer's line, RES, the job's file, the object's text and the score with up to six digits."""
    digits = F.regexp_replace(F.regexp_replace(F.round("score", 6).cast("decimal(20,6)").cast("string"), r"0+$", ""), r"\.$", "")
    named = answers.join(objects.select(F.col("shape_id").alias("object_id"), F.col(text).alias("_text")), "object_id")
    return named.select("job", "rank", F.format_string("RES %s\t%s\t%s", "file", "_text", digits).alias("value"))
