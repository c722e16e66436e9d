"""Quality rules whose cutoffs carry a guarantee: a bounded share of good documents is rejected in every stratum.

Each rule is a measure of which more is worse, with a grid of cutoffs that is fixed beforehand and runs from lenient to
strict. Labelled documents that pass the base rules are the holdout. For a stratum, a rule and a cutoff, the hypothesis
"more than LOSS / rules of the good documents are rejected" is tested with the exact binomial tail of the rejected ones
among the good ones. Cutoffs are tested from lenient to strict until one fails, which needs no correction within a grid;
over strata and rules the level is RISK / (strata * rules). Among the cutoffs that passed, the one with the largest
difference between the rejected shares of bad and good documents is taken, the most lenient among equals; where none
passes or none rejects a bad document, the rule rejects nothing in that stratum. So with probability 1 - RISK no stratum
loses more than LOSS of its good documents to all rules together.

Everything is a DataFrame expression; the counts of the holdout are one aggregate of strata * rules * cutoffs rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, materialise, small

#: Share of good documents that all rules together may reject in a stratum, and the probability that this may fail.
LOSS, RISK = 0.03, 0.05
#: Words below which a document fails, and the share of words in repeated windows above which it fails.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Cutoffs of a rule, evenly spaced from the lenient to the strict end.
CUTS = 60
#: Per rule: the measure over the counts (more is worse), the most lenient and the strictest cutoff.
RULES = {
    "symbols": ("n_symbols / word_chars", 0.6, 0.01),
    "repeated_lines": ("n_dup_lines / n_lines", 0.9, 0.01),
    "repeated_words": ("n_repeat_words / n_words", 0.5, 0.01),
    "long_words": ("word_chars / n_words", 18.0, 6.2),
    "short_words": ("-word_chars / n_words", -1.0, -4.5),
    "capitals": ("n_capitals / word_chars", 0.9, 0.2),
}
SPACE = r"[\x20\x09-\x0D]+"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]


def _same(a: Column, b: Column) -> Column:
    return (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])


def counts(documents: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns `keep`, and the counts of every row's whole text; a null text has no words.

    The three-word windows of a text, if any of their hashes is found twice, are sorted with their places; equal
    neighbours are the repeated ones, and the words that they cover are counted from the gaps between their places. Nothing leaves the row, so nothing is shuffled; an
    executor holds some two hundred bytes a word of the text in hand.
    """
    text, w, n = F.coalesce(F.col("text"), F.lit("")), F.col("_words"), F.size("_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = lambda c: F.char_length(c).cast("long")
    parts = documents.select(
        "doc_id",
        *keep,
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
        lines.alias("_lines"),
        (length(text) - length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_capitals"),
    )
    # a text whose windows have different hashes repeats none; only the others are sorted
    triples = lambda make: F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), make)
    window = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("at"))
    hashes = F.when(n >= 3, F.size(F.array_distinct(triples(lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))))
    windows = F.when(hashes < n - 2, F.sort_array(triples(window)))
    parts = parts.withColumns({"_windows": windows, "word_chars": length(F.array_join("_words", "")), "n_words": n.cast("long"), "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    s = F.col("_windows")
    again = F.filter(s, lambda x, i: F.coalesce(_same(x, F.get(s, i + 1)), F.lit(False)) | F.when(i > 0, _same(x, F.get(s, i - 1))).otherwise(F.lit(False)))
    places = F.sort_array(F.transform(again, lambda x: x["at"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    covered = F.aggregate(places, start, lambda z, p: F.struct((z["n"] + F.least(F.lit(3), p - z["at"])).alias("n"), p.alias("at")), lambda z: z["n"].cast("long"))
    return parts.select("doc_id", *keep, *[c for c in _COUNTS if c != "n_repeat_words"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))


def measure(rule: str) -> Column:
    """The rule's measure; null where its denominator is 0, which breaks no rule."""
    over, under = RULES[rule][0].split(" / ")
    return F.try_divide(F.expr(over).cast("double"), F.expr(under).cast("double"))


def cuts(rule: str) -> list[float]:
    _, lenient, strict = RULES[rule]
    return [lenient + (strict - lenient) * i / (CUTS - 1) for i in range(CUTS)]


def _cut(rule: str, step: Column) -> Column:
    """`cuts` of a step."""
    _, lenient, strict = RULES[rule]
    return lenient + (strict - lenient) * step / (CUTS - 1)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series eight steps further up, less the steps."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    return series - F.log(steps)


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """Probability of at most k among n at this share; 1 from the mean on, where it is a half or more and decides nothing.

    The likeliest term comes from log-gammas, the terms below it by their ratios. They fall faster than a normal curve
    of the same variance: twelve deviations and fifty terms hold all but some 1e-30 of the sum.
    """
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(share)) + (n - k) * F.log(F.lit(1 - share)))
    last = F.least(k, F.ceil(12 * F.sqrt(n * share)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(z, j):
        term = z["term"] * (k - j) * (1 - share) / ((n - k + j + 1) * share)
        return F.struct(term.alias("term"), (z["sum"] + term).alias("sum"))

    below = F.aggregate(F.sequence(F.lit(0), last), start, add, lambda z: z["sum"])
    return F.when(k >= n * share, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * below))


def certify(holdout: DataFrame) -> DataFrame:
    """For each stratum, rule and cutoff: good and rejected documents, the tail, whether it passed, and whether it is the one taken.

    `holdout` has stratum, good (boolean) and the counts; rows of a null `good` are not read.
    """
    steps = F.sequence(F.lit(0), F.lit(CUTS - 1))

    def first_cut(r):
        """The first cutoff that rejects; CUTS where none does."""
        kept_by = F.filter(steps, lambda i: _cut(r, i) >= measure(r))
        return F.struct(F.lit(r).alias("rule"), F.when(measure(r).isNull(), CUTS).otherwise(F.size(kept_by)).alias("step"))

    seen = holdout.where("good is not null").select("stratum", "good", F.inline(F.array(*map(first_cut, RULES))))
    number = lambda good: F.sum(F.when(F.col("good") == F.lit(good), 1).otherwise(0))
    rejected = materialise(seen.groupBy("stratum", "rule", "step").agg(number(True).alias("g"), number(False).alias("b")))
    strata, n_strata = counted(rejected.select("stratum").distinct())
    cell = lambda r: lambda i: F.struct(F.lit(r).alias("rule"), i.alias("step"), F.when(i < CUTS, _cut(r, i)).alias("cut"))
    grid = [F.transform(F.sequence(F.lit(0), F.lit(CUTS)), cell(r)) for r in RULES]
    cells = strata.select("stratum", F.inline(F.concat(*grid)))
    whole = Window.partitionBy("stratum", "rule")
    up = whole.orderBy("step")
    totals = [F.sum(F.coalesce(c, F.lit(0))).over(w).alias(name) for c, w, name in (("g", whole, "n_good"), ("b", whole, "n_bad"), ("g", up, "good_rejected"), ("b", up, "bad_rejected"))]
    table = cells.join(rejected, ["stratum", "rule", "step"], "left").select("stratum", "rule", "step", "cut", *totals).where(F.col("step") < CUTS)
    table = table.withColumn("tail", binomial_tail(F.col("n_good"), F.col("good_rejected"), LOSS / len(RULES)))
    table = table.withColumn("passed", F.bool_and(F.col("tail") <= RISK / (len(RULES) * max(n_strata, 1))).over(up))
    gain = F.try_divide("bad_rejected", "n_bad") - F.try_divide("good_rejected", "n_good")
    table = table.withColumn("gain", F.when(F.col("passed") & (gain > 0), gain))
    best = F.min_by("step", F.when(F.col("gain").isNotNull(), F.struct(-F.col("gain"), F.col("step")))).over(whole)
    return table.withColumn("taken", F.coalesce(F.col("step") == best, F.lit(False)))


def judge(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per row of `documents`: doc_id, counts, base_failed, kept, stratum and broken (the rules broken, by commas).

    `labels` has doc_id and quality; a document is good if all its labels are 1. A null stratum is the empty one. A
    document without words fails the base rules. Repeated rows are each judged, and each counted in the holdout; rows
    without an id have no label. Other columns are not read.
    """
    own = documents.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    measured = materialise(counts(own, "stratum"))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    certified = certify(measured.where(~base_failed()).join(good, "doc_id"))
    taken, n = counted(certified.where("taken").groupBy(F.col("stratum").alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("_cuts")))
    judged = measured.join(small(taken, n), F.col("stratum") == F.col("_of"), "left")
    broken = F.filter(F.array(*[F.when(measure(r) > F.try_element_at("_cuts", F.lit(r)), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    judged = judged.withColumns({"broken": F.array_join(broken, ","), "base_failed": base_failed()})
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "stratum", "broken")
