"""Secret scan in DataFrame functions only: fixed patterns, and a randomness battery with false-discovery control.

Base spans come from three patterns. Further spans are long tokens that look random. An encoding is inferred from a
token's characters, and three tests of randomness under it (chi-squared uniformity of the alphabet, runs above and
below the middle of the alphabet, lag-one serial correlation) give the battery's p. Against it stands ordinary text:
the likelihood ratio of the token's characters, uniform over its encoding's alphabet against the pair frequencies of
the corpus's ordinary words. Under ordinary text the ratio exceeds x with probability at most 1 / x whatever the
length, so that ENCODINGS / ratio / battery's p is a p-value, the smaller the longer a random token is. All tokens of
the input, those that the battery rejects too (their p is 1), go through the Benjamini-Hochberg procedure.

Matches become rows and their places running sums, so that the work grows in proportion to a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, small

# The patterns of the three base kinds, and the lengths below which a match is dropped.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "random")

_CLASS = "[A-Za-z0-9+/_=-]"
#: Tokens tested for randomness: maximal runs by length and characters, with a digit and a letter (dates, rules and words have not both).
TOKEN = rf"(?<!{_CLASS})(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z]){_CLASS}{{20,}}"
#: Words whose pairs of characters stand for ordinary text: shorter runs, and longer ones without a digit or a letter.
ORDINARY, LEAST_TESTED = rf"(?<!{_CLASS}){_CLASS}{{10,}}", 20
#: Level at which a test rejects randomness, and the false-discovery rate.
REJECT, RATE = 0.001, 0.001
#: Encodings that a token's is chosen from, and characters that a token may have.
ENCODINGS, CHARACTERS = 9, 67
#: Characters of a piece when long tokens and texts are cut up.
PIECE = 1024
MASK, CHUNK = "[SECRET]", 4096
_SPAN = "array<struct<start:int,end:int,kind:string>>"
_BINS = 400


def _matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Leftmost non-overlapping matches in order: what lies before each, in code points, its length, and the token tested."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), keep(m).alias("keep"), (m if kind == 3 else F.lit(None).cast("string")).alias("token")))
    return F.transform(pairs, lambda p, i: F.struct(F.lit(kind).alias("rank"), i.alias("pos"), p["gap"].alias("gap"), p["size"].alias("size"), p["keep"].alias("keep"), p["token"].alias("token")))


def _tail(z: Column) -> Column:
    """Two-sided normal tail of |z| (the bound of Abramowitz and Stegun 26.2.17, within 1e-7)."""
    x = F.least(F.abs(z), F.lit(30.0))
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2.0 * F.exp(-x * x / 2.0) * 0.3989422804014327 * poly)


def _encoding(token: Column) -> Column:
    """Alphabet of the smallest usual encoding that has all characters of the token."""
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        F.when(token.rlike("^[0-9]+$"), F.lit(digits))
        .when(token.rlike("^[0-9a-f]+$"), F.lit(digits + "abcdef"))
        .when(token.rlike("^[0-9A-F]+$"), F.lit(digits + "ABCDEF"))
        .when(token.rlike("^[A-Z2-7]+$"), F.lit(upper + "234567"))
        .when(token.rlike("^[0-9a-z]+$"), F.lit(digits + lower))
        .when(token.rlike("^[0-9A-Z]+$"), F.lit(digits + upper))
        .when(token.rlike("^[0-9A-Za-z]+$"), F.lit(digits + upper + lower))
        .when(token.rlike("^[0-9A-Za-z_-]+$"), F.lit(digits + upper + lower + "-_"))
        .otherwise(F.lit(digits + upper + lower + "+/=_-"))
    )


def _pairs(words: DataFrame, word: str, *carry: str) -> DataFrame:
    """A row for each character of each word, with the one before it (a space before the first): at, pair. Long words go piece by piece."""
    cut = words.select(*carry, F.char_length(word).alias("n"), F.concat(F.lit(" "), F.col(word)).alias("w"))
    cut = cut.where("n > 0").select(*carry, "n", "w", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))).alias("p"))
    cut = cut.select(*carry, "n", "p", F.substring("w", F.col("p") * PIECE + 1, F.lit(PIECE + 1)).alias("piece"))
    each = F.transform(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.col("n") - F.col("p") * PIECE)), lambda i: F.substring(F.col("piece"), i, F.lit(2)))
    return cut.select(*carry, "n", "p", F.posexplode(each).alias("at", "pair")).select(*carry, "n", (F.col("p") * PIECE + F.col("at")).alias("at"), "pair")


def ordinary_pairs(documents: DataFrame) -> DataFrame:
    """pair, log_p: natural logarithm of the probability of a pair's second character after its first, in ordinary words.

    Every different word of the whole input counts once. At most CHARACTERS * (CHARACTERS + 1) rows.
    """
    words = documents.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(ORDINARY), F.lit(0))).alias("word"))
    words = words.where((F.char_length("word") < LEAST_TESTED) | ~(F.col("word").rlike("[0-9]") & F.col("word").rlike("[A-Za-z]"))).distinct()
    counts = _pairs(words, "word").groupBy("pair").agg(F.count("*").alias("n")).withColumn("first", F.substring("pair", 1, 1))
    totals = counts.groupBy("first").agg(F.sum("n").alias("total"))
    return counts.join(totals, "first").select("pair", "first", F.log((F.col("n") + 0.5) / (F.col("total") + 0.5 * CHARACTERS)).alias("log_p"), F.log(0.5 / (F.col("total") + 0.5 * CHARACTERS)).alias("log_rest"))


def battery(tokens: DataFrame, ordinary: DataFrame) -> DataFrame:
    """row, start, end, p_random (smallest p of the three tests, times three), ratio (log likelihood ratio), p of every row of `tokens`.

    `tokens` has row, start, end, token; a token is cut into its characters, whose sums are all that the tests need.
    """
    t = tokens.withColumn("body", F.rtrim("token", F.lit("="))).withColumn("alphabet", _encoding(F.col("body")))
    c = _pairs(t, "body", "row", "start", "end", "alphabet")
    c = c.join(F.broadcast(ordinary.select("pair", "log_p")), "pair", "left").withColumn("first", F.substring("pair", 1, 1))
    c = c.join(F.broadcast(ordinary.select("first", "log_rest").distinct()), "first", "left")
    code = lambda at: (F.expr(f"instr(alphabet, substring(pair, {at}, 1))") - 1).cast("double")
    c = c.withColumn("k", F.char_length("alphabet").cast("double")).withColumn("code", code(2)).withColumn("before", F.when(F.col("at") > 0, code(1)))
    # At most 8 equal parts of the alphabet, so that short tokens have enough in each.
    c = c.withColumn("cells", F.greatest(F.lit(2.0), F.least(F.lit(8.0), F.floor(F.col("n") / 4.0).cast("double"))))
    high = lambda x: F.col(x) >= F.col("k") / 2.0
    sums = [
        F.sum(-F.log("k") - F.coalesce("log_p", "log_rest", -F.log(F.lit(float(CHARACTERS))))).alias("ratio"),
        F.sum("code").alias("s"),
        F.sum(F.col("code") * F.col("code")).alias("q"),
        F.sum(F.col("code") * F.col("before")).alias("l"),
        F.max(F.when(F.col("at") == 0, F.col("code"))).alias("c0"),
        F.max(F.when(F.col("at") == F.col("n") - 1, F.col("code"))).alias("c1"),
        F.count_if(high("code")).cast("double").alias("n1"),
        F.count_if(high("code") != high("before")).cast("double").alias("changes"),
        *[F.count_if(F.floor(F.col("code") * F.col("cells") / F.col("k")) == i).cast("double").alias(f"o{i}") for i in range(8)],
    ]
    t = c.groupBy("row", "start", "end", "n", "k", "cells").agg(*sums).withColumn("n", F.col("n").cast("double"))
    # Chi-squared; Wilson-Hilferty. Its upper tail is one-sided.
    edge = lambda i: F.ceil(i * F.col("k") / F.col("cells"))
    expected = lambda i: F.col("n") * (edge(i + 1) - edge(i)) / F.col("k")
    chi = sum((F.when(F.col("cells") > i, (F.col(f"o{i}") - expected(i)) * (F.col(f"o{i}") - expected(i)) / expected(i)).otherwise(0.0) for i in range(8)), F.lit(0.0))
    df = F.col("cells") - 1.0
    z_chi = F.greatest((F.pow(chi / df, F.lit(1 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df)), F.lit(0.0))
    n, n1 = F.col("n"), F.col("n1")
    mu = 1.0 + 2.0 * n1 * (n - n1) / n
    var = (mu - 1.0) * (mu - 2.0) / (n - 1.0)
    z_runs = F.when((n1 > 0) & (n1 < n) & (n > 1) & (var > 0), (F.col("changes") + 1.0 - mu) / F.sqrt(var)).otherwise(F.lit(30.0))
    mean = F.col("s") / n
    square = F.col("q") - n * mean * mean
    lagged = F.col("l") - mean * (2.0 * F.col("s") - F.col("c0") - F.col("c1")) + (n - 1.0) * mean * mean
    z_serial = F.when(square > 0, (lagged / square + 1.0 / n) * F.sqrt(n)).otherwise(F.lit(30.0))
    p_random = F.least(F.lit(1.0), 3.0 * F.least(_tail(z_chi) / 2.0, _tail(z_runs), _tail(z_serial)))
    t = t.select("row", "start", "end", "ratio", p_random.alias("p_random"))
    p = F.least(F.lit(1.0), ENCODINGS * F.exp(-F.col("ratio")) / F.col("p_random"))
    return t.withColumn("p", F.when(F.col("p_random") >= REJECT, F.greatest(p, F.lit(1e-300))).otherwise(F.lit(1.0)))


def _located(documents: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rows (keys, row), and the spans (row, rank, start, end, token) of base matches and of candidate tokens apart from them.

    The patterns run only where a cheap test can succeed. A match's place is the running sum of the lengths of matches
    and of what lies between them; base spans before and behind a token come from running maxima and minima.
    """
    text, none = F.col("text"), F.lit(None).cast("array<struct<rank:int,pos:int,gap:int,size:int,keep:boolean,token:string>>")
    long_value = lambda m: F.char_length(F.regexp_extract(m, "^" + ASSIGN + "$", 2)) >= ASSIGN_LEAST
    always = lambda m: F.lit(True)
    found = F.array(
        F.when(text.rlike(ASSIGN), _matches(text, ASSIGN, 0, long_value)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, 1, always)).otherwise(none),
        F.when(text.rlike(HEX), _matches(text, HEX, 2, always)).otherwise(none),
        F.when(text.rlike(TOKEN), _matches(text, TOKEN, 3, always)).otherwise(none),
    )
    rows = materialise(documents.select(*keys, F.monotonically_increasing_id().alias("row"), F.filter(found, lambda a: a.isNotNull()).alias("found")))
    each = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("kind")).select("row", F.explode("kind").alias("m")).select("row", "m.*")
    each = each.repartition(partitions(documents.sparkSession), "row")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = each.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size")).where("keep").select("row", "rank", "start", "end", "token")
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("rank") < 3
    spans = spans.withColumn("held", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(behind))
    apart = (F.coalesce("held", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return rows.select(*keys, "row"), materialise(spans.where(base | apart).drop("held", "next"))


def _spans(documents: DataFrame, rate: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rows (keys, row), and the spans (row, rank, start, end) that are reported."""
    rows, spans = _located(documents, keys)
    base, tokens = spans.where("rank < 3").drop("token"), spans.where("rank = 3")
    if tokens.isEmpty():
        return rows, base
    tested = battery(tokens.drop("rank"), materialise(ordinary_pairs(documents)))
    tested = materialise(tested.select("row", "start", "end", F.least(F.lit(_BINS), F.floor(-4.0 * F.log("p"))).cast("int").alias("bin")))
    # Benjamini-Hochberg on bins of -4 ln p (a bounded table): p of a bin is its largest.
    bins = sorted(((r["bin"], r["count"]) for r in tested.groupBy("bin").count().collect()), reverse=True)
    m, k, cut = sum(n for _, n in bins), 0, _BINS + 1
    for b, n in bins:
        k += n
        if 2.718281828459045 ** (-b / 4) <= k * rate / m:
            cut = b
    return rows, base.union(tested.where(F.col("bin") >= cut).select("row", F.lit(3).alias("rank"), "start", "end"))


def find(documents: DataFrame, rate: float = RATE, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keys` (doc_id), base and found (arrays of start, end, kind; code points, end exclusive) of every row's whole text.

    `base` has the spans of the fixed patterns by start, then kind as listed; `found` adds those of kind `random`,
    which overlap no base span, in the same order. A null or empty text has none. Repeated rows each get a row of
    their own. Other columns are not read.
    """
    rows, spans = _spans(documents.select(*keys, "text"), rate, list(keys))
    every = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("s"))
    named = lambda column: F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind")))
    s = F.coalesce(F.col("s"), F.array().cast("array<struct<start:int,rank:int,end:int>>"))
    return rows.join(every, "row", "left").select(*keys, named(F.filter(s, lambda x: x["rank"] < 3)).cast(_SPAN).alias("base"), named(s).cast(_SPAN).alias("found"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def _islands(spans: DataFrame) -> DataFrame:
    """row, start, end: overlapping spans of a row made one."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")).cast("int")
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(upto)).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def redact(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of `documents` with every span of `find` in `text` replaced by MASK, overlapping spans by one; all columns stay.

    A span is a function of its text, so spans come back by doc_id and the text's hash; rows without spans, null and
    empty texts among them, stay as they are. A text is masked chunk by chunk, with the spans of each chunk alone.
    Rows with spans are broadcast if their spans are few, else joined.
    """
    keyed = documents.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), "text")
    rows, spans = _spans(keyed, rate, ["i", "h"])
    cut = _islands(spans).select("row", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / CHUNK).cast("int"), F.floor((F.col("end") - 1) / CHUNK).cast("int"))).alias("c"))
    own = F.struct(F.greatest(F.col("start") - F.col("c") * CHUNK, F.lit(0)).alias("a"), F.least(F.col("end") - F.col("c") * CHUNK, F.lit(CHUNK)).alias("b"), (F.floor(F.col("start") / CHUNK) == F.col("c")).alias("first"))
    chunks = cut.groupBy("row", "c").agg(F.sort_array(F.collect_list(own), asc=False).alias("spans"), F.count("*").alias("n"))
    marks = chunks.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("c", "spans"))).alias("marks"), F.sum("n").alias("n"))
    marks = materialise(marks.join(rows, "row").groupBy("i", "h").agg(F.first("marks").alias("marks"), F.first("n").alias("n")))
    few = small(marks.drop("n"), marks.agg(F.sum("n")).first()[0] or 0)
    one = lambda t, s: F.concat(F.substring(t, F.lit(1), s["a"]), F.when(s["first"], F.lit(MASK)).otherwise(F.lit("")), F.substring(t, s["b"] + 1, F.char_length(t)))
    masked = F.array_join(F.transform(F.regexp_extract_all(F.col("d.text"), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda t, c: F.when(F.try_element_at(F.col("marks"), c).isNull(), t).otherwise(F.aggregate(F.try_element_at(F.col("marks"), c), t, one))), "")
    both = documents.select(F.struct("*").alias("d")).join(few, F.col("d.doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("d.text") == F.col("h")), "left")
    text = F.when(F.col("marks").isNull(), F.col("d.text")).otherwise(masked)
    return both.select(*[text.alias(c) if c == "text" else F.col("d")[c].alias(c) for c in documents.columns])
