"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, conversation_trie, embed_dedup, langid, minhash, mixing, quality, quality_rules, secrets, sentencepiece_bpe, toxicity, urlfilter
from .common import materialise, read, remainder


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.digests(sentencepiece_bpe.round_trip(documents, path))


def held_out(modulus: int, value: int):
    return F.coalesce(remainder("doc_id", modulus) == value, F.lit(False))


def learnable(frame: DataFrame, modulus: int, value: int) -> DataFrame:
    return frame.where(F.coalesce(remainder("doc_id", modulus) != value, F.lit(False)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    net = langid.fit(learnable(documents.select("doc_id", "text", "lang"), 5, 0))
    return langid.identify(documents, net).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(read(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = toxicity.fit(learnable(documents, 5, 0), learnable(read(spark, sf_dir, "labels"), 5, 0))
    scored = toxicity.score(documents, classifier)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def captures_and_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`pages` has no dates: fetch days and a dated list are derived from page ids, as stated in the README."""
    day = lambda factor: F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * factor, F.lit(365)).cast("int"))
    captures = pages.select("page_id", "url", day(7919).alias("fetched_on"))
    host = urlfilter.host_of(F.col("url"))
    labels = F.split(host, r"\.")
    turn = F.pmod("page_id", F.lit(16))
    pattern = F.when(turn == 3, host).when(turn == 7, F.array_join(F.slice(labels, -2, 2), ".")).when(turn == 11, urlfilter.plain(F.col("url")))
    action = F.when(F.pmod(F.floor(F.col("page_id") / 16), F.lit(3)) != 0, "block").otherwise("unblock")
    entries = pages.where(turn.isin(3, 7, 11) & (F.size(labels) >= 2)).select(pattern.alias("pattern"), day(104729).alias("dated"), action.alias("action"), F.col("page_id").alias("seq"))
    return captures, entries


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.evaluate(*captures_and_entries(read(spark, sf_dir, "pages").select("page_id", "url")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(documents, learnable(read(spark, sf_dir, "labels"), 3, 1))
    scored = quality.score(documents, net)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4)


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations that share beginnings, and every conversation's number of turns.

    Conversation c has the first crc32(c) % 9 turns of conversation c - c % 5, then its own turns after as many.
    """
    n = turns.groupBy("conv_id").agg(F.max("at").alias("n"))
    first = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(9)).alias("first")
    n = n.select("conv_id", "n", first, (F.col("conv_id") - F.col("conv_id") % 5).alias("stem"))
    stems = n.select(F.col("conv_id").alias("stem"), F.col("n").alias("n_stem"))
    n = n.join(stems, "stem", "left").select("conv_id", "stem", "first", F.least("first", F.coalesce("n_stem", F.lit(0))).alias("taken"), "n")
    n = materialise(n.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("first"), F.lit(0))))
    heads = turns.where("at <= 8").withColumnRenamed("conv_id", "stem").join(n.select("conv_id", "stem", "taken"), "stem").where("at <= taken").select("conv_id", "at", "digest", "n_bytes")
    tails = turns.join(n.select("conv_id", "first", "taken"), "conv_id").where("at > first").select("conv_id", (F.col("at") - F.col("first") + F.col("taken")).alias("at"), "digest", "n_bytes")
    return heads.union(tails), n.select("conv_id", "n_turns")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = branched(conversation_trie.ordered(read(spark, sf_dir, "conversations")))
    return conversation_trie.trie(turns, lengths)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.statistics(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary())


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#@]+)(:[0-9]*)?([^?#]*)"
OP6_SQL = rf"""
WITH h AS (SELECT row_number() OVER () AS capture, page_id, url, regexp_replace(lower(regexp_extract(url, '{_URL}', 2)), '\.$', '') AS host,
    DATE '2024-01-01' + CAST((page_id * 7919) % 365 AS INTEGER) AS fetched_on FROM pages),
p AS (SELECT *, CASE WHEN host <> '' THEN lower(regexp_extract(url, '{_URL}', 1)) || '://' || host || regexp_extract(url, '{_URL}', 3) || regexp_extract(url, '{_URL}', 4)
    ELSE coalesce(regexp_replace(url, '[?#].*$', ''), '') END AS u FROM h),
l AS (SELECT CASE page_id % 16 WHEN 3 THEN host WHEN 7 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE u END AS pattern,
    DATE '2024-01-01' + CAST((page_id * 104729) % 365 AS INTEGER) AS dated, page_id AS seq,
    CASE WHEN (page_id // 16) % 3 <> 0 THEN 'block' ELSE 'unblock' END AS action
    FROM p WHERE page_id % 16 IN (3, 7, 11) AND len(string_split(host, '.')) >= 2),
d AS (SELECT pattern, dated, arg_max(action, seq) AS action FROM l GROUP BY ALL),
s AS (SELECT pattern, dated AS since, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS until, action FROM d),
c AS (SELECT capture, page_id, fetched_on, host, 0 AS specificity, u AS pattern FROM p
    UNION ALL SELECT capture, page_id, fetched_on, host, i, array_to_string(string_split(host, '.')[i:], '.') FROM p, LATERAL (SELECT unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i)),
j AS (SELECT c.capture, c.page_id, host, fetched_on, specificity, s.pattern AS listed FROM c LEFT JOIN s ON c.pattern = s.pattern AND s.action = 'block' AND fetched_on >= since AND (until IS NULL OR fetched_on < until))
SELECT page_id, host, fetched_on, count(listed) AS n_active, count(listed) > 0 AS blocked, arg_min(listed, specificity) FILTER (WHERE listed IS NOT NULL) AS matched FROM j GROUP BY capture, page_id, host, fetched_on
"""

_REACH = """
r AS (SELECT n AS node, n AS reached FROM (SELECT DISTINCT a AS n FROM e) UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)
"""

OP7_SQL = (
    """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) = 64 AND list_sum(list_transform(x, lambda c: CASE WHEN c IS NULL OR NOT isfinite(c) THEN 1 ELSE 0 END)) = 0 AND list_dot_product(x, x) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.label = q.label AND p.vec_id <> q.vec_id
    WHERE list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))) >= 0.98),
"""
    + _REACH.strip()
    + """,
c AS (SELECT node, min(reached) AS low FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = node LEFT JOIN k ON vec_id = a
"""
)

OP10_SQL = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:least(i + 3, len(ws))], ' ') AS sh FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
"""
    + _REACH.strip()
    + """,
c AS (SELECT node, min(reached) AS low FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id, d.doc_id = coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
)

_BIT = "CASE WHEN o >= 256 THEN xor(c, o - 256) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
OP11_SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [256 + ascii(d), 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]))), lambda c, o: {_BIT}), 4294967295) % 9 AS h, conv_id - conv_id % 5 AS stem FROM t GROUP BY conv_id),
m AS (SELECT n.*, least(h, coalesce((SELECT s.n FROM n s WHERE s.conv_id = n.stem), 0)) AS taken FROM n),
r AS (SELECT m.conv_id, i, role, text FROM m JOIN t ON t.conv_id = stem AND i <= taken UNION ALL SELECT m.conv_id, i - h + taken, role, text FROM m JOIN t ON t.conv_id = m.conv_id AND i > h),
p AS (SELECT conv_id, i AS depth, sha256(string_agg(sha256(role || chr(31) || sha256(text)), '') OVER (PARTITION BY conv_id ORDER BY i)) AS k, octet_length(encode(text)) AS w FROM r
    UNION ALL SELECT conv_id, 0, '', 0 FROM n),
q AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
v AS (SELECT k, any_value(up) AS up, any_value(depth) AS depth, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS own FROM q GROUP BY k),
c AS (SELECT up AS k, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up),
x AS (SELECT v.*, coalesce(c.n, 0) AS n_children FROM v LEFT JOIN c ON c.k = v.k),
s AS (SELECT q.k, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.w) AS saved FROM x JOIN q ON q.conv_id = x.conv_id AND q.depth <= x.depth GROUP BY q.k)
SELECT x.conv_id, x.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(x.own, '')) AS ends_sha256
FROM x JOIN s ON s.k = x.k LEFT JOIN x u ON u.k = x.up
"""

_MEASURES = ", ".join(f"('{r}', {quality_rules.RULES[r][0].split(' / ')[0]}::DOUBLE / nullif({quality_rules.RULES[r][0].split(' / ')[1]}, 0))" for r in quality_rules.RULES)
_CUTS = ", ".join(f"('{r}', {i}, {c!r}::DOUBLE, {k})" for k, r in enumerate(quality_rules.RULES) for i, c in enumerate(quality_rules.cuts(r)))
_SHARE = quality_rules.LOSS / len(quality_rules.RULES)
OP12_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 1, 1))) AS i)),
u AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM u, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(x, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
l AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, good, m.* FROM e JOIN l ON l.doc_id = e.doc_id, LATERAL (VALUES {_MEASURES}) m(rule, worth) WHERE NOT base_failed),
s AS (SELECT DISTINCT stratum FROM h),
c AS (SELECT * FROM (VALUES {_CUTS}) c(rule, step, cut, turn)),
k AS (SELECT s.stratum, c.rule, step, cut, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad,
    coalesce(sum((worth > cut)::INT) FILTER (WHERE good), 0) AS g, coalesce(sum((worth > cut)::INT) FILTER (WHERE NOT good), 0) AS b FROM s JOIN h ON h.stratum = s.stratum JOIN c ON c.rule = h.rule GROUP BY ALL),
q AS (SELECT *, list_sum(list_transform(range(0, g::BIGINT + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({_SHARE!r}) + (n_good - i) * ln(1 - {_SHARE!r})))) AS tail FROM k),
o AS (SELECT *, bool_and(n_good > 0 AND tail <= {quality_rules.RISK!r} / ({len(quality_rules.RULES)} * (SELECT count(*) FROM s))) OVER (PARTITION BY stratum, rule ORDER BY step) AS passed, b / nullif(n_bad, 0) - g / nullif(n_good, 0) AS gain FROM q),
y AS (SELECT stratum, rule, cut FROM o WHERE passed AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) = 1),
z AS (SELECT e.doc_id, string_agg(m.rule, ',' ORDER BY turn) AS broken FROM e, LATERAL (VALUES {_MEASURES}) m(rule, worth) JOIN y ON y.stratum = e.stratum AND y.rule = m.rule AND m.worth > y.cut JOIN (SELECT DISTINCT rule, turn FROM c) r ON r.rule = y.rule GROUP BY e.doc_id)
SELECT e.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken IS NULL AS kept, stratum, coalesce(broken, '') AS broken FROM e LEFT JOIN z ON z.doc_id = e.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_nearest_neighbours, op4_secret_scan, op5_toxicity, op6_url_filter, op7_embedding_dedup, op8_quality, op9_mixing, op10_minhash, op11_conversation_trie, op12_quality_rules, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op7_embedding_dedup": OP7_SQL, "op10_minhash": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op12_quality_rules": OP12_SQL}
