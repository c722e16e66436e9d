"""URL filter: dated list entries become validity intervals; an as-of join tests each capture against those active at its fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small

#: Scheme, user (before the last `@` of the authority; left out), host (an IPv6 address in brackets too), port, path.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#@]+)(:[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without a dot at its end; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL, 2)), r"\.$", "")


def plain(url: Column) -> Column:
    """The URL as lists name it: scheme and host in lower case, no user, query or fragment; what has no host stays, without both."""
    part = lambda k: F.regexp_extract(url, URL, k)
    return F.when(host_of(url) != "", F.concat(F.lower(part(1)), F.lit("://"), host_of(url), part(3), part(4))).otherwise(F.regexp_replace(url, "[?#].*$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since, until (exclusive, null: still open): the spans of days in which a pattern is blocked.

    `entries` has pattern, dated (date), action (`block` or `unblock`) and seq; of one pattern's entries of a day the
    one of the largest seq holds (ties: the larger action). Entries with nulls are left out. The next entry is looked
    for within a month, then among the first days of the pattern's months, so that no task gets a pattern's whole history.
    """
    day = entries.where("pattern is not null and dated is not null and action in ('block', 'unblock') and seq is not null").groupBy("pattern", "dated").agg(F.max(F.struct("seq", "action")).alias("last"))
    day = day.select("pattern", "dated", F.col("last.action").alias("action"), F.trunc("dated", "month").alias("month"))
    months = day.groupBy("pattern", "month").agg(F.min("dated").alias("first"))
    months = months.select("pattern", "month", F.lead("first").over(Window.partitionBy("pattern").orderBy("month")).alias("later"))
    within = day.withColumn("next", F.lead("dated").over(Window.partitionBy("pattern", "month").orderBy("dated")))
    spans = within.where("action = 'block'").join(months, ["pattern", "month"])
    return spans.select("pattern", F.col("dated").alias("since"), F.coalesce("next", "later").alias("until"))


def candidates(captures: DataFrame) -> DataFrame:
    """Every capture with the patterns that can match it, and their rank: the plain URL, then the host and its parent
    domains of at least two labels, the longest first. Columns: capture, page_id, fetched_on, host, specificity, pattern."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rows = captures.select(F.monotonically_increasing_id().alias("capture"), "page_id", "fetched_on", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(plain(F.col("url")), F.lit("")).alias("plain"))
    return rows.select("capture", "page_id", "fetched_on", "host", F.posexplode(F.concat(F.array("plain"), parents)).alias("specificity", "pattern"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched_on, n_active (patterns blocked at the fetch), blocked, matched (the most specific one).

    `captures` has page_id, url, fetched_on; every row is a capture of its own and gives one row, those with repeated
    or null ids too; other columns are not read. A null url or date matches nothing, an empty list blocks nothing, no
    captures give no rows. Paths differ by case, hosts do not. Only the list's spans, one row a pattern and change, are
    broadcast, and only when few; else patterns are joined, where a host of very many captures is split by adaptive
    execution.
    """
    spans = materialise(intervals(entries))
    there = (F.col("fetched_on") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_on") < F.col("until")))
    tried = candidates(captures)
    both = tried.join(small(spans.withColumnRenamed("pattern", "listed"), spans.count()), (F.col("pattern") == F.col("listed")) & there, "left")
    out = both.groupBy("capture", "page_id", "host", "fetched_on").agg(F.count("listed").alias("n_active"), F.min(F.when(F.col("listed").isNotNull(), F.struct("specificity", "listed"))).alias("first"))
    return out.select("page_id", "host", "fetched_on", "n_active", (F.col("n_active") > 0).alias("blocked"), F.col("first.listed").alias("matched"))
