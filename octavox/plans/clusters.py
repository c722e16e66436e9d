"""Registered cluster aggregates, neighbour graphs and subset queries, over all members on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from octavox.operators import clusters, search
from octavox.plans.queries import EMB, EVERY, REGISTRY, SQL, query
from octavox.sources import shapes

#: All vectors against all.
WHOLE = EMB.replace(f"% {EVERY} = 0", "% 1 = 0")
LINK = WHOLE + ", l AS (SELECT a.label AS query_label, b.label AS object_label, dist FROM d JOIN ids a ON a.id = query_id JOIN ids b ON b.id = object_id)"

for _name, _column, _agg, _digits in (("complete", "complete", "max(dist)", None), ("single", "single", "min(dist)", None), ("total", "total", "round(sum(dist), 6)", 6), ("average", "average", "round(avg(dist), 9)", 9)):
    SQL[f"linkage_{_name}"] = LINK + f" SELECT query_label, object_label, {_agg} AS dist FROM l GROUP BY ALL"
    REGISTRY[f"linkage_{_name}"] = lambda spark, sf_dir, c=_column, n=_digits: clusters.linkage(shapes.sign_shapes(spark, sf_dir)).select("query_label", "object_label", (F.col(c) if n is None else F.round(c, n)).alias("dist"))

MEANS = WHOLE + ", t AS (SELECT ids.label, query_id, round(avg(dist), 9) AS mean, max(dist) AS most FROM d JOIN ids ON ids.id = query_id JOIN ids b ON b.id = object_id AND b.label = ids.label GROUP BY ALL) "


@query(MEANS + "SELECT label, arg_min(query_id, (mean, query_id)) AS medoid, min(mean) AS mean FROM t GROUP BY label")
def medoid(spark, sf_dir):
    return clusters.medoids(shapes.sign_shapes(spark, sf_dir)).select("label", "medoid", "mean")


@query(MEANS + "SELECT label, arg_min(query_id, (most, query_id)) AS medoid, min(most) AS most FROM t GROUP BY label")
def medoid_by_radius(spark, sf_dir):
    """The member whose farthest member is nearest."""
    return clusters.medoids(shapes.sign_shapes(spark, sf_dir)).select("label", F.col("centre").alias("medoid"), "most")


@query(WHOLE + "SELECT query_id AS src, object_id AS dst, dist AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, object_id) AS r FROM d WHERE query_id <> object_id) WHERE r <= 8")
def knn_graph(spark, sf_dir):
    return clusters.knn(shapes.sign_shapes(spark, sf_dir), 8)


@query(f"WITH e AS ({SQL['knn_graph']}) SELECT dst AS src, count(*)::BIGINT AS n, min(src) AS low FROM e GROUP BY dst")
def reverse_neighbours(spark, sf_dir):
    return knn_graph(spark, sf_dir).groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("n"), F.min("src").alias("low"))


@query(f"WITH e AS ({SQL['knn_graph']}) SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def merged_neighbours(spark, sf_dir):
    e = knn_graph(spark, sf_dir).select("src", "dst")
    return e.union(e.select("dst", "src")).distinct()


@query(WHOLE + "SELECT query_id AS shape_id, round(sum(1.0::DOUBLE - dist), 6) AS degree FROM d GROUP BY query_id")
def similarity_degree(spark, sf_dir):
    """Row sums of the similarity matrix of all shapes."""
    return clusters.degrees(shapes.sign_shapes(spark, sf_dir)).select("shape_id", F.round("degree", 6).alias("degree"))


@query("WITH p AS (SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), g AS (SELECT id, n, unnest(range(0, (2 ** n)::BIGINT)) AS mask FROM p) SELECT id AS shape_id, mask::BIGINT AS mask, bit_count(mask)::INT AS points FROM g")
def point_subsets(spark, sf_dir):
    """All subsets of every order's points."""
    p = shapes.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("shape_id")).agg(F.countDistinct("l_linenumber").cast("int").alias("n"))
    return p.select("shape_id", F.explode(F.expr("sequence(0L, shiftleft(1L, n) - 1L)")).alias("mask")).withColumn("points", F.bit_count("mask"))


OCTANTS = EMB + f""", pt AS (SELECT id AS q, min(v) AS v, (v // 8)::INT AS part FROM s WHERE id % {EVERY} = 0 GROUP BY id, v // 8),
w AS (SELECT q, v, (1::BIGINT << (row_number() OVER (PARTITION BY q ORDER BY part) - 1)::INT)::BIGINT AS b FROM pt),
own AS (SELECT q.id AS q, coalesce(sum(b), 0)::BIGINT AS own FROM q LEFT JOIN w ON w.q = q.id GROUP BY q.id),
held AS (SELECT own.q, own, ids.id, coalesce(h, 0) AS h FROM own CROSS JOIN ids LEFT JOIN (SELECT w.q, s.id, sum(b)::BIGINT AS h FROM w JOIN s USING (v) GROUP BY ALL) t ON t.q = own.q AND t.id = ids.id)
SELECT q AS query_id, mask::BIGINT AS mask, count(*) FILTER (WHERE (h & mask) = mask)::BIGINT AS hits FROM held, range(0, 256) r(mask) WHERE (own & mask) = mask GROUP BY ALL"""


@query(OCTANTS)
def subset_search(spark, sf_dir):
    """Shapes that hold each subset of a query's own points, the first voxel of each octant that it fills: counted by points held, then by subset."""
    w = shapes.sign_shapes(spark, sf_dir).select("shape_id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    by = w.groupBy("bits").agg(F.count("*").alias("m"))
    first = "filter(transform(sequence(0, 7), o -> array_min(filter(sequence(8 * o, 8 * o + 7), v -> (shiftright(bits, v) & 1L) = 1L))), v -> v is not null)"
    q = w.where(F.col("shape_id") % EVERY == 0).select(F.col("shape_id").alias("query_id"), F.expr(first).alias("points"))
    own = "aggregate(points, struct(0L as h, 0 as k), (t, v) -> struct(t.h | shiftleft(shiftright(bits, v) & 1L, t.k) as h, t.k + 1 as k), t -> t.h)"
    held = search.against(q, by).withColumn("h", F.expr(own))
    held = held.groupBy("query_id", F.size("points").alias("n"), "h").agg(F.sum("m").alias("m"))
    subsets = held.select("query_id", "m", "h", F.explode(F.expr("sequence(0L, shiftleft(1L, n) - 1L)")).alias("mask"))
    return subsets.groupBy("query_id", "mask").agg(F.coalesce(F.sum(F.when(F.expr("(h & mask) = mask"), F.col("m"))), F.lit(0).cast("long")).alias("hits"))
