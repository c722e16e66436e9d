"""Embedding near-duplicates: int8 tile products with error bounds, full precision only for pairs that may reach the threshold.

Vectors of a large label are dealt to cells around pivots. Two vectors of different cells that are near each other
both lie near the plane between the cells' pivots, so a vector visits only those other cells whose plane is within the
link distance: pairs of cells that cannot hold a link never meet. Cells are cut into tiles, which are compared pairwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import dimension_of, matrix, valid
from .common import connected_components, materialise, partitions

#: Different vectors of a tile at most (on average); rows of a tile compared at a time.
TILE, ROWS = 4096, 512
#: Pivots of a label, and of all labels together, at most; labels beyond are one cell each, cut into tiles.
PIVOTS, ALL_PIVOTS = 64, 20_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scales, the length of what is kept and of what is lost, for rows of length one."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    kept = q * scale[:, None]
    return q, scale, np.linalg.norm(kept, axis=1), np.linalg.norm(x - kept, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float):
    """Yields places (row of x, row of y) of all pairs of cosine >= threshold, in double precision, ROWS rows of x at a time.

    With x = a + e and y = b + f, a and b the quantised rows, |x.y - a.b| <= |a||f| + |e||y|. Products of int8 rows
    are summed in float32, which is exact below 2^24 (up to 1040 dimensions; longer rows are summed in double).
    """
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ax, ex = quantise(x / nx[:, None])
    qy, sy, _, ey = quantise(y / ny[:, None])
    qy = np.ascontiguousarray(qy.T.astype(kind))
    for begin in range(0, len(x), ROWS):
        part = slice(begin, begin + ROWS)
        bound = (qx[part].astype(kind) @ qy).astype(np.float64)
        bound *= sx[part, None]
        bound *= sy
        bound += ax[part, None] * ey
        bound += ex[part, None] * (1 + 1e-9) + 1e-9
        i, j = np.nonzero(bound >= threshold)
        i += begin
        exact = np.empty(len(i))
        for first in range(0, len(i), 1 << 16):
            own = slice(first, first + (1 << 16))
            exact[own] = (x[i[own]] * y[j[own]]).sum(1) / (nx[i[own]] * ny[j[own]])
        near = exact >= threshold
        yield i[near], j[near]


def pivots(classes: DataFrame, counts: DataFrame, apart: float, tile: int) -> dict:
    """Unit vectors of each large label that are more than `apart` from each other; ALL_PIVOTS at most, largest labels first."""
    large = [(r["label"], r["n"]) for r in counts.where(F.col("n") > tile).orderBy(F.desc("n"), "label").limit(ALL_PIVOTS // 2).collect()]
    want, left = {}, ALL_PIVOTS
    for label, n in large:
        own = min(PIVOTS, -(-n // tile), left)
        if own > 1:
            want[label], left = own, left - own
    if not want:
        return {}
    # A few more are read than wanted, as those near another one are left out.
    share = F.create_map(*[F.lit(v) for label, own in want.items() for v in (label, min(1.0, 4.0 * own / dict(large)[label]))])
    at = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = classes.where(F.col("label").isin(list(want))).where(at < share[F.col("label")]).select("label", "rep", "embedding").toPandas()
    found = {}
    for label, part in rows.sort_values("rep").groupby("label"):
        x = matrix(part["embedding"], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        chosen = x[:1]
        for v in x[1:]:
            if len(chosen) == want[label]:
                break
            if ((chosen - v) ** 2).sum(1).min() > apart * apart:
                chosen = np.vstack([chosen, v])
        if len(chosen) > 1:
            found[label] = chosen
    return found


def cells(x: np.ndarray, chosen: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each unit row, and which other cells it visits.

    Of two cells' rows one side visits the other, by turns, where its distance from the plane between them is at most `reach`.
    """
    dots = x @ chosen.T
    home = dots.argmax(1)
    between = np.sqrt(((chosen[:, None] - chosen[None]) ** 2).sum(-1))
    margin = (dots[np.arange(len(x)), home][:, None] - dots) / np.maximum(between[home], 1e-12)
    other = np.arange(len(chosen))
    turn = ((home[:, None] + other) % 2 == 0) == (home[:, None] < other)
    return home, (margin <= reach) & turn & (other != home[:, None])


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links join vectors of one label with cosine >= threshold.

    Equal vectors of a label are one class that is compared once. A tile pair reports, for each class, how many
    vectors it links and the smallest class it reaches there, so a large group of near copies costs a row a class,
    not a row a pair. Vectors that are null, zero, of another length than the commonest or with null or non-finite
    components, and rows with a null label or id, link with nothing: n_links 0, their own component, kept (a null
    id: component null, not kept). Rows that repeat an id count as vectors of their own. Other columns are not read.
    """
    d = dimension_of(vectors, "embedding")
    rows = vectors.select("vec_id", "label", "embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid("embedding", d)
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = rows.where(good)
    classes = materialise(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    chosen = pivots(classes, classes.groupBy("label").agg(F.count("*").alias("n")), 2 * reach, tile)

    def place(batches):
        for part in batches:
            home, visits = np.zeros(len(part), np.int64), np.empty(len(part), object)
            visits[:] = [[]] * len(part)
            label = part["label"].to_numpy()
            for own in set(label.tolist()) & set(chosen):
                rows = np.flatnonzero(label == own)
                x = matrix(part["embedding"].iloc[rows], np.float64)
                home[rows], seen = cells(x / np.linalg.norm(x, axis=1, keepdims=True), chosen[own], reach)
                for r, v in zip(rows, seen, strict=True):
                    visits[r] = np.flatnonzero(v)
            yield part.assign(home=home, visits=visits)

    kinds = ", ".join(f"{c} {classes.schema[c].dataType.simpleString()}" for c in classes.columns)
    placed = classes.mapInPandas(place, f"{kinds}, home int, visits array<int>") if chosen else classes.withColumns({"home": F.lit(0), "visits": F.array().cast("array<int>")})
    placed = materialise(placed)
    # Tiles of a cell's own rows and of its visitors; own tiles meet each other and every tile of visitors.
    own = placed.groupBy("label", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    seen = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("guests"))
    sizes = own.join(seen, ["label", "cell"], "left").select("label", "cell", "tiles", F.coalesce("guests", F.lit(0)).alias("guests"))
    slot = lambda n: F.pmod(F.xxhash64("rep", "label"), n).cast("int")
    every = lambda n: F.transform(F.sequence(F.lit(1), n), lambda k: k - 1)
    data = ["label", "cell", "rep", "copies", "embedding"]
    group = lambda kind, a, b, second: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), second.alias("second"))
    home = placed.withColumnRenamed("home", "cell").join(sizes, ["label", "cell"]).withColumn("at", slot(F.col("tiles")))
    meets = F.transform(every(F.col("tiles")), lambda k: group(0, F.least("at", k), F.greatest("at", k), F.col("at") > k))
    hosts = F.when(F.col("guests") > 0, F.transform(every(F.col("guests")), lambda k: group(1, F.col("at"), k, F.lit(False))))
    home = home.select(*data, F.explode(F.concat(meets, F.coalesce(hosts, F.slice(meets, 1, 0)))).alias("g"))
    guest = placed.select("label", "rep", "copies", "embedding", F.explode("visits").alias("cell")).join(sizes, ["label", "cell"]).withColumn("at", slot(F.col("guests")))
    guest = guest.select(*data, F.explode(F.transform(every(F.col("tiles")), lambda k: group(1, k, F.col("at"), F.lit(True)))).alias("g"))
    tiles = home.union(guest).select(*data, "g.*")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rep", "second"])
        x, copies, ids = matrix(part["embedding"], np.float64), part["copies"].to_numpy(), part["rep"].to_numpy()
        one = part["kind"].iat[0] == 0 and part["a"].iat[0] == part["b"].iat[0]
        second = part["second"].to_numpy()
        left = np.arange(len(part)) if one else np.flatnonzero(~second)
        right = left if one else np.flatnonzero(second)
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "low": []})
        links = np.zeros(len(part), np.int64)
        root = np.arange(len(part))
        for i, j in tile_links(x[left], x[right], threshold):
            i, j = left[i], right[j]
            i, j = i[i != j], j[i != j]
            np.add.at(links, i, copies[j])
            if not one:
                np.add.at(links, j, copies[i])
            # Links so far are one row a vector, so that a tile full of links does not pile them up.
            root = local_roots(len(part), np.concatenate([np.arange(len(part)), i]), np.concatenate([root, j]))
        some = links > 0
        return pd.DataFrame({"rep": ids[some], "links": links[some], "low": ids[root[some]]})

    keys = ["label", "cell", "kind", "a", "b"]
    tiles = tiles.repartition(partitions(tiles.sparkSession), *keys)
    found = materialise(tiles.groupBy(*keys).applyInPandas(compare, "rep long, links long, low long"))
    components = connected_components(found.select(F.col("rep").alias("src"), F.col("low").alias("dst")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(components.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.join(linked, "rep", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = rows.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
