"""Packing of near shapes into leaves: k-sample partitions in Spark, then a packer on each bounded partition.

A packer sees the distances of at most GROUP shapes and gives each a cluster of at most `size` members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octavox.functions.ordered import checkpointed
from octavox.operators import search

#: Shapes of a partition that a packer gets, of a leaf; centres of a partition and sampled shapes for each centre.
GROUP, LEAF, CENTRES, SAMPLES = 512, 16, 8, 5
#: Neighbours in the matching's graph; eigenvectors count as equal within this.
NEAREST, TOLERANCE = 8, 1e-5


def distances(words: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Relative volume distances of all rows of words (n, blocks); 0 of two empty shapes."""
    other = words if other is None else other
    shared = np.zeros((len(words), len(other)), np.int64)
    for k in range(words.shape[1]):
        shared += np.bitwise_count(words[:, None, k] & other[None, :, k])
    joint = np.bitwise_count(words).sum(1, dtype=np.int64)[:, None] + np.bitwise_count(other).sum(1, dtype=np.int64) - shared
    return np.where(joint == 0, 0.0, 1 - shared / np.maximum(joint, 1))


def _labels(clusters: list[list[int]], n: int) -> np.ndarray:
    """Cluster numbers in the order of the clusters' first members."""
    out = np.zeros(n, np.int64)
    for k, own in enumerate(sorted(clusters, key=min)):
        out[own] = k
    return out


def _linked(d: np.ndarray, clusters: list[list[int]]) -> np.ndarray:
    """Mean distances between clusters; a cluster is infinitely far from itself."""
    member = np.zeros((len(clusters), len(d)))
    for k, own in enumerate(clusters):
        member[k, own] = 1 / len(own)
    out = member @ d @ member.T
    np.fill_diagonal(out, np.inf)
    return out


def _disjoint(weights: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """Pairs taken from the nearest on, none sharing an end; ties by place."""
    i, j = np.nonzero(np.triu(allowed, 1))
    used, out = set(), []
    for e in np.argsort(weights[i, j], kind="stable"):
        if i[e] not in used and j[e] not in used:
            used.update((i[e], j[e]))
            out.append((int(i[e]), int(j[e])))
    return out


def _rounds(d: np.ndarray, size: int, choose) -> np.ndarray:
    clusters = [[k] for k in range(len(d))]
    while len(clusters) > 1:
        sizes = np.array([len(c) for c in clusters])
        allowed = sizes[:, None] + sizes <= size
        np.fill_diagonal(allowed, False)
        pairs = choose(_linked(d, clusters), allowed) if allowed.any() else []
        if not pairs:
            break
        gone = {k for p in pairs for k in p}
        clusters = [clusters[a] + clusters[b] for a, b in pairs] + [c for k, c in enumerate(clusters) if k not in gone]
    return _labels(_absorbed(d, clusters, size), len(d))


def _absorbed(d: np.ndarray, clusters: list[list[int]], size: int) -> list[list[int]]:
    """Left-over single shapes go to the nearest cluster that has room."""
    for own in [c for c in clusters if len(c) == 1]:
        room = [c for c in clusters if c is not own and len(c) < size]
        if room:
            best = min(room, key=lambda c: (d[own[0], c].mean(), min(c)))
            best.append(own[0])
            clusters = [c for c in clusters if c is not own]
    return clusters


def full_merge(d: np.ndarray, size: int) -> np.ndarray:
    """Rounds in which the nearest disjoint pairs of clusters merge."""
    return _rounds(d, size, _disjoint)


def greedy(d: np.ndarray, size: int) -> np.ndarray:
    """The nearest two clusters that fit together merge, one pair at a time, new clusters included."""
    n = len(d)
    clusters, near, sizes = {k: [k] for k in range(n)}, d.astype(float).copy(), np.ones(n)
    np.fill_diagonal(near, np.inf)
    while True:
        fit = np.where(sizes[:, None] + sizes <= size, near, np.inf)
        a, b = np.unravel_index(fit.argmin(), fit.shape)
        if not np.isfinite(fit[a, b]):
            return _labels(list(clusters.values()), n)
        a, b = min(a, b), max(a, b)
        mean = (near[a] * sizes[a] + near[b] * sizes[b]) / (sizes[a] + sizes[b])
        near[a], near[:, a], near[b], near[:, b] = mean, mean, np.inf, np.inf
        near[a, a] = np.inf
        clusters[a] += clusters.pop(b)
        sizes[a] += sizes[b]
        sizes[b] = np.inf


def _matched(weights: np.ndarray, allowed: np.ndarray, nearest: int) -> list[tuple[int, int]]:
    """A matching of small total distance in the graph of nearest neighbours: disjoint nearest pairs, then exchanges of two pairs' ends."""
    graph = allowed
    if nearest and len(weights) > nearest + 1:
        far = np.where(allowed, weights, np.inf)
        near = np.zeros_like(allowed)
        np.put_along_axis(near, np.argpartition(far, nearest, axis=1)[:, :nearest], True, 1)
        graph = allowed & (near | near.T)
    pairs = np.array(_disjoint(weights, graph), int).reshape(-1, 2)
    for _ in range(len(pairs)):
        if len(pairs) < 2:
            break
        a, b = pairs[:, 0], pairs[:, 1]
        now, cost = weights[a, b], np.where(graph, weights, np.inf)
        straight, crossed = cost[a[:, None], a] + cost[b[:, None], b], cost[a[:, None], b] + cost[b[:, None], a]
        gain = now[:, None] + now - np.minimum(straight, crossed)
        np.fill_diagonal(gain, -np.inf)
        p, q = np.unravel_index(gain.argmax(), gain.shape)
        if not gain[p, q] > 1e-12:
            break
        if straight[p, q] <= crossed[p, q]:
            pairs[p], pairs[q] = (a[p], a[q]), (b[p], b[q])
        else:
            pairs[p], pairs[q] = (a[p], b[q]), (b[p], a[q])
    return [(int(a), int(b)) for a, b in pairs]


def matching(d: np.ndarray, size: int, nearest: int = NEAREST) -> np.ndarray:
    """Rounds of matchings, each of which may double the clusters; `nearest` 0 takes the complete graph."""
    return _rounds(d, size, lambda w, ok: _matched(w, ok, nearest))


def _eigen(d: np.ndarray, normalised: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian similarities, as wide as a quarter of the mean distance of the log2(n)th neighbour, and the Laplacian's eigenvectors."""
    n = len(d)
    width = max(np.sort(d, axis=1)[:, min(n - 1, max(1, int(np.log2(n))))].mean() / 4, 1e-9)
    s = np.exp(-(d**2) / (2 * width * width))
    degree = s.sum(1)
    laplacian = np.diag(degree) - s
    if normalised:
        laplacian = laplacian / np.sqrt(degree[:, None] * degree)
    v = np.linalg.eigh(laplacian)[1]
    # A sign of its own for each vector, so that reruns agree.
    return s, v * np.where(v[np.abs(v).argmax(0), np.arange(n)] < 0, -1, 1)


def _in_order(v: np.ndarray) -> np.ndarray:
    """Rows in the order of the second vector, equal ones (within TOLERANCE) in that of the next."""
    keys = np.round(v[:, 1 : min(5, v.shape[1])] / TOLERANCE).astype(np.int64)
    return np.lexsort((np.arange(len(v)), *keys.T[::-1]))


def spectral_dense(d: np.ndarray, size: int, normalised: bool = True) -> np.ndarray:
    """Full leaves cut from the spectral order."""
    if len(d) <= size:
        return np.zeros(len(d), np.int64)
    order = _in_order(_eigen(d, normalised)[1])
    return _labels([order[k : k + size].tolist() for k in range(0, len(d), size)], len(d))


def spectral_gaps(d: np.ndarray, size: int, normalised: bool = True) -> np.ndarray:
    """The spectral order split at its largest gap, again and again, until all parts fit."""
    if len(d) <= size:
        return np.zeros(len(d), np.int64)
    v = _eigen(d, normalised)[1]
    order, parts, done = _in_order(v), [], []
    parts = [order]
    while parts:
        own = parts.pop()
        if len(own) <= size:
            done.append(own.tolist())
        else:
            at = int(np.diff(v[own, 1]).argmax()) + 1
            parts += [own[:at], own[at:]]
    return _labels(done, len(d))


def complete_linkage(d: np.ndarray, k: int, size: int | None = None) -> list[list[int]]:
    """Agglomeration to k clusters (or until none fit) by the least greatest distance; ties by place."""
    n = len(d)
    clusters, far, sizes = {i: [i] for i in range(n)}, d.astype(float).copy(), np.ones(n)
    np.fill_diagonal(far, np.inf)
    while len(clusters) > k:
        fit = far if size is None else np.where(sizes[:, None] + sizes <= size, far, np.inf)
        a, b = np.unravel_index(fit.argmin(), fit.shape)
        if not np.isfinite(fit[a, b]):
            break
        a, b = min(a, b), max(a, b)
        most = np.maximum(far[a], far[b])
        far[a], far[:, a], far[b], far[:, b] = most, most, np.inf, np.inf
        far[a, a] = np.inf
        clusters[a] += clusters.pop(b)
        sizes[a] += sizes[b]
        sizes[b] = np.inf
    return list(clusters.values())


def spectral_rows(d: np.ndarray, size: int, normalised: bool = True) -> np.ndarray:
    """The rows of the first eigenvectors, clustered by complete linkage."""
    n = len(d)
    if n <= size:
        return np.zeros(n, np.int64)
    rows = _eigen(d, normalised)[1][:, 1 : 1 + max(1, int(np.ceil(np.log2(n / size))))]
    apart = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    return _labels(_absorbed(d, complete_linkage(apart, -(-n // size), size), size), n)


def spectral_relaxed(d: np.ndarray, size: int, normalised: bool = True) -> np.ndarray:
    """Leaf by leaf: the shapes that weigh most in the leading eigenvector of what is left, the relaxed densest group."""
    s, left, out = _eigen(d, normalised)[0] if len(d) > size else np.zeros((0, 0)), np.arange(len(d)), []
    while len(left) > size:
        weight = np.abs(np.linalg.eigh(s[np.ix_(left, left)])[1][:, -1])
        take = np.sort(np.lexsort((left, -np.round(weight, 9)))[:size])
        out.append(left[take].tolist())
        left = np.delete(left, take)
    return _labels([*out, left.tolist()] if len(left) else out, len(d))


PACKERS = {"full_merge": full_merge, "greedy": greedy, "matching": matching, "spectral_dense": spectral_dense, "spectral_gaps": spectral_gaps, "spectral_rows": spectral_rows, "spectral_relaxed": spectral_relaxed}


def dense(maps) -> np.ndarray:
    """Words (n, blocks) of packed shapes (maps of block to bits); blocks that none has are left out."""
    maps = [dict(m) for m in maps]
    blocks = sorted({b for m in maps for b in m}) or [0]
    return np.array([[m.get(b, 0) for b in blocks] for m in maps], np.int64).reshape(len(maps), -1).view(np.uint64)


def medoids(d: np.ndarray, k: int, by_radius: bool = False) -> list[int]:
    """One member for each of k complete-linkage clusters: the least mean (or greatest) distance to its cluster; ties by place."""
    rate = (lambda c: d[np.ix_(c, c)].max(1)) if by_radius else (lambda c: d[np.ix_(c, c)].mean(1))
    return [c[int(rate(c).argmin())] for c in (sorted(c) for c in complete_linkage(d, k))]


def partition(shapes: DataFrame, limit: int = GROUP, centres: int = CENTRES, samples: int = SAMPLES) -> DataFrame:
    """`shapes` (packed: shape_id, words, volume) with `part`: partitions of near shapes, of at most `limit` each.

    A partition too large is sampled by hash, the sample is clustered, and the clusters' medoids draw the partition's
    shapes to themselves; fewer centres where fewer would do. Where a round doesn't divide a partition (equal shapes),
    its shapes are dealt out by hash. Samples are bounded, and the centres of a partition few.
    """
    placed = checkpointed(shapes.withColumn("part", F.lit("")))
    while True:
        sizes = checkpointed(placed.groupBy("part").agg(F.count("*").alias("n")))
        large = sizes.where(F.col("n") > limit)
        if large.isEmpty():
            return placed
        big = placed.join(large, "part")
        share = F.pmod(F.xxhash64("shape_id", "part"), F.lit(1 << 30)) / float(1 << 30)
        first = Window.partitionBy("part").orderBy(F.xxhash64("shape_id", "part"), "shape_id")
        sample = big.where(share < 4.0 * centres * samples / F.col("n")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= centres * samples)

        def choose(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("shape_id", ignore_index=True)
            d = distances(dense(part["words"]))
            k = max(2, min(centres, -(-int(part["n"].iat[0]) // limit) + 1))
            own = medoids(d, k) if d.max() > 0 else []
            return pd.DataFrame({"part": part["part"].iat[0], "centre": range(len(own)), "shape_id": part["shape_id"].iloc[own]})

        sample = checkpointed(sample.select("part", "n", "shape_id", "words", "volume"))
        chosen = sample.groupBy("part").applyInPandas(choose, "part string, centre int, shape_id long")
        words = sample.select("part", "shape_id", F.col("words").alias("cwords"), F.col("volume").alias("cvolume"))
        chosen = checkpointed(chosen.join(words, ["part", "shape_id"]).drop("shape_id"))
        own = search.tanimoto(search.common("cwords", "words"), F.col("cvolume"), F.col("volume"))
        columns = [*shapes.columns]
        near = big.join(chosen, "part").select("part", "n", *columns, F.struct(own.alias("d"), "centre").alias("c")).groupBy("part", "n", "shape_id").agg(F.min("c").alias("c"), *[F.first(x).alias(x) for x in columns if x != "shape_id"])
        # A partition that one centre keeps whole, or that has no centres, is dealt out by hash.
        spread = near.groupBy("part").agg(F.countDistinct("c.centre").alias("kinds"))
        split = near.join(spread.where("kinds > 1"), "part").select(*columns, F.concat_ws(".", "part", F.col("c.centre").cast("string")).alias("part"))
        stuck = big.join(spread.where("kinds > 1"), "part", "left_anti").select(*columns, F.concat(F.col("part"), F.lit("#"), F.pmod(F.xxhash64("shape_id"), F.ceil(F.col("n") * 1.25 / limit) + 1).cast("string")).alias("part"))
        rest = placed.join(large, "part", "left_anti").select(*columns, "part")
        placed = checkpointed(rest.unionByName(split).unionByName(stuck))


def pack(placed: DataFrame, packer: str, size: int = LEAF) -> DataFrame:
    """shape_id, part, leaf: the packer's clusters of every partition of `partition`."""
    own = PACKERS[packer]

    def clusters(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shape_id", ignore_index=True)
        return pd.DataFrame({"shape_id": part["shape_id"], "part": part["part"], "leaf": own(distances(dense(part["words"])), size)})

    return placed.groupBy("part").applyInPandas(clusters, "shape_id long, part string, leaf int")
