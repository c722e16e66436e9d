"""Approximate nearest neighbours by inner product: anisotropic four-bit product codes, table scans, exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, ragged

#: Dimensions of a subspace, centroids of one (four bits), rows the codebooks are fitted on at most.
SUBSPACE, CENTROIDS, FIT_ROWS = 2, 16, 10_000
#: Weight of the residual along the vector against the residual across it.
PARALLEL_WEIGHT = 4.0
#: Tasks at least, vectors of a block and of a query block at most; per block and query, candidates that set the
#: threshold; queries of a block that are scanned at a time. A block's threshold comes from its own rows: few, large
#: blocks, and more query blocks where tasks are wanted.
TASKS, BLOCK_ROWS, QUERY_ROWS, RERANK, TURN = 24, 32_768, 16_384, 48, 128
#: Cosine of a query and a code from which on a residual is bounded strictly; below, the standard deviations that it is
#: given, as it then has no favoured direction among those across the code.
ALIKE, SPREAD = 0.6, 4.5


def valid(embedding: str, dimension: int):
    """True for a vector of this dimension without null or non-finite components that isn't zero."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(e) == dimension) & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def dimension_of(vectors: DataFrame, embedding: str) -> int:
    """The commonest length of a vector (the smaller of equals), 0 if there is none."""
    top = vectors.where(F.size(embedding) > 0).groupBy(F.size(embedding).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return top["n"] if top else 0


def matrix(column: pd.Series, dtype=np.float32) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def assign(x: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes of the rows: subspace by subspace, the centroid of least anisotropic loss given the others' choice.

    The loss is |r|^2 + (weight - 1) (r.u)^2 for the residual r and the row's direction u.
    """
    n, m = len(x), len(books)
    parts = x.reshape(n, m, -1)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, m, -1)
    codes = np.stack([((parts[:, s, None] - books[s]) ** 2).sum(2).argmin(1) for s in range(m)], 1)
    along = np.stack([((parts[:, s] - books[s][codes[:, s]]) * unit[:, s]).sum(1) for s in range(m)], 1)
    total = along.sum(1)
    for _ in range(sweeps):
        for s in range(m):
            rest = total - along[:, s]
            r = parts[:, s, None] - books[s]
            a = (r * unit[:, s, None]).sum(2)
            best = ((r**2).sum(2) + (weight - 1) * (rest[:, None] + a) ** 2).argmin(1)
            codes[:, s], along[:, s] = best, a[np.arange(n), best]
            total = rest + along[:, s]
    return codes.astype(np.uint8)


def fit(sample: np.ndarray, weight: float = PARALLEL_WEIGHT, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Codebooks (subspace, centroid, dimension) that lessen the anisotropic loss of the sample."""
    n, d = sample.shape
    m = -(-d // SUBSPACE)
    x = np.pad(sample, ((0, 0), (0, m * SUBSPACE - d))).astype(np.float64)
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, m, SUBSPACE)
    books = np.stack([parts[rng.integers(0, n, CENTROIDS), s] + rng.normal(0, 1e-6, (CENTROIDS, SUBSPACE)) for s in range(m)])
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, m, SUBSPACE)
    for _ in range(rounds):
        codes = assign(x, books, weight, 1)
        residual = parts - np.stack([books[s][codes[:, s]] for s in range(m)], 1)
        along = (residual * unit).sum(2)
        total = along.sum(1)
        for s in range(m):
            u, c = unit[:, s], codes[:, s]
            rest = total - along[:, s]
            aim = parts[:, s] + (weight - 1) * (rest + (parts[:, s] * u).sum(1))[:, None] * u
            outer = np.eye(SUBSPACE) + (weight - 1) * u[:, :, None] * u[:, None, :]
            for j in range(CENTROIDS):
                if (own := c == j).any():
                    books[s, j] = np.linalg.solve(outer[own].sum(0), aim[own].sum(0))
            along[:, s] = ((parts[:, s] - books[s][c]) * u).sum(1)
            total = rest + along[:, s]
    return books


def scan(codes: np.ndarray, queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate inner products (query, row): sums of table entries, the codes of two subspaces looked up at a time."""
    m = len(books)
    q = np.pad(queries, ((0, 0), (0, m * SUBSPACE - queries.shape[1]))).reshape(len(queries), m, SUBSPACE)
    tables = np.einsum("qmd,mkd->qmk", q, books).astype(np.float32)
    if m % 2:
        tables, codes = np.pad(tables, ((0, 0), (0, 1), (0, 0))), np.pad(codes, ((0, 0), (0, 1)))
    pairs = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(q), -1, CENTROIDS * CENTROIDS)
    both = np.ascontiguousarray((codes[:, 0::2].astype(np.int64) * CENTROIDS + codes[:, 1::2]).T)
    out = np.zeros((len(q), len(codes)), np.float32)
    for k, table in enumerate(pairs):
        row = out[k]
        for s in range(len(both)):
            row += table[s].take(both[s])
    return out


def residuals(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: the factor that best scales its code to the row, the length of what is left then, the code's length."""
    coded = books[np.arange(len(books)), codes].reshape(len(x), -1)
    square = (coded**2).sum(1)
    scale = np.divide((x * coded).sum(1), square, out=np.zeros(len(x)), where=square > 0)
    return scale, np.sqrt(((x - scale[:, None] * coded) ** 2).sum(1)), np.sqrt(square)


def upper(rough: np.ndarray, scale: np.ndarray, left: np.ndarray, size: np.ndarray, norm: float, dimension: int) -> np.ndarray:
    """What the exact products with a query of length `norm` may come to: what the code leaves lies across it, so only
    the query's part across it counts.

    Where query and code are alike (near copies of each other, above all) the residual may lie along the query: no
    exact product exceeds the bound there. Elsewhere it is given SPREAD standard deviations of a random direction.
    """
    slip = 1e-5 * norm * size  # more than the rounding of the scan's single-precision sums
    along = np.divide(np.maximum(np.abs(rough) - slip, 0), size, out=np.zeros(len(size)), where=size > 0)
    across = left * np.sqrt(np.maximum(norm * norm - along * along, 0)) * (1 + 1e-9)
    across[along < ALIKE * norm] *= min(1.0, SPREAD / max(1, dimension - 1) ** 0.5)
    most = scale * rough + np.abs(scale) * slip + across
    return np.where(np.isfinite(most), most + 1e-9 * norm * (left + size), np.inf)


def rerank(block: pd.DataFrame, rows: np.ndarray, rough: np.ndarray, query_ids: np.ndarray, keys: np.ndarray, queries: np.ndarray, top: int, depth: int) -> pd.DataFrame:
    """For each query its `top` rows of this block by exact product, ties to smaller ids; `block` has one row a vector with its sorted ids.

    The `depth` vectors of largest allowance set a threshold; every vector whose allowance reaches it is multiplied
    exactly. The query's own row is taken out once. `tried` of a query's first row is the number of exact products.
    """
    scale, left, size = (block[c].to_numpy(np.float64) for c in ("scale", "remains", "size"))
    lengths, flat = block["ids"].map(len).to_numpy(np.int64), np.concatenate(block["ids"].to_numpy())
    starts = np.cumsum(lengths) - lengths
    longest = np.sqrt((rows**2).sum(1).max())
    found: list[tuple] = []
    for k, q in enumerate(queries):
        norm = float(np.sqrt((q * q).sum()))
        most, slack = upper(rough[k].astype(np.float64), scale, left, size, norm, rows.shape[1]), 1e-12 * norm * longest
        # Of the vectors that begin, one may be the query's own, so one more is asked for.
        want = min(top + 1, len(most))
        first = np.argpartition(most, len(most) - depth)[len(most) - depth :] if len(most) > depth > want else np.arange(len(most))
        near = first
        if len(first) < len(most):
            least = np.partition(rows[first] @ q, len(first) - want)[len(first) - want] - slack
            near = np.flatnonzero(most >= least)
        score = rows[near] @ q
        tried = len(np.union1d(first, near))
        if len(near) > want:
            near = near[score >= np.partition(score, len(near) - want)[len(near) - want] - slack]
        exact = np.repeat([float(np.dot(q, v)) for v in rows[near]], lengths[near])
        ids = flat[ragged(starts[near], lengths[near])]
        own = np.flatnonzero((ids == query_ids[k]) & np.repeat((rows[near] == q).all(1), lengths[near]))
        exact, ids = np.delete(exact, own[:1]), np.delete(ids, own[:1])
        best = np.lexsort((ids, -exact))[:top]
        n_tried = np.zeros(len(best), np.int64)
        n_tried[:1] = tried
        found.append((np.full(len(best), query_ids[k]), np.full(len(best), keys[k]), ids[best], exact[best], n_tried))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0), np.zeros(0, np.int64)]
    return pd.DataFrame(dict(zip(("query_id", "query_key", "vec_id", "score", "tried"), columns, strict=True)))


def nearest(vectors: DataFrame, is_query, top: int = 20, depth: int = RERANK, tasks: int = TASKS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, query_key, n_exact: each query's `top` rows of largest inner product, ties to smaller ids.

    `vectors` has vec_id (long) and embedding (array of float); `is_query` is a boolean column that marks the
    queries. Every different vector is coded once; the codebooks are fitted on FIT_ROWS rows at most. Codes are
    scanned block by block, and all vectors of a block are multiplied exactly whose scanned product plus the allowance
    for their residual (see `upper`) reaches the last exact product needed of the `depth` best-scanned; there is no cap on
    their number, which n_exact gives for the query over all blocks. Of the copies of a vector the smallest top + 1 ids take
    part. Vectors that are null, zero, of another length than the commonest or with null or non-finite components take no
    part, nor do rows without an id; an empty table gives no rows. Rows that repeat an id are candidates and queries of
    their own: a query leaves out its own row only, and lists of one query_id differ in query_key, a hash of the vector; rows
    that repeat an id and a vector ask once, each seeing the others. Other columns are not read.
    """
    columns = "query_id long, rank int, vec_id long, score double, query_key long, n_exact long"
    d = dimension_of(vectors, "embedding")
    rows = vectors.where(F.col("vec_id").isNotNull() & valid("embedding", d)).select("vec_id", "embedding", is_query.alias("asks"))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    if not n or not asked:
        return vectors.sparkSession.createDataFrame([], columns)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < F.lit(min(1.0, FIT_ROWS / n) * (1 << 20))).orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "embedding").limit(FIT_ROWS).toPandas()
    if sample.empty:
        sample = rows.select("vec_id", "embedding").limit(FIT_ROWS).toPandas()
    books = fit(matrix(sample["embedding"], np.float64))
    width = len(books) * SUBSPACE

    def code(batches):
        for part in batches:
            if len(part):
                x = np.pad(matrix(part["embedding"], np.float64), ((0, 0), (0, width - d)))
                codes = assign(x, books, PARALLEL_WEIGHT)
                part["codes"] = [c.tobytes() for c in np.packbits(np.unpackbits(codes[:, :, None], axis=2)[:, :, 4:].reshape(len(x), -1), axis=1)]
                part["scale"], part["remains"], part["size"] = residuals(x, codes, books)
                yield part

    block_count = -(-n // BLOCK_ROWS)
    query_blocks = max(-(-asked // QUERY_ROWS), -(-tasks // block_count))
    place = F.pmod(F.xxhash64("embedding", F.lit(1)), F.lit(block_count)).cast("int")
    turn = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")
    # Window limits are applied before the shuffle, so that a vector of very many copies brings few ids from each task.
    copies = rows.groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(top)).cast("int").alias("n"))
    copies = copies.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "n"))), lambda s: F.array_repeat(s["vec_id"], s["n"])))
    different = copies.groupBy("embedding").agg(ids.alias("ids"))
    coded = different.mapInPandas(code, "embedding array<float>, ids array<long>, codes binary, scale double, remains double, size double")
    coded = coded.withColumn("block", place).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.where("asks").select("vec_id", "embedding").distinct()
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.xxhash64("embedding").alias("query_key"), turn.alias("turn")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(block_count - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": [], "tried": []})
        packed = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
        codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(left), -1)[:, : len(books)]
        x, found = matrix(left["embedding"], np.float64), []
        for begin in range(0, len(right), TURN):
            part = right.iloc[begin : begin + TURN]
            q = matrix(part["query"], np.float64)
            found.append(rerank(left, x, scan(codes, q, books), part["query_id"].to_numpy(), part["query_key"].to_numpy(), q, top, depth))
        return pd.concat(found)

    parts = partitions(vectors.sparkSession)
    coded, queries = coded.repartition(parts, "turn", "block"), queries.repartition(parts, "turn", "block")
    found = coded.groupBy("turn", "block").cogroup(queries.groupBy("turn", "block")).applyInPandas(search, "query_id long, query_key long, vec_id long, score double, tried long")
    each = Window.partitionBy("query_id", "query_key")
    found = found.withColumns({"rank": F.row_number().over(each.orderBy(F.desc("score"), "vec_id")), "n_exact": F.sum("tried").over(each)})
    return found.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score", "query_key", "n_exact")
