"""Similarity of vectors and k nearest neighbours, exact, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = {"cosine": "cosine", "coseno": "cosine", "dot": "dot", "inner_product": "dot", "euclidean": "euclidean", "l2": "euclidean"}


def constant(vector) -> Column:
    return F.lit([float(x) for x in vector]) if len(vector) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Higher is more similar; the cosine with a zero vector is 0, of others within [-1, 1]."""
    name = METRICS.get(metric.lower())
    if name is None:
        raise ValueError(f"unknown metric {metric!r}")
    if name == "dot":
        return dot(a, b)
    if name == "euclidean":
        steps = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
        return 1 / (1 + F.sqrt(F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)))
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = dot(a, b) / size
    return F.when(size == 0, F.lit(0.0)).when(value > 1, F.lit(1.0)).when(value < -1, F.lit(-1.0)).otherwise(value)  # null stays null


def knn(df: DataFrame, column: str, query, k: int, key: str, metric: str = "cosine", score: str = "score") -> DataFrame:
    """The k most similar rows, ties by ``key``; null vectors are left out. One top-k, no full sort."""
    q = query if isinstance(query, Column) else constant(query)
    return df.filter(F.col(column).isNotNull()).withColumn(score, similarity(F.col(column), q, metric)).orderBy(F.desc(score), key).limit(k)


def knn_batch(df: DataFrame, column: str, key: str, queries: list[tuple[int, list[float]]], k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, key, score, rank): neighbours of a stated list of queries.

    Each row is scored against the list. Rows are ranked in 64 parts of a query first, and Spark
    limits the rank before it shuffles, so that no task gets all rows of a query.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("query_id"), constant(v).alias("q")) for i, v in queries])
    scored = df.filter(F.col(column).isNotNull()).select(F.col(key), F.col(column), F.explode(listed).alias("x")).select(F.col("x.query_id").alias("query_id"), key, similarity(F.col(column), F.col("x.q"), metric).alias("score"))
    # Spread by key first, so that no task ranks all rows of a query.
    parts = Window.partitionBy("query_id", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(F.desc("score"), key)
    best = scored.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= k)
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def mean_vector(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Normalised mean of the vectors of each group (zero stays zero)."""
    parts = df.select(*by, F.posexplode(F.col(column).cast("array<double>")).alias("i", "v")).groupBy(*by, "i").agg(F.avg("v").alias("v"))
    whole = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return whole.withColumn("mean", F.when(norm == 0, F.col("mean")).otherwise(F.transform("mean", lambda x: x / norm)))


def ivf_assign(df: DataFrame, column: str, centroids: list[list[float]]) -> DataFrame:
    """Adds list_id, the nearest of a bounded number of centroids."""
    scores = F.array(*[F.struct((-similarity(F.col(column), constant(c), "euclidean")).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])
    return df.withColumn("list_id", F.array_min(scores)["i"])


def kmeans(df: DataFrame, column: str, k: int, seed: int = 1234, rounds: int = 10, sample: int = 20_000) -> list[list[float]]:
    """Centroids from a bounded sample, by Lloyd's rounds."""
    import numpy as np

    n = df.count()
    rows = df.filter(F.pmod(F.xxhash64(F.col(column)), F.lit(max(1, n // sample))) == 0).select(column).limit(2 * sample).collect()
    x = np.array([r[0] for r in rows], float)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        nearest = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(axis=1)
        centres = np.array([x[nearest == i].mean(axis=0) if (nearest == i).any() else centres[i] for i in range(len(centres))])
    return centres.tolist()


def list_count(rows: int) -> int:
    """Lists for ``rows`` vectors: their square root, with 39 vectors or more a list."""
    return max(1, min(round(rows**0.5), rows // 39))


def probe_count(lists: int) -> int:
    """Lists that a search looks into first: the square root of their number."""
    return max(1, round(lists**0.5))


def ivf_knn(indexed: DataFrame, column: str, query: list[float], k: int, key: str, centroids: list[list[float]], probes: int, metric: str = "cosine") -> DataFrame:
    """k nearest among the lists nearest to the query; list_id prunes the rest at the scan. While these
    hold fewer than k vectors the probes are doubled, up to an exact search of all rows."""
    near = sorted(range(len(centroids)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centroids[i], query)))
    while probes < len(near):
        probed = indexed.filter(F.col("list_id").isin(near[:probes]))
        if probed.filter(F.col(column).isNotNull()).limit(k).count() == k:
            return knn(probed, column, query, k, key, metric)
        probes = max(1, 2 * probes)
    return knn(indexed, column, query, k, key, metric)


def unit(a: Column) -> Column:
    """The vector at length 1 (zero stays zero)."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm == 0, a.cast("array<double>")).otherwise(F.transform(a.cast("array<double>"), lambda x: x / norm))


def neighbour_ranks(df: DataFrame, column: str, key: str, centroids: list[list[float]], every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, key, score, list_rank): the exact k neighbours, by dot product, of each row whose
    key ``every`` divides, itself left out; list_rank is the place of the neighbour's list among those
    nearest to the query. A search of p lists finds just the neighbours with list_rank < p.

    Blocks of rows are scored against blocks of queries; a task keeps k rows of each query.
    """
    import numpy as np
    import pyarrow as pa

    df = df.filter(F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias(column))
    asked = df.filter(F.col(key) % every == 0).orderBy(key).collect()
    ids, q, c = np.array([r[0] for r in asked], np.int64), np.array([r[1] for r in asked], float), np.array(centroids, float)

    def away(x):
        return (c**2).sum(1) - 2 * x @ c.T

    def run(batches):
        best = {}
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(keys), -1)
            home = away(x).argmin(axis=1)
            for at in range(0, len(ids), 256):
                mine = slice(at, at + 256)
                scores = q[mine] @ x.T
                scores[ids[mine][:, None] == keys[None]] = -np.inf
                for j, row in enumerate(scores, at):
                    edge = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                    take = np.flatnonzero((row >= edge) & (row > -np.inf))
                    best[j] = sorted(best.get(j, []) + [(-row[t], keys[t], home[t]) for t in take])[:k]
        for j, found in best.items():
            if found:
                place = away(q[j]).argsort(kind="stable").argsort()
                yield pa.RecordBatch.from_arrays([pa.array([ids[j]] * len(found), pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([-f[0] for f in found], pa.float64()), pa.array([int(place[f[2]]) for f in found], pa.int32())], names=["query_id", key, "score", "list_rank"])

    near = df.mapInArrow(run, f"query_id long, `{key}` long, score double, list_rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
