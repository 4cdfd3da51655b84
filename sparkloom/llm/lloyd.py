"""Plain Lloyd clustering of integer vectors.

Components become integers once, and from there on every number is exact: distances, sums, and the floors of
their means. So the result does not depend on how rows are dealt to tasks or on the order of additions.

A round broadcasts the centroids (k times the length of the vectors, both parameters), gives every vector to the
nearest one in NumPy, and returns a row of sums for each centroid that a task has met, which one aggregation adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written

#: Rows whose differences to a centroid are in memory at once.
ROWS = 1024


def usable(embedding: Column, length: int) -> Column:
    """Whether a vector has exactly length components, none of them null or non-finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == length) & ~bad, F.lit(False))


def quantised(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs; values beyond a long raise, or are null where ANSI mode is off."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row of int64 vectors; the lowest number wins ties.

    32-bit integers serve where no distance can exceed them, and Python's own where 64 bits might not do;
    a least distance that is beyond a long raises OverflowError.
    """
    n, dim = vectors.shape
    low, high = (int(f(g(vectors), g(centroids))) for f, g in ((min, np.min), (max, np.max))) if n else (0, 0)
    most = (high - low) ** 2 * dim
    kind = np.int32 if most < 1 << 31 and -(1 << 31) <= low and high < 1 << 31 else np.int64 if most < 1 << 63 else object
    cs, number, least = centroids.astype(kind), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for at in range(0, n, ROWS):
        part = vectors[at : at + ROWS].astype(kind)
        distances = np.empty((len(part), len(cs)), kind)
        for k, c in enumerate(cs):
            gap = part - c
            distances[:, k] = (gap * gap).sum(axis=1, dtype=kind)
        number[at : at + ROWS] = np.argmin(distances, axis=1)
        least[at : at + ROWS] = distances.min(axis=1)
    return number, least


def _matrix(q: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(q.to_numpy()).reshape(-1, dim).astype(np.int64, copy=False)


def _sums(centroids, dim: int) -> Callable:
    """Rows (cluster, n, sums of components) of a task: at most one a centroid. Sums are decimals, so they can't overflow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cs, exact = centroids.value, 1 << 62
        counts, sums = np.zeros(len(cs), np.int64), [[0] * dim for _ in cs]
        for pdf in batches:
            if not len(pdf):
                continue
            vectors = _matrix(pdf["q"], dim)
            number, _ = nearest(vectors, cs)
            counts += np.bincount(number, minlength=len(cs))
            kind = np.int64 if int(np.abs(vectors.astype(np.float64)).max() + 1) * len(vectors) < exact else object
            for k in np.unique(number):
                added = vectors[number == k].astype(kind).sum(axis=0)
                sums[k] = [a + int(b) for a, b in zip(sums[k], added)]
        met = np.flatnonzero(counts)
        if not len(met):  # an empty column of arrays would be one of floats, which Arrow refuses
            return
        yield pd.DataFrame({"cluster": met.astype(np.int32), "n": counts[met], "sums": [[Decimal(s) for s in sums[k]] for k in met]})

    return run


def _assigned(centroids, dim: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                number, least = nearest(_matrix(pdf["q"], dim), centroids.value)
                yield pd.DataFrame({"id": pdf["id"], "no_id": pdf["no_id"], "cluster": number, "distance": least})

    return run


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and vec_id; null ids come last, equal ids go by their vectors."""
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    least = rows.orderBy("no_id", order, "q").limit(k)
    return np.array([r[0] for r in least.select("q").collect()], np.int64)


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, length: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """Clusters of the vectors (vec_id, embedding) after rounds of Lloyd's algorithm and one more assignment.

    Vectors with null or non-finite components, of another length, or null themselves take no part and have no row; repeated
    rows and repeated ids each count and have their own row, also rows without id, which start no cluster
    unless there are fewer than k others. Fewer than k vectors give as many clusters, none give no rows; empty
    clusters keep their centroid and ties go to the lowest number, so equal starting centroids leave all but one empty.
    Components that as integers don't fit a long, and distances or sums of them beyond one, raise. Other columns are ignored.

    Returns vec_id, cluster, distance (squared), cluster_inertia and inertia (sums of distances of the cluster and of all),
    cluster_size, centroid (array of its integers).
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding"), length))
    # pandas has no null integers: the id and whether there is none travel apart
    rows = written(kept.select(F.coalesce("vec_id", F.lit(0)).cast("long").alias("id"), F.col("vec_id").isNull().alias("no_id"), quantised(F.col("embedding"), scale).alias("q")), "integers")
    centroids = first_centroids(rows, k, seed)
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, cluster_size long, centroid array<long>"
    if not len(centroids):
        return spark.createDataFrame([], shape)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)
        parts = rows.select("q").mapInPandas(_sums(sent, length), "cluster int, n long, sums array<decimal(38,0)>")
        pieces = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
        means = centroids.copy()
        for r in pieces.groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # a row a component of a centroid
            means[r.cluster, r.at] = int(r.s) // r.n
        centroids = means
        sent.destroy()
    sent = spark.sparkContext.broadcast(centroids)
    assigned = written(rows.mapInPandas(_assigned(sent, length), "id long, no_id boolean, cluster int, distance long"), "assigned")
    sent.destroy()
    dropped(rows)
    inertias = {r.cluster: (int(r.inertia), r.n) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.count("*").alias("n")).collect()}  # a row a centroid
    whole = sum(i for i, _ in inertias.values())
    facts = spark.createDataFrame([(c, i, whole, n, centroids[c].tolist()) for c, (i, n) in sorted(inertias.items())], "cluster int, cluster_inertia long, inertia long, cluster_size long, centroid array<long>")
    named = assigned.select(F.when(~F.col("no_id"), F.col("id")).alias("vec_id"), "cluster", "distance")
    return named.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "cluster_size", "centroid")


def centroid_digest(centroid: np.ndarray | list[int]) -> str:
    """sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lloyd(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds written out one after the other; % 64 and // 64 tell components and vectors apart."""
    steps = ["""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, q FROM (SELECT * FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k}))"]
    near = "SELECT vec_id, v.q, unnest(min_by(struct_pack(cluster := cluster, distance := d), (d, cluster))) FROM (SELECT v.vec_id, v.q, c.cluster, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN {c} c) v GROUP BY vec_id, v.q"
    for i in range(rounds):
        steps.append(f"a{i} AS ({near.format(c=f'c{i}')})")
        steps.append(f"s{i} AS (SELECT cluster, k, sum(q[k]) AS s, count(*) AS n FROM a{i}, range(1, 65) r(k) GROUP BY cluster, k)")
        steps.append(f"m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS q FROM s{i} GROUP BY cluster)")
        steps.append(f"c{i + 1} AS (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    steps.append(f"last AS ({near.format(c=f'c{rounds}')})")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, l.cluster, distance, CAST(sum(distance) OVER (PARTITION BY l.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM last l JOIN c{rounds} c ON c.cluster = l.cluster"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_lloyd": op11_lloyd}
ORACLES: dict[str, str] = {"op11_lloyd": _sql()}
