import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import embedding_join as E


def brute(rows, cosine=0.93):
    """{row number: (links, least vec_id reachable, nulls aside)} by all pairs."""
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = collections.defaultdict(set)
    for i in ok:
        for j in ok:
            a, b = (np.array(rows[k][1], np.float32).astype(np.float64) for k in (i, j))
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and (a @ b) / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i].add(j)
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out[i] = (len(links[i]), min(ids, default=None))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(0).alias("cid"), F.lit(1).alias("h1"), F.lit("x").alias("n_links"))
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.similar_vectors(df).collect())
    want = collections.Counter((rows[i][0], n, c, None if rows[i][0] is None else rows[i][0] == c) for i, (n, c) in brute(rows).items())
    assert got == want
    assert E.similar_vectors(df.limit(0)).count() == 0


def test_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 5)
    monkeypatch.setattr(E, "PART", 20)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 8))
    vectors = [(base[rng.integers(12)] + rng.normal(scale=0.12, size=8)).astype(np.float32).tolist() for _ in range(200)] + [base[0].astype(np.float32).tolist()] * 3
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, vectors[0], None), (904, [None] * 8, 0), (905, vectors[0][:4], 0), (906, [float("inf")] + vectors[0][1:], 0), (907, [], 0)]
    rows += [(3, vectors[3], 0), (3, vectors[4], 1), (None, vectors[5], 2), (None, vectors[5], 2), (None, vectors[6], 0)]
    check(spark, rows)


def test_ties_at_the_bound(spark):
    """Cosines of exactly 0.96 and 0.28 in whole numbers (24-7-25 triangles), joined at bounds that equal them."""
    rows = [(1, [24.0, 7.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.similar_vectors(df, 0.96).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_many_copies_of_one_vector(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 < 2, F.array(F.lit(1.0), F.lit(0.5))).otherwise(F.array(F.cos("id"), F.sin("id"))).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    n = E.similar_vectors(df).where("component_id = 0 and n_links >= 1999").count()
    assert n >= 2000


def skipped(spectrum, n=20_000):
    rng = np.random.default_rng(0)
    u = E.unit(rng.normal(size=(n, 64)) * np.sqrt(spectrum))
    _, axes = np.linalg.eigh(np.cov(u.T))
    x = u @ axes[:, ::-1][:, : E.DIRECTIONS]
    reach = np.sqrt(2 - 2 * 0.93)
    x = x[np.lexsort(np.floor(x * E.FINE / reach).T[::-1])]
    blocks = [x[i : i + E.BLOCK] for i in range(0, n, E.BLOCK)]
    lo, hi = np.array([b.min(0) for b in blocks]), np.array([b.max(0) for b in blocks])
    k = len(blocks)
    return 1 - sum(1 for _ in E.near_blocks(lo, hi, (0, k), (0, k), reach)) / (k * (k + 1) / 2)


@pytest.mark.parametrize(("power", "share"), [(0.0, 0.015), (1.0, 0.55), (1.5, 0.68)])
def test_block_pairs_skipped(power, share):
    """The shares of the module's description."""
    assert share < skipped(np.arange(1, 65) ** -power) < share + 0.06
