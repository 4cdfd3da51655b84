"""Lloyd's rounds against plain Python."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lloyd as L

SHAPE = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, length, scale=256, seed="2:"):
    """(vec_id, vector) rows to (vec_id, cluster, distance, cluster_inertia, inertia, cluster_size, centroid)."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    squares = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((squares(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of) if c == i]
            if mine:
                centroids[i] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(vec_id, *near(v)) for vec_id, v in kept]
    whole = sum(d for _, d, _ in found)
    return [(i, c, d, sum(e for _, e, b in found if b == c), whole, sum(b == c for *_, b in found), tuple(centroids[c])) for i, d, c in found]


def got(df, **how):
    return sorted([tuple(r[:6]) + (tuple(r[6]),) for r in L.lloyd(df, **how).collect()], key=str)


@pytest.mark.parametrize("k, rounds, scale", [(1, 2, 256), (4, 0, 256), (7, 5, 16), (9, 3, 1 << 22)])
def test_against_plain_python(spark, k, rounds, scale):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(i % 5, 0.3) * rng.choice((-1, 1)) for _ in range(6)], "x") for i in range(150)]
    rows += [(150, [None] + [0.0] * 5, "x"), (151, [math.nan] + [0.0] * 5, "x"), (152, [math.inf] * 6, "x"), (153, [1.0] * 5, "x"), (154, None, None), (155, [], "x")]
    rows += [(None, [0.25] * 6, "x"), (3, [9.0] * 6, "x"), (3, [9.0] * 6, "y"), *rows[:5]]
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert got(df, k=k, rounds=rounds, length=6, scale=scale) == sorted(brute([r[:2] for r in rows], k, rounds, 6, scale), key=str)


def test_ties_few_vectors_and_none(spark):
    same = spark.createDataFrame([(i, [1.0, -0.5], None) for i in range(6)], SHAPE)
    assert {r[1] for r in got(same, k=3, length=2)} == {0}
    three = [(1, [1.0, -0.5]), (2, [1.0, -0.5]), (9, [5.0, 5.0])]
    assert got(spark.createDataFrame([(*r, None) for r in three], SHAPE), k=40, length=2) == sorted(brute(three, 40, 5, 2), key=str)
    assert got(spark.createDataFrame([(1, [0.5, 0.5], None)], SHAPE), length=2) == [(1, 0, 0, 0, 0, 1, (128, 128))]
    assert got(same.limit(0), length=2) == [] and got(same.withColumn("embedding", F.lit(None).cast("array<double>")), length=2) == []
    assert L.lloyd(same.limit(0), length=2).columns == L.lloyd(same, length=2).columns


def test_kinds_of_integers_agree():
    rng = np.random.default_rng(3)
    for size in (50, 1 << 20, 1 << 40):
        v, c = rng.integers(-size, size, (3000, 5)), rng.integers(-size, size, (7, 5))
        c[3] = c[1]
        number, least = L.nearest(v, c) if size < 1 << 40 else (None, None)
        exact = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)), i) for i, b in enumerate(c)) for a in v[:200]]
        if number is None:
            with pytest.raises(OverflowError):
                L.nearest(v, c)
        else:
            assert [(int(d), int(n)) for d, n in zip(least[:200], number[:200])] == exact
    far = np.full((3, 2), (1 << 61) + 5)
    assert L.nearest(far, far[:1] - 3)[1].tolist() == [18] * 3


def test_a_task_without_vectors_has_no_row():
    class Sent:
        value = np.array([[1, 2], [5, 5]])

    assert list(L._sums(Sent, 2)(iter([]))) == []
    made = list(L._sums(Sent, 2)(iter([pd.DataFrame({"q": []}), pd.DataFrame({"q": [np.array([4, 5])]})])))
    assert [p.to_dict("list") for p in made] == [{"cluster": [1], "n": [1], "sums": [[4, 5]]}]
