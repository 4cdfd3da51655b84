import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import toxicity as T

S = T.Settings(sizes=(2, 3), bits=20, evidence=2.0, steps=4000)


def brute_grams(text, sizes=(2, 3)):
    raw = "".join(" " if c in " \t\n\r\v\f" else c for c in f" {text.lower()} ").encode()
    return {raw[i : i + k] for k in sizes for i in range(len(raw) - k + 1)}


def texts(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5)))
    return [" ".join([word() for _ in range(12)] + (["zzq"] if i % 3 == 0 and i % 5 else [])) for i in range(n)]


@pytest.mark.parametrize("window", [1 << 20, 7])
def test_features_are_the_distinct_ngrams(monkeypatch, window):
    """Whatever the windows a long text is read in."""
    monkeypatch.setattr(T, "WINDOW", window)
    made = [*texts(30), "", "a", "X\tY\nZ  z", "\U0001f600é" * 9]
    doc, bucket = T.present(made, S)
    for i, t in enumerate(made):
        assert (doc == i).sum() == len(brute_grams(t))
    wanted = np.zeros(1 << S.bits, bool)
    wanted[bucket[::3]] = True
    d, b = T.present(made, S, wanted)
    assert list(zip(d, b, strict=True)) == [(i, j) for i, j in zip(doc, bucket, strict=True) if wanted[j]]


def test_fit_solves_the_stated_problem():
    """Ratios, the choice of features and the optimum against plain sets of n-grams."""
    made = texts(120)
    y = np.array([i % 3 == 0 for i in range(120)], float)
    model = T.fit(made, y, S)
    grams = [brute_grams(t) for t in made]
    every = sorted(set().union(*grams))
    p = {g: sum(y[i] for i in range(120) if g in grams[i]) for g in every}
    n = {g: sum(g in x for x in grams) for g in every}
    r = {g: math.log((p[g] + 1) / (y.sum() + 2)) - math.log((n[g] - p[g] + 1) / (120 - y.sum() + 2)) for g in every}
    kept = [g for g in every if n[g] > 2 and abs(r[g]) * math.sqrt(n[g]) >= S.evidence]
    assert (model.weight != 0).sum() == len(kept) > 5
    x = np.array([[r[g] * (g in gs) for g in kept] for gs in grams])
    mass = np.where(y == 1, 0.5 / y.sum(), 0.5 / (120 - y.sum()))
    w, bias = np.zeros(len(kept)), 0.0
    for _ in range(60):  # Newton steps to the optimum
        z = 1 / (1 + np.exp(-(x @ w + bias)))
        full = np.hstack([x, np.ones((120, 1))])
        ridge = np.diag([S.ridge / len(kept)] * len(kept) + [0.0])
        gradient = full.T @ (mass * (z - y)) + ridge @ np.append(w, bias)
        step = np.linalg.solve(full.T @ (full * (mass * z * (1 - z))[:, None]) + ridge + 1e-12 * np.eye(len(ridge)), gradient)
        w, bias = w - step[:-1], bias - step[-1]
    assert np.abs(model.scores(made) - 1 / (1 + np.exp(-(x @ w + bias)))).max() < 0.05


def scored(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("score", F.lit(2)).withColumn("y", F.lit(0))
    return T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()


def test_held_out_rows_and_labels(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(30)] + (["xxzzq"] if i % 3 == 0 else []))) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    out = scored(spark, rows, labels)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    assert {r.doc_id: r.score for r in scored(spark, rows, flipped)} == {r.doc_id: r.score for r in out}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "text"), (5, "long " * 100_000)]
    assert sorted({(r.score, r.predicted) for r in scored(spark, rows, [])}) == [(0.5, 1)]  # nothing known; a tie counts as 1
    assert all(r.score < 0.05 and r.predicted == 0 for r in scored(spark, rows, [(1, 0), (3, 0), (7, 1), (5, None), (None, 1)]))
    assert all(r.score > 0.95 for r in scored(spark, rows, [(1, 1), (3, 1), (2, 7)]))
    two = scored(spark, rows, [(3, 1), (3, 0), (1, 0)])  # both labels of 3 count
    assert len(two) == 6 and len({r.score for r in two if r.doc_id == 3}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert T.toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


@pytest.mark.parametrize("repeated", [1, 3000])
def test_bound_of_rows(spark, repeated):
    """However often a doc_id or its labels occur, no more than the documented rows come to the driver."""
    docs = spark.range(60).union(spark.range(repeated).select(F.lit(7).cast("long"))).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)] + [(7, 0), (8, 1), (8, 1)], "doc_id long, toxic int")
    for bound in (5, 40):
        found, y = T.labelled_sample(docs, labels, F.lit(True), T.Settings(sample=bound))
        assert len(found) == len(y) and (y == 0).sum() <= bound and (y == 1).sum() <= bound and min((y == 0).sum(), (y == 1).sum()) > 0
        assert (found, list(y)) == (lambda a, b: (a, list(b)))(*T.labelled_sample(docs.repartition(3), labels, F.lit(True), T.Settings(sample=bound)))
    every, y = T.labelled_sample(docs, labels, F.lit(True), T.Settings(sample=100_000))
    assert len(every) == 63 + 2 * repeated
