"""n-gram counts, batches by length, resampled error rates and alignments against plain Python."""

import hashlib
import random
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import batches as B
from sparkloom.operators import metrics as M
from sparkloom.operators import ngrams as G


def lines(n, seed=1):
    rng = random.Random(seed)
    return [None, "", " \n", "one", "Ünï  códe　space x\xa0y", *(rng.choice((" ", "\n")).join(rng.choice("abcde") for _ in range(rng.randint(0, 12))) for _ in range(n))]


@pytest.mark.parametrize("marks", [False, True])
@pytest.mark.parametrize("batch", [1 << 23, 40])
def test_ngram_counts(spark, monkeypatch, marks, batch):
    monkeypatch.setattr(G, "BATCH", batch)
    made = lines(200)
    want = Counter()
    for line in made:
        ws = (line or "").split()
        ws = ["<s>", *ws, "</s>"] if ws and marks else ws
        want.update((n, " ".join(ws[i : i + n])) for n in (1, 2, 3, 4, 5) for i in range(len(ws) - n + 1))
    local = Counter()
    for part in G._runs([t for t in made if t]):
        for frame in G.count_lines(part, (1, 2, 3, 4, 5), marks):
            local.update(dict(zip(zip(frame["n"].tolist(), frame["gram"]), frame["count"].tolist())))
    assert local == want
    df = spark.createDataFrame([(t,) for t in made], "text string").repartition(3)
    for orders in ([1, 2, 3, 4, 5], [3], [2, 5]):
        got = {(r.n, r.gram): r["count"] for r in G.ngram_counts(df, orders=orders, marks=marks).collect()}
        assert got == {k: v for k, v in want.items() if k[0] in orders}
    assert G.ngram_counts(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        G.ngram_counts(df, orders=[0, 1])


def test_length_batches(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice((None, rng.randint(0, 500)))) for i in range(997)]
    df = spark.createDataFrame(rows, "i long, n long").repartition(5)
    got = B.length_batches(df, "i", "n", 10, 3, mega=4).collect()
    order = sorted(rows, key=lambda r: (hashlib.md5(f"3:{r[0]}".encode()).hexdigest(), r[0]))
    want = []
    for at in range(0, len(order), 40):
        run = sorted(order[at : at + 40], key=lambda r: -(r[1] or 0))
        want += [(i, n or 0, at // 40 * 4 + k // 10, k % 10) for k, (i, n) in enumerate(run)]
    assert sorted(map(tuple, got)) == sorted(want)
    waste = lambda mega: B.padding(B.length_batches(df, "i", "n", 10, 3, mega=mega), "n").first()
    alike, mixed = waste(20), waste(1)
    assert alike.examples == mixed.examples == 997 and alike.units == mixed.units and alike.padded < 0.6 * mixed.padded
    assert B.length_batches(df.limit(0), "i", "n", 10, 3).collect() == []


def test_bootstrap_is_resampling(spark):
    """Interval and mean against plain resampling with replacement."""
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2], rng.choice((0, 0, 1, 2, 5)), rng.randint(3, 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, g string, e long, t long").repartition(7)
    got = M.bootstrap(df, "k", "e", "t", "g", replicates=203, seed=9)
    found = {r.g: (r.low, r.high) for r in M.intervals(got, "g").collect()}
    draws = got.groupBy("g").agg(F.count("*").alias("n"), F.avg("total").alias("total")).collect()
    for g in "ab":
        mine = [(e, t) for _, h, e, t in rows if h == g]
        rates = []
        for _ in range(3000):
            drawn = [rng.choice(mine) for _ in mine]
            rates.append(sum(e for e, _ in drawn) / sum(t for _, t in drawn))
        rates.sort()
        wide = rates[2925] - rates[75]
        assert abs(found[g][0] - rates[75]) < 0.25 * wide and abs(found[g][1] - rates[2925]) < 0.25 * wide
    assert {r.n for r in draws} == {203}
    again = M.bootstrap(df.repartition(2), "k", "e", "t", "g", replicates=203, seed=9)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    empty = M.bootstrap(df.limit(0), "k", "e", "t", "g").collect()
    assert empty == []


def test_weights_are_poisson(spark):
    w = spark.range(3000).select(F.array(*M.replicate_weights(F.col("id"), 1, 16)).alias("w")).select(F.explode("w").alias("w"))
    counts = {r.w: r["count"] / 48000 for r in w.groupBy("w").count().collect()}
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613, 0.0153)):
        assert abs(counts[k] - share) < 0.008
    assert max(counts) <= 8


def plain_align(a, b):
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    i, j, s, d, ins = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            s, i, j = s + (a[i - 1] != b[j - 1]), i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, d, ins


def test_alignment_against_the_whole_matrix():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert M.align(a, b) == plain_align(a, b)


def test_alignment_of_long_texts_in_little_memory():
    rng = random.Random(7)
    a = [str(rng.randrange(500)) for _ in range(20_000)]
    b = [w for w in a if rng.random() > 0.02]
    b[5000:5000] = ["new"] * 300
    tracemalloc.start()
    s, d, ins = M.align(a, b)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20  # the whole matrix has 1.6 GB
    tracemalloc.stop()
    assert d - ins == len(a) - len(b) and s + d + ins <= 300 + len(a) - len(b) + 300
