import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components
from sparkloom.llm.common import evenly_joined
from sparkloom.llm.components import connected_components, restored, shuffled
from sparkloom.llm.ngrams import mix, unmix


def roots(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def check(spark, links, parts=8):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()}
    want = roots([x for x in links if None not in x and x[0] != x[1]])
    assert got.keys() == want.keys()
    by = {}
    for node, c in got.items():
        by.setdefault(c, set()).add(want[node])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want.values()))
    assert all(c in got for c in by)


def test_bijections():
    x = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 1000, dtype=np.int64)
    assert (unmix(mix(x.view(np.uint64))) == x.view(np.uint64)).all()
    assert (restored(shuffled(x, 5), 5) == x).all() and (shuffled(x, 5) != shuffled(x, 6)).all()


def test_random_graphs(spark):
    rng = random.Random(6)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(None, 3), (4, None), (5, 5), (-7, 2**62)])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("names", ["rising", "random"])
def test_path_over_many_partitions_takes_few_rounds(spark, monkeypatch, names):
    """A path of 4,000 nodes, each edge in its own place of 40 partitions, whatever the names."""
    rounds = []
    monkeypatch.setattr(components, "written", lambda df, name="t", real=components.written: (rounds.append(name), real(df, name))[1])
    node = F.col("id") if names == "rising" else F.xxhash64("id")
    after = F.col("id") + 1 if names == "rising" else F.xxhash64(F.col("id") + 1)
    path = spark.range(0, 4000, 1, 40).select(node.alias("a"), after.alias("b")).repartition(40, F.xxhash64("a"))
    got = connected_components(path)
    assert got.agg(F.countDistinct("component"), F.count("*")).first() == (1, 4001)
    assert rounds.count("map") <= 24  # a factor of 2/3 a round would take 21


def test_hub(spark):
    """A star with most of the edges beside small pieces."""
    check(spark, [(0, i) for i in range(1, 900)] + [(i, i + 1) for i in range(2000, 2100, 2)])


@pytest.mark.parametrize("how", ["left", "inner"])
def test_even_join(spark, how):
    left = [(1 if i < 900 else i % 50, i) for i in range(2000)] + [(None, -1)]
    right = [(k, f"v{k}") for k in range(0, 40)]
    a, b = spark.createDataFrame(left, "k long, i long"), spark.createDataFrame(right, "k long, v string")
    got = sorted(map(tuple, evenly_joined(a, b, ["k"], ["i"], how).collect()), key=str)
    of = dict(right)
    assert got == sorted([(k, i, of.get(k)) for k, i in left if how == "left" or k in of], key=str)
    plan = evenly_joined(a, b, ["k"], ["i"], how)
    assert plan.columns == ["k", "i", "v"]
