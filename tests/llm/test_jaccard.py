import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import jaccard_join as J


def shingle_set(text, size):
    w = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    """(doc_id, n_shingles, component_id, n_links) of every row, by all pairs; components name the least doc_id, nulls aside."""
    sets = [shingle_set(t, size) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None), len(near[i])))
    return sorted(out, key=str)


def made(seed):
    """Copies around the threshold, exact copies, two texts under one doc_id, rows without doc_id, blank and short rows."""
    rng = random.Random(seed)
    base = [[f"b{k}w{i}" for i in range(rng.randrange(30, 110))] for k in range(4)]
    texts = []
    for _ in range(110):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    rows += [(3, texts[50]), (3, texts[3]), (None, texts[7]), (None, texts[7]), (None, "all alone here without a number"), (None, None), (None, ""), (200, " \t"), (201, "Two words"), (202, "two  WORDS"), (2**50, texts[9].upper())]
    return rows


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 128), (5, 80, 6)])
def test_links_and_components_as_all_pairs(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = made(size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).select("*", F.lit(1).alias("cid"), F.lit(2).alias("n"), F.lit(3).alias("digest"))
    got = J.jaccard_components(df, size, percent, links=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, size, percent)


def test_many_copies_and_no_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one text that a third of all rows hold")).otherwise(F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(str(k))).cast("binary")) for k in range(6)])).alias("text"))
    got = J.jaccard_components(df, links=True)
    assert got.where("component_id = 0 and n_links = 999").count() == 1000
    assert got.where("component_id = doc_id and n_links = 0").count() == 2000
    assert J.jaccard_components(df.limit(0), links=True).count() == 0


@pytest.mark.parametrize("percent", [75, 80, 85])
def test_pivots_windows_and_recursion(percent):
    """Regions held together by chains: cells and windows find every pair that all comparisons find, comparing fewer."""
    rng = random.Random(percent)
    sets = []
    for c in range(3):
        items = [rng.getrandbits(64) for _ in range(900)]
        for i in range(160):  # a window that slides over the items, so its ends have nothing in common
            mine = set(items[5 * i : 5 * i + 80])
            mine ^= {rng.getrandbits(64) for _ in range(rng.randrange(4))}
            sets.append(mine)
    rng.shuffle(sets)
    values = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    seen = Counter()
    got = {tuple(sorted(p, reverse=True)) for p in J.region_pairs(values, bounds, percent, seen=seen).tolist()}
    assert got == want and len(want) > 200
    assert seen["cells"] > 40 and seen["replicated"] > 0 and seen["home"] > 2 * len(sets)  # several levels of cells
    assert seen["pairs"] < len(sets) ** 2 / 4
    home = np.array([rng.random() < 0.3 for _ in sets])
    some = {tuple(sorted(p, reverse=True)) for p in J.region_pairs(values, bounds, percent, home).tolist()}
    assert some == {(i, j) for i, j in want if home[i] or home[j]}
