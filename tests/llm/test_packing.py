import collections
import random

from pyspark.sql import functions as F

from sparkloom.llm import packing
from sparkloom.llm.packing import Lengths, best_fit


def brute_pack(sizes, lengths):
    """Plain best fit over all open bins: [(opened length, [size index])], by scanning lists."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins = []
    for k, i in enumerate(order):
        fitting = [b for b in bins if b[0] - sum(sizes[j] for j in b[1]) >= sizes[i]]
        if fitting:
            min(fitting, key=lambda b: (b[0] - sum(sizes[j] for j in b[1]), bins.index(b)))[1].append(i)
            continue
        prices = []
        for c in lengths.permitted:
            if c >= sizes[i]:
                filled = sizes[i]
                for j in order[k + 1 :]:
                    if sizes[j] and filled + sizes[j] <= c:
                        filled += sizes[j]
                prices.append((lengths.cost(min(x for x in lengths.permitted if x >= filled)) / max(filled, 1), c))
        bins.append((min(prices)[1], [i]))
    return bins


def test_as_plain_best_fit():
    rng = random.Random(5)
    for _ in range(60):
        lengths = Lengths(tuple(sorted(rng.sample(range(20, 400), 3))), fixed=rng.choice([0.0, 16.0, 200.0]))
        sizes = [rng.randrange(0, max(lengths.permitted) + 1) for _ in range(rng.randrange(1, 50))]
        want = brute_pack(sizes, lengths)
        got = collections.defaultdict(list)
        for i, (b, offset) in enumerate(best_fit(sizes, lengths)):
            got[b].append((offset, i))
        assert {b: {i for _, i in v} for b, v in got.items()} == {b: set(v) for b, (_, v) in enumerate(want)}
        for members in got.values():
            at = 0
            for offset, i in sorted(members, key=lambda m: (m[0], sizes[m[1]])):
                assert offset == at
                at += sizes[i]


def test_joint_choice_and_downsizing_act():
    """Sizes like those of documents: many bins open above the smallest length that fits; bins whose foreseen contents went elsewhere shrink."""
    rng = random.Random(6)
    lengths = Lengths()
    above = shrunk = count = 0
    for n in [600] + [12] * 200:
        sizes = [min(4096, int(rng.lognormvariate(6, 1))) for _ in range(n)]
        bins = brute_pack(sizes, lengths)
        count += len(bins)
        above += sum(opened > lengths.downsized(max(sizes[i] for i in members)) for opened, members in bins)
        shrunk += sum(lengths.downsized(sum(sizes[i] for i in members)) < opened for opened, members in bins)
    assert above > count // 10 and shrunk > 0


def test_repeats_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 64)
    docs = spark.range(2000).select(F.lit(1).alias("doc_id"), F.lit("the same row").alias("text"), F.lit(1).alias("row"), F.lit(2).alias("total"))
    rows = packing.pack(docs, packing.byte_tokens()).collect()
    shards = collections.Counter(r.bin_id >> 32 for r in rows)
    assert len(rows) == 2000 and len(shards) == 32 and max(shards.values()) < 200
    assert {r.n_tokens for r in rows} == {4}


def test_null_tokens_and_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (3, "")], "doc_id long, text string")
    rows = packing.pack(docs, F.when(F.col("text") == "a", 9000)).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.n_tokens) for r in rows) == [(0, 0, 0, 0), (0, 0, 0, 4096), (0, 1, 4096, 4096), (0, 2, 8192, 808), (3, 0, 0, 0)]
