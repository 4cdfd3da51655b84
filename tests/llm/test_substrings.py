"""Duplicate passages against counting every window."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import substrings as S

SHAPE = "doc_id long, text string, chunk string"


def brute(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    windows = lambda ws: (tuple(ws[i : i + length]) for i in range(len(ws) - length + 1))
    counts = Counter(w for ws in words for w in windows(ws))
    out = []
    for (doc_id, _), ws in zip(rows, words):
        gone = {i + j for i, w in enumerate(windows(ws)) if counts[w] > 1 for j in range(length)}
        out.append((doc_id, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


def got(df, length, **how):
    found = S.duplicate_passages(df, length, **how).collect()
    for r in found:
        assert all(a < b for a, b in zip(r.starts, r.ends)) and all(b < a for b, a in zip(r.ends, r.starts[1:])) and not (r.ends and r.ends[-1] > r.n_words)
    return sorted([(r.doc_id, r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), r.kept) for r in found], key=str)


def corpus(seed, n, words, passages=8):
    """Texts of few different words with copied passages, changed copies and copies of both ends of others."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared, texts = [some(rng.randint(3, 60)) for _ in range(passages)], []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            part = some(rng.randint(0, 25)) if rng.random() < 0.5 else list(rng.choice(shared))
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            text += part[rng.randint(0, 3) :] if rng.random() < 0.5 else part
        if texts and rng.random() < 0.2:
            text = list(rng.choice(texts))[rng.randint(0, 9) :] + some(2)
        texts.append(text)
    return [(i, rng.choice((" ", "\n", "\t ")).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("length, words", [(1, 300), (2, 60), (3, 12), (5, 3), (8, 1000), (12, 2), (35, 400)])
@pytest.mark.parametrize("chunk", [1, 400, 1 << 20])
def test_against_counts(spark, length, words, chunk):
    rows = corpus(length * 7 + words, 60, words)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SHAPE).repartition(6)
    assert got(df, length, chunk=chunk) == brute(rows, length)


def test_odd_rows(spark):
    long = " ".join(f"word{i % 977}x{i % 1013}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (None, "a b c d"), (None, "a b c d"), (4, "x a b c d y"), (5, "one\xa0two three"), (5, "one\xa0two three"), (6, "ab bc"), (7, "a bbc"), (8, long), (9, long[7:] + " end"), (10, "e " * 9), (11, "é ü 日 本 𝕏 z é ü 日 本 𝕏")]
    df = spark.createDataFrame([(*r, None) for r in rows], SHAPE).repartition(3)
    for length in (3, 5):
        assert got(df, length, chunk=50) == got(df, length) == brute(rows, length)
    assert got(df.limit(0), 3) == []
    with pytest.raises(ValueError):
        S.duplicate_passages(df, 0)


def test_factors_of_a_copy(spark):
    """A copied passage is one factor on its place in the reference, and what surrounds it is in none."""
    rng = np.random.default_rng(1)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = fresh(300)
    texts = [" ".join(fresh(90) + passage + fresh(80)), " ".join(fresh(10) + passage + fresh(70)), " ".join(fresh(200))]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SHAPE).coalesce(1)
    chunks = df.select("doc_id", "text").mapInArrow(S._packed(1), "chunk long, docs binary").toPandas()
    refs = S.references(spark.createDataFrame(chunks).mapInPandas(S._anchors(35), "h long, chunk long, at long")).toPandas()
    for number, docs, shift in zip(chunks["chunk"][:2], chunks["docs"], (90, 10)):
        c = S.Chunk(docs, 35)
        c.hashed()
        has, ref_chunk, ref_at, is_first = S.held(c, number, refs[refs["chunk"] == number])
        runs = S.factors(c, has, ref_chunk, ref_at)
        assert len(set(runs[has])) == 1 and (ref_at[has] - c.anchors[has] == (10 if shift == 90 else 90) - shift).all()
        assert c.anchors[has].min() - shift < 18 and shift + 300 - (c.anchors[has].max() + c.seed) < 18 and is_first[has].all() == (number == chunks["chunk"][0])
    assert [r[2] for r in got(df, 35)] == [300, 300, 0]


def test_frequent_passage(spark):
    """A passage of every text, with a different end each time, is told to its first place once a chunk."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} b{i} c{i % 3}") for i in range(400)]
    df = spark.createDataFrame([(*r, None) for r in rows], SHAPE).repartition(8)
    assert got(df, 35, chunk=2000) == brute(rows, 35)
    assert {r[2] for r in got(df, 35, chunk=2000)} == {60}
    assert S.duplicate_passages(df.withColumn("text", F.lit(passage)), 35).agg(F.sum(F.length("kept"))).first()[0] == 0
