import collections
import functools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import lm_score
from sparkloom.llm.lm_score import Smoothing


class Brute:
    """Both models with plain counters; the mark is None."""

    def __init__(self, rows, goal, s=Smoothing()):
        self.s, self.goal = s, goal
        self.seqs = [(d, [*re.findall("[^ \t-\r]+", (t or "").lower()), None]) for d, t in rows]
        self.seqs = [(d, ws if len(ws) > 1 else []) for d, ws in self.seqs]
        self.counts = {}
        for name, chosen in (("target", lambda d: d in goal), ("background", lambda d: d not in goal)):
            single, double = collections.Counter(), collections.Counter()
            for d, ws in self.seqs:
                if chosen(d):
                    single.update(ws)
                    double.update(zip([None, *ws], ws, strict=False))
            self.counts[name] = (single, double, single.total())
        self.size = len(set().union(*[c[0] for c in self.counts.values()])) + 1
        self.tokens = min([c[2] for c in self.counts.values() if c[2]], default=0)

    def probability(self, name, word, before, left_out=()):
        single, double, total = self.counts[name]
        scale = self.tokens / max(total, 1)
        own, own2 = self.own(tuple(left_out))
        p = (scale * (single[word] - own[word]) + self.s.unigram) / (scale * (total - len(left_out)) + self.s.unigram * self.size)
        return (scale * (double[before, word] - own2[before, word]) + self.s.context * p) / (scale * (single[before] - own[before]) + self.s.context)

    @functools.lru_cache(maxsize=2)
    def own(self, left_out):
        return collections.Counter(left_out), collections.Counter(zip([None, *left_out], left_out, strict=False))

    def losses(self, i):
        d, ws = self.seqs[i]
        out = []
        for name in ("background", "target"):
            mine = ws if (d in self.goal) == (name == "target") else ()
            out.append(-sum(math.log2(self.probability(name, w, b, mine)) for b, w in zip([None, *ws], ws, strict=False)) / max(len(ws), 1))
        return [*out, out[1] - out[0]]


def check(rows, goal, got):
    brute = Brute(rows, goal)
    of = collections.defaultdict(list)
    for r in got:
        of[r.doc_id].append((r.n_words, [r.background_loss, r.target_loss, r.score]))
    assert sum(map(len, of.values())) == len(rows)
    for i, (d, _) in enumerate(rows):
        want = brute.losses(i)
        n = max(len(brute.seqs[i][1]) - 1, 0)
        assert any(n == k and np.allclose(x, want) for k, x in of[d]), (d, want, of[d])


def test_as_plain_counters(spark):
    """However many words and bigrams there are, over several chunks; with repeated, null and wordless rows."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(60_000)}" for _ in range(200))) for i in range(300)]
    rows += [(300, "Same same same"), (None, "w1 w2"), (301, " "), (302, None), (3, rows[3][1]), (7, "same w3 w4")]
    goal = set(range(0, 300, 3))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("score", F.lit(1)).withColumn("target", F.lit(True))
    got = lm_score.cross_entropy_difference(frame, spark.createDataFrame([(i,) for i in [*goal, 3]], "doc_id long"))
    check(rows, goal, got.collect())


def test_models_sum_to_one():
    rows = [(1, "a b a c"), (2, "a b d"), (3, "e e e a b")]
    brute = Brute(rows, {1})
    words = [None, "a", "b", "c", "d", "e", "never seen"]
    for name in ("target", "background"):
        for before in words:
            assert math.isclose(sum(brute.probability(name, w, before) for w in words), 1)
            assert math.isclose(sum(brute.probability(name, w, before, brute.seqs[2 if name == "background" else 0][1]) for w in words), 1)


def test_one_model_only_and_no_rows(spark):
    rows = [(1, "one two"), (2, "one two three")]
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long")
    check(rows, set(), lm_score.cross_entropy_difference(docs, none).collect())
    check(rows, {1, 2}, lm_score.cross_entropy_difference(docs, docs.select("doc_id")).collect())
    assert lm_score.cross_entropy_difference(docs.limit(0), none).count() == 0


def test_texts_that_occur_twice_stand_apart(spark):
    """Without its own tokens a text is predicted from the rest of the corpus: far better if a copy is there."""
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    rows = [(i, text()) for i in range(200)]
    rows += [(1000 + i, rows[3 * i + 1][1]) for i in range(20)]
    goal = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    got = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), goal).collect()}
    twice = [got[3 * i + 1] for i in range(20)]
    once = [s for d, s in got.items() if d < 200 and d % 3 and d not in {3 * i + 1 for i in range(20)}]
    assert min(twice) > max(once)


def test_target_like_texts_score_low(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(30)}" for _ in range(60))) for i in range(120)]
    goal = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    got = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), goal).collect()}
    assert max(got[i] for i in range(60, 120, 2)) < min(got[i] for i in range(61, 120, 2))
