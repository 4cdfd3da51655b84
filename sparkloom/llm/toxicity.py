"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams of the whole lower-cased text, hashed into 2 ** bits buckets. Every
n-gram whose ratio stands evidence standard errors or more from zero in the labelled rows is kept; their number follows
from the texts and has no bound but the buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table, whole_text
from .ngrams import char_ngrams, joined

BATCH_CHARS = 1 << 18
#: Characters whose n-grams are in the driver's memory together while fitting.
FIT_CHARS = 1 << 17
#: Bytes of one long text whose n-grams are in memory together.
WINDOW = 1 << 20


@dataclass(frozen=True)
class Settings:
    """sample bounds the labelled rows of each class used to fit; evidence is what an n-gram needs to be kept."""

    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    sample: int = 2000
    evidence: float = 7.0
    smoothing: float = 1.0
    ridge: float = 0.02
    steps: int = 300


@dataclass(frozen=True)
class Model:
    """Scores are logistic(bias + sum of weight over the distinct n-grams of a text).

    informed is False if the labelled rows do not hold both classes, or no n-gram tells them apart.
    """

    settings: Settings
    weight: np.ndarray
    bias: float
    informed: bool = True

    def scores(self, texts: list[str]) -> np.ndarray:
        doc, bucket = present(texts, self.settings, self.weight != 0)
        z = self.bias + np.bincount(doc, self.weight[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def present(texts: list[str], s: Settings, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct n-grams of each text, of the wanted buckets only if given."""
    data, bounds = joined([f" {t.lower()}" for t in texts])
    sizes, keys = sorted(s.sizes), [np.zeros(0, np.int64)]
    for at in range(0, len(data), WINDOW):
        end = min(len(data), at + WINDOW)
        doc = np.repeat(np.arange(len(texts)), np.diff(np.clip(bounds, at, end)))
        left = bounds[doc + 1] - np.arange(at, end)
        for size, buckets in zip(sizes, char_ngrams(data[at : end + sizes[-1]], s.sizes, s.bits), strict=True):
            buckets = buckets[: end - at]
            inside = left >= size
            if wanted is not None:
                inside &= wanted[buckets]
            keys.append(np.unique(doc[inside] << s.bits | buckets[inside]))
    distinct = np.unique(np.concatenate(keys))
    return distinct >> s.bits, distinct & ((1 << s.bits) - 1)


def fit(texts: list[str], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit on texts with labels 0 and 1; with one class only, every score is near that class.

    Log-count ratios r come from the smoothed document counts of each n-gram by class. The n-grams
    of three texts or more whose |r| times the square root of their count reaches s.evidence enter a ridge-regularised
    logistic regression on presence * r, in which both classes weigh the same, solved by accelerated gradient steps.
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(s, np.zeros(1 << s.bits), 0.0 if not len(y) else (4.0 if y[0] else -4.0), False)
    size = 1 << s.bits
    p, both, base = np.zeros(size), np.zeros(size), 0
    for part in chunks(texts, len, FIT_CHARS):
        doc, bucket = present(part, s)
        p += np.bincount(bucket[y[base + doc] == 1], minlength=size)
        both += np.bincount(bucket, minlength=size)
        base += len(part)
    q = both - p
    r = np.log((p + s.smoothing) / (y.sum() + 2 * s.smoothing)) - np.log((q + s.smoothing) / (len(y) - y.sum() + 2 * s.smoothing))
    top = np.flatnonzero(np.abs(r) * np.sqrt(both) * (both > 2) >= s.evidence)
    slot = np.full(size, -1, np.int32)
    slot[top] = np.arange(len(top))
    parts, base = [], 0
    for part in chunks(texts, len, FIT_CHARS):  # once more, so that only the kept n-grams are in memory together
        doc, bucket = present(part, s, slot >= 0)
        parts.append((doc.astype(np.int32) + base, slot[bucket]))
        base += len(part)
    doc, col = (np.concatenate(x) for x in zip(*parts, strict=True))
    ratio = r[top]
    mass = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, v, bias, vb = np.zeros(len(top)), np.zeros(len(top)), 0.0, 0.0
    norms = np.bincount(doc, ratio[col] ** 2, len(y))
    rate = 4 / (np.quantile(norms, 0.99) + 1 + 4 * s.ridge)
    for step in range(s.steps):
        z = np.bincount(doc, (v * ratio)[col], len(y)) + vb
        g = mass * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        new = v - rate * (np.bincount(col, g[doc], len(top)) * ratio + s.ridge / max(1, len(top)) * v)
        new_bias = vb - rate * g.sum()
        momentum = step / (step + 3)
        v, vb = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias = new, new_bias
    weight = np.zeros(size)
    weight[top] = w * ratio
    return Model(s, weight, bias, bool(len(top)))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, s: Settings) -> tuple[list[str], np.ndarray]:
    """At most s.sample labelled texts of each class, never more rows: those of the smallest hashes.

    Two labels of one doc_id both count, and so does each of several rows of a doc_id. Rows without a label of 0 or 1 or
    without doc_id are not used. Labels are thinned by the hash of doc_id to about 2 * s.sample, as only so many
    are needed, which makes the join a broadcast; the rows that it finds are then cut by the hash of doc_id and text.
    """
    label = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    sizes = {r["y"]: r["n"] for r in label.groupBy("y").agg(F.count("*").alias("n")).collect()}
    position = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.when(F.col("y") == 1, F.lit(min(1.0, s.sample / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, s.sample / max(1, sizes.get(0, 0)))))
    picked = F.broadcast(label.where(position < share).groupBy("doc_id", "y").agg(F.count("*").alias("times")))
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).join(picked, "doc_id").select("doc_id", "text", "y", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    order = [F.xxhash64("doc_id", "text", "time"), F.col("doc_id"), F.col("text")]
    classes = [rows.where(F.col("y") == y).orderBy(*order).limit(s.sample) for y in (0, 1)]
    found = classes[0].unionByName(classes[1]).toPandas().sort_values(["doc_id", "text", "y"])
    return found["text"].tolist(), found["y"].to_numpy()


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the decimal doc_id leaves 0; null counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return fit(*labelled_sample(docs, labels, ~held_out(F.col("doc_id")), settings), settings)


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """text -> score as an Arrow function; only the non-zero weights travel to the workers."""
    kept = np.flatnonzero(model.weight)
    packed = spark.sparkContext.broadcast((kept, model.weight[kept], model.bias, model.settings))  # 2 ** bits entries at most

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, values, bias, settings = packed.value
        weight = np.zeros(1 << settings.bits)
        weight[at] = values
        local = Model(settings, weight, bias)
        for texts in batches:
            yield pd.Series(np.concatenate([local.scores(part) for part in chunks(texts.fillna("").tolist(), len, BATCH_CHARS)] or [np.zeros(0)]))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Score every whole text of docs; fit on the labelled rows that are not held out.

    A null text scores as the empty one; a null doc_id is kept and never trains. Repeated rows
    give repeated results; other columns are ignored; no labels give scores of 0.5, labels of one class scores near
    it; of several labels of a document each counts; no rows give none.
    """
    model = train(docs, labels, settings)
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs.sparkSession, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
