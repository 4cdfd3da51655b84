"""Inference over batches of sequences, and prefix beam search over frames of scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[np.ndarray]], Sequence]


def _batches(lengths: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Positions in batches of like length whose padded size, rows times the longest, is at most budget; a longer row is alone."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, budget // max(1, int(lengths[order[at]])))
        yield order[at : at + n]
        at += n


def predicted(rows: DataFrame, inputs: str, build: Callable[[], Model], name: str, kind: str, budget: int = 1 << 20) -> DataFrame:
    """rows with the column name of type kind: what a model gives for the arrays in inputs.

    build runs once a task and gives a function from a list of float arrays (nested ones flattened, null as empty) to a
    list of results in the same order. Rows of an Arrow batch are sorted by length and handed to it in batches whose padded size is at most
    budget, so a batch fits a device whatever the mix of lengths. No rows are dropped, and other columns stay in the JVM.
    """
    nested = dict(rows.dtypes)[inputs].startswith("array<array<")
    flat = F.flatten(inputs) if nested else F.col(inputs)

    @F.pandas_udf(kind)
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for column in columns:
            arrays = [np.zeros(0) if v is None else np.asarray(v, np.float64) for v in column]
            out: list = [None] * len(arrays)
            for part in _batches(np.array([len(a) for a in arrays], np.int64), budget):
                for i, value in zip(part.tolist(), model([arrays[i] for i in part.tolist()]), strict=True):
                    out[i] = value
            yield pd.Series(out, dtype=object) if kind.startswith(("array", "string")) else pd.Series(out)

    return rows.withColumn(name, run(flat.cast("array<double>")))


def log_softmax(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=1, keepdims=True)
    return scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def prefix_beams(log_probs: np.ndarray, width: int, blank: int = 0, bonus: Callable[[tuple[int, ...], int], float] | None = None) -> list[tuple[tuple[int, ...], float]]:
    """The best labellings of frames (rows of log probabilities) with their log probability, best first.

    Frames that repeat a label without a blank between are one label, so a prefix keeps apart how likely it ends in a
    blank and in its last label. bonus(prefix, label) is added where a label is appended, such as a language
    model's log probability. Without it and with a width that no frame exceeds the sums are exact. Ties go to the smaller labelling.
    """
    beams: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, -math.inf)}
    for frame in log_probs:
        found: dict[tuple[int, ...], list[float]] = {}
        for prefix, (ends_blank, ends_label) in beams.items():
            both = _add(ends_blank, ends_label)
            slot = found.setdefault(prefix, [-math.inf, -math.inf])
            slot[0] = _add(slot[0], both + frame[blank])
            if prefix:
                slot[1] = _add(slot[1], ends_label + frame[prefix[-1]])
            for label, p in enumerate(frame):
                if label == blank or p == -math.inf:
                    continue
                before = ends_blank if prefix and label == prefix[-1] else both
                if before > -math.inf:
                    longer = found.setdefault((*prefix, label), [-math.inf, -math.inf])
                    longer[1] = _add(longer[1], before + p + (bonus(prefix, label) if bonus else 0.0))
        ranked = sorted(found.items(), key=lambda kv: (-_add(*kv[1]), kv[0]))
        beams = {k: (v[0], v[1]) for k, v in ranked[:width]}
    return [(k, _add(*v)) for k, v in beams.items()]


def beam_decoder(symbols: int, width: int, blank: int = 0, bonus: Callable[[tuple[int, ...], int], float] | None = None) -> Callable[[], Model]:
    """A model for predicted(): frames of symbols scores each to (labels, log probability) of the best labelling."""

    def build() -> Model:
        def decode(arrays: list[np.ndarray]) -> list:
            out = []
            for a in arrays:
                frames = a[: len(a) // symbols * symbols].reshape(-1, symbols)
                labels, p = prefix_beams(log_softmax(frames) if len(frames) else frames, width, blank, bonus)[0]
                out.append([float(x) for x in (*labels, p)])
            return out

        return decode

    return build


def beam_decode(rows: DataFrame, frames: str, symbols: int, width: int = 16, blank: int = 0, bonus: Callable[[tuple[int, ...], int], float] | None = None) -> DataFrame:
    """rows with labels (array<int>) and log_prob of the best labelling of their frames of scores.

    Null and empty frames have no labels and log_prob 0; scores behind the last whole frame are ignored.
    """
    found = predicted(rows, frames, beam_decoder(symbols, width, blank, bonus), "_best", "array<double>")
    labels = F.slice("_best", F.lit(1), F.size("_best") - 1).cast("array<int>")
    return found.withColumn("labels", labels).withColumn("log_prob", F.element_at("_best", -1)).drop("_best")
