"""Cross-entropy difference of two matched n-gram language models.

A text of n words is n + 1 tokens, its words and a mark that ends it; the context of a token is the
one before it, that of the first the mark. Both models share one vocabulary, the distinct tokens
of all documents and one unknown word, their order and their smoothing. The target model is counted on the
target documents, the background model on all others. Their sizes are matched without leaving
documents out: the counts of the larger one are scaled down to as many tokens as the smaller one has. A
document is scored by what is left when its own tokens are taken out of the counts, so no
text is predicted from itself. For a word w after b, with scaled counts c and their sum N,

    P(w) = (c(w) + unigram) / (N + unigram * V)         P(w | b) = (c(b, w) + context * P(w)) / (c(b) + context)

where V counts the vocabulary; both sum to 1 over it.

Words and bigrams are counted by their 64-bit keys, every distinct one by itself, in
tables that grow with the corpus and are never gathered in one place: chunks of documents ask
the shards of the key space for the counts of the keys they hold, one row a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table, whole_text, written
from .ngrams import mix, words

BATCH_CHARS = 1 << 20
#: Characters of the documents that ask for their counts together.
CHUNK_CHARS = 1 << 22
#: Characters of the corpus whose words, or bigrams, one shard counts on average, and the least number of shards.
SHARD_CHARS, LEAST_SHARDS = 1 << 25, 256
#: Parts of the key space that are counted one after the other, so that only one part's keys are on disk at a time.
ROUNDS = 4


#: Ends every text and stands before its first word; no word has this key.
MARK = np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Smoothing:
    """Counts added to every word of the vocabulary, and the weight of the unigrams in every context."""

    unigram: float = 0.5
    context: float = 2.0


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit key of every token and of its bigram, the position of its context, and each text's first token.

    The mark that ends a text is its last token, and the context of its first; a text without words has no tokens.
    """
    h, first = words(texts)
    n = np.diff(first)
    full = n > 0
    token = np.insert(h, first[1:][full], MARK)
    start = np.concatenate([[0], np.cumsum(n + full)])
    before = np.arange(-1, len(token) - 1)
    before[start[:-1][full]] = start[1:][full] - 1
    return token, mix(token + mix(token[before])), before, start


def own_counts(at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often the key of each token, numbered by at, occurs in its own text."""
    _, code, count = np.unique(text * (int(at.max(initial=0)) + 1) + at, return_inverse=True, return_counts=True)
    return count[code]


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each chunk of documents, numbered within the task."""
    chunk = TaskContext.get().partitionId() << 32
    for pdf in batches:
        rows = list(zip(pdf["doc_id"], pdf["target"], pdf["text"], strict=True))
        for part in chunks(rows, lambda r: len(r[2]), CHUNK_CHARS):
            raw = [t.encode() for _, _, t in part]
            yield pd.DataFrame({"chunk": [chunk], "chars": [sum(map(len, raw))], "doc_ids": [[d for d, _, _ in part]], "targets": [[bool(t) for _, t, _ in part]], "lengths": [[len(r) for r in raw]], "texts": [zlib.compress(b"".join(raw), 1)]})
            chunk += 1


def _texts(row) -> list[str]:
    data, end = zlib.decompress(row.texts), np.cumsum(row.lengths)
    return [data[e - n : e].decode() for e, n in zip(end, row.lengths, strict=True)]


def _packed(counts: np.ndarray) -> bytes:
    """(model, key) counts in as few bytes each as the largest needs."""
    small = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    return bytes([small.itemsize]) + zlib.compress(small.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"u{blob[0]}").reshape(2, -1).astype(np.int64)


def _asked(shards: int, part: int) -> Callable:
    """The distinct keys of each chunk in order and their counts in it, a row for each kind (0 words, 1 bigrams) and shard.

    Only keys in the given one of ROUNDS parts of the shards.
    """
    shift = np.uint64(64 - (shards - 1).bit_length())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                word, pair, _, start = keys(_texts(row))
                target = np.repeat(np.array(row.targets, bool), np.diff(start))
                for kind, each in enumerate((word, pair)):
                    inside = (each >> shift) * np.uint64(ROUNDS) // np.uint64(shards) == part
                    distinct, at = np.unique(each[inside], return_inverse=True)
                    counts = np.stack([np.bincount(at, minlength=len(distinct)), np.bincount(at[target[inside]], minlength=len(distinct))])
                    shard, begin = np.unique(distinct >> shift, return_index=True)
                    cut = [slice(b, e) for b, e in pairwise([*begin, len(distinct)])]
                    yield pd.DataFrame({"chunk": row.chunk, "kind": kind, "shard": shard.astype(np.int64), "keys": [distinct[c].tobytes() for c in cut], "counts": [_packed(counts[:, c]) for c in cut]})

    return run


def _answer(kind: int, rows: list) -> pd.DataFrame:
    each = [np.frombuffer(r.keys, np.uint64) for r in rows]
    distinct, at = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.concatenate([_unpacked(r.counts) for r in rows], axis=1)
    total = np.stack([np.bincount(at, weights=c, minlength=len(distinct)) for c in counts]).astype(np.int64)
    ends = np.cumsum([len(k) for k in each])
    once = lambda n: [n] + [0] * (len(rows) - 1)
    answers = [_packed(total[:, at[e - len(k) : e]]) for e, k in zip(ends, each, strict=True)]
    sums = total.sum(axis=1)
    return pd.DataFrame({"chunk": [r.chunk for r in rows], "kind": kind, "shard": [r.shard for r in rows], "distinct_keys": once(len(distinct)), "tokens": once(sums[0]), "target_tokens": once(sums[1]), "counts": answers})


def _answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The corpus counts of the keys of every asking row, in its order; rows are sorted by kind and shard."""
    group, rows = None, []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if rows and group != (r.kind, r.shard):
                yield _answer(group[0], rows)
                rows = []
            group = (r.kind, r.shard)
            rows.append(r)
    if rows:
        yield _answer(group[0], rows)


def losses(texts: list[str], targets: np.ndarray, counts: np.ndarray, totals: tuple[int, int], vocabulary: int, smoothing: Smoothing) -> pd.DataFrame:
    """Per-token losses of texts, of which targets are target documents.

    counts (all documents or target documents, key) are of the texts' distinct words and bigrams, in
    order; totals are the tokens of all and of target documents.
    """
    word, pair, before, start = keys(texts)
    n = np.diff(start)
    text = np.repeat(np.arange(len(texts)), n)
    distinct, word_at = np.unique(word, return_inverse=True)
    pair_at = np.unique(pair, return_inverse=True)[1]
    own = {"word": own_counts(word_at, text), "pair": own_counts(pair_at, text)}
    tokens = {"background_loss": totals[0] - totals[1], "target_loss": totals[1]}
    size = min([t for t in tokens.values() if t], default=0)
    loss = {}
    for name, total in tokens.items():
        mine = (targets == (name == "target_loss"))[text]
        scale = size / max(total, 1)
        of = lambda at, which: scale * ((counts[1] if name == "target_loss" else counts[0] - counts[1])[at] - np.where(mine, own[which], 0))  # noqa: B023, E731
        once = of(word_at, "word")
        single = (once + smoothing.unigram) / (scale * (total - np.where(mine, n[text], 0)) + smoothing.unigram * vocabulary)
        p = (of(pair_at + len(distinct), "pair") + smoothing.context * single) / (once[before] + smoothing.context)
        each = np.concatenate([[0.0], np.cumsum(-np.log2(p))])
        loss[name] = (each[start[1:]] - each[start[:-1]]) / np.maximum(n, 1)
    return pd.DataFrame({"n_words": n - (n > 0), **loss, "score": loss["target_loss"] - loss["background_loss"]})


def _scored(totals: tuple[int, int], vocabulary: int, smoothing: Smoothing) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = [] if row.counts is None else [_unpacked(c) for c in row.counts]
                counts = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
                yield losses(_texts(row), np.array(row.targets, bool), counts, totals, vocabulary, smoothing).assign(doc_id=list(row.doc_ids))

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, smoothing: Smoothing = Smoothing()) -> DataFrame:
    """Per-token losses in bits of every whole text under both models, and target minus background.

    Low scores read like the target documents, those whose doc_id is in targets. A null, empty or
    wordless text has 0 words and scores 0; a text longer than a chunk is a chunk of its own, read whole by one task. A null doc_id is no target; a model without documents
    is uniform. Repeated rows count and score each, and each is predicted by the others; other columns are
    ignored; no rows give none.
    """
    ids = targets.select(F.col("doc_id").cast("long")).distinct().withColumn("target", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    # the same join at every size: the ids grow with the corpus, so they are not to be broadcast
    marked = texts.hint("merge").join(ids, "doc_id", "left").select(F.col("doc_id").cast("string"), F.coalesce("target", F.lit(False)).alias("target"), "text")
    parts = written(marked.mapInPandas(_chunked, "chunk long, chars long, doc_ids array<string>, targets array<boolean>, lengths array<long>, texts binary"), "lm-chunks")
    chars = parts.agg(F.sum("chars")).first()[0] or 0
    shards = 1 << (max(LEAST_SHARDS, -(-chars // SHARD_CHARS)) - 1).bit_length()
    rounds = []
    for part in range(ROUNDS):
        asked = parts.mapInPandas(_asked(shards, part), "chunk long, kind int, shard long, keys binary, counts binary")
        dealt = asked.repartition("kind", "shard").sortWithinPartitions("kind", "shard")
        rounds.append(written(dealt.mapInPandas(_answered, "chunk long, kind int, shard long, distinct_keys long, tokens long, target_tokens long, counts binary"), "lm-counts"))
    answers = reduce(DataFrame.unionByName, rounds)
    vocabulary, *totals = (n or 0 for n in answers.where("kind = 0").agg(F.sum("distinct_keys"), F.sum("tokens"), F.sum("target_tokens")).first())
    # shards are the key space in order, so a chunk's sorted answers are in the order of its sorted keys
    found = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "shard", "counts")))["counts"].alias("counts"))
    scored = parts.select("chunk", "doc_ids", "targets", "lengths", "texts").hint("merge").join(found, "chunk", "left").mapInPandas(_scored(tuple(totals), vocabulary + 1, smoothing), "doc_id string, n_words long, background_loss double, target_loss double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is every document labelled of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_lm_score": op4_lm_score}
ORACLES: dict[str, str] = {}
