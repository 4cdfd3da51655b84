"""Duplicate passages by relative Lempel-Ziv parsing against the whole corpus.

The reference is the corpus itself. Texts are packed into chunks; a window of length words holds at least one anchor, the
run of seed words with the least hash among its own, and equal windows hold the same anchor at the same place. The
first place of every anchor is what the reference holds of it; anchors, one row a chunk each, are dealt by their hash
into sorted index blocks, and every block is asked for the anchors it can hold.

A document is then parsed greedily. At an anchor that the reference holds a factor opens there, and it goes on for as long
as the next anchors stand at the same distances in the reference; neighbouring anchors touch or overlap, so a factor
equals its place word by word. Factors of at least length words are duplicate spans, here and at their place in
the reference, whose chunk is told.

Windows that a factor's boundary cuts are checked on their own: if their anchor is held by the reference, the hash of the
whole window (128 bits) is counted over the corpus. A window inside a long factor occurs at the first place of its anchor,
so it is enough that first places take part in the count beside the windows that were cut: none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole_text, written

#: Characters of a chunk, but for longer texts, which have one each.
CHUNK = 1 << 21
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)  # odd multipliers


def _packed(limit: int) -> Callable:
    """Rows (doc_id, text) to chunks (chunk, docs); docs is a compressed table of the rows, in their order."""

    def packed(number: int, ids: list, texts: list) -> pa.RecordBatch:
        rows = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(text) > limit:
                    yield packed(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield packed(number, ids, texts)

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A hash of every run of k values."""
    n = max(0, len(values) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * base + values[j : j + n]
    return _mixed(out)


class Chunk:
    """The words of a chunk's documents on one line of places; an empty place parts each two documents."""

    def __init__(self, docs: bytes, length: int):
        rows = pa.ipc.open_file(pa.py_buffer(docs)).read_all()
        self.ids, self.words = rows.column("doc_id").to_pylist(), [_WORD.findall(t) for t in rows.column("text").to_pylist()]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.length, self.seed = length, length // 2 + 1  # so that neighbouring anchors touch
        self.places = int(self.ends[-1]) + 1 if len(sizes) else 0

    def hashed(self) -> None:
        """Finds windows (their starts) and the anchor in each one."""
        flat = np.array([w for words in self.words for w in words], object)
        self.values = np.zeros(self.places, np.uint64)
        filled = np.ones(self.places, bool)
        filled[self.ends] = False
        if len(flat):
            self.values[filled] = pd.util.hash_array(flat)
        end = np.repeat(self.ends, self.ends - self.starts + 1)
        at = np.arange(self.places)
        self.windows = np.flatnonzero(at + self.length <= end)
        self.grams = rolled(self.values, self.seed, _FIRST)
        wide = self.length - self.seed + 1
        if len(self.windows):
            runs = np.lib.stride_tricks.sliding_window_view(self.grams, wide)
            self.anchor_of = self.windows + np.concatenate([runs[w].argmin(axis=1) for w in np.array_split(self.windows, -(-len(self.windows) // 65536))])
        else:
            self.anchor_of = self.windows
        self.anchors, self.anchor_index = np.unique(self.anchor_of, return_inverse=True)
        self.hashes = self.grams[self.anchors].view(np.int64)
        self.doc_end = end[self.anchors] if len(self.anchors) else self.anchors

    def window_hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = rolled(self.values, self.length, _FIRST), rolled(_mixed(self.values), self.length, _SECOND)
        return one[starts].view(np.int64), two[starts].view(np.int64)


def _anchors(length: int) -> Callable:
    """Chunks to their distinct anchors, each with the first place in the chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, docs in zip(pdf["chunk"], pdf["docs"]):
                c = Chunk(docs, length)
                c.hashed()
                h, first = np.unique(c.hashes, return_index=True)
                if len(h):
                    yield pd.DataFrame({"h": h, "chunk": number, "at": c.anchors[first]})

    return run


def references(anchors: DataFrame) -> DataFrame:
    """(h, chunk, ref_chunk, ref_at, first) of the anchors of two or more chunks.

    The reference place is the anchor's place in its first chunk; for that chunk itself it is the place in the second one.
    A key has a row a chunk at most, and the window streams over them.
    """
    of = Window.partitionBy("h").orderBy("chunk")
    so_far = of.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("chunk", "at")
    seen = anchors.select("h", "chunk", F.first(place).over(so_far).alias("head"), F.lead(place).over(of).alias("next"))
    first = F.col("head.chunk") == F.col("chunk")
    ref = F.when(first, F.col("next")).otherwise(F.col("head"))
    return seen.select("h", "chunk", ref.alias("ref"), first.alias("first")).where("ref is not null").select("h", "chunk", F.col("ref.chunk").alias("ref_chunk"), F.col("ref.at").alias("ref_at"), "first")


def held(c: Chunk, number: int, refs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(has, chunk, place, is_first) for every anchor of a chunk: whether it occurs elsewhere, where, and whether it is itself the first place."""
    h, head, group, n = np.unique(c.hashes, return_index=True, return_inverse=True, return_counts=True)
    refs = refs.sort_values("h")
    known = refs["h"].to_numpy(np.int64)
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    outside = known[at] == h if len(known) else np.zeros(len(h), bool)
    pick = lambda name, dtype: np.where(outside, refs[name].to_numpy(dtype)[at], 0) if len(known) else np.zeros(len(h), dtype)
    first_here = ~outside | pick("first", bool).astype(bool)
    # the second place in this chunk, for anchors whose first place is here and that occur in no other chunk
    order = np.argsort(group, kind="stable")
    opens = np.searchsorted(group[order], np.arange(len(h)))
    second = c.anchors[order[np.minimum(opens + 1, len(order) - 1)]] if len(order) else c.anchors
    is_first = first_here[group] & (np.arange(len(group)) == head[group])
    has = (outside | (n > 1))[group]
    ref_chunk = np.where(outside, pick("ref_chunk", np.int64), number)[group]
    ref_at = np.where(outside, pick("ref_at", np.int64), second)[group]
    local = first_here[group] & ~is_first
    return has, np.where(local, number, ref_chunk), np.where(local, c.anchors[head][group], ref_at), is_first


def factors(c: Chunk, has: np.ndarray, ref_chunk: np.ndarray, ref_at: np.ndarray) -> np.ndarray:
    """The number of the factor of each anchor: the longest runs of anchors of a document that the reference holds side by side."""
    p = c.anchors
    on = has[1:] & has[:-1] & (c.doc_end[1:] == c.doc_end[:-1]) & (ref_chunk[1:] == ref_chunk[:-1]) & (np.diff(ref_at) == np.diff(p))
    return np.concatenate([[0], np.cumsum(~on)]) if len(p) else p


def _merged(chunk: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """The union of the spans of each chunk."""
    order = np.lexsort((lo, chunk))
    chunk, lo, hi = chunk[order], lo[order], hi[order]
    reach = pd.Series(hi).groupby(chunk).cummax().to_numpy()
    new = np.ones(len(lo), bool)
    new[1:] = (chunk[1:] != chunk[:-1]) | (lo[1:] > reach[:-1])
    opens = np.flatnonzero(new)
    return pd.DataFrame({"chunk": chunk[opens], "lo": lo[opens], "hi": np.maximum.reduceat(hi, opens) if len(opens) else hi})


_MARKS = "chunk long, lo long, hi long, h1 long, h2 long, n long"


def _parsed(length: int) -> Callable:
    """A chunk and its references to spans (n = 0) of chunks, and to windows to be counted (n > 0) of this one."""

    def run(chunks: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        number = int(chunks["chunk"].iloc[0])
        c = Chunk(chunks["docs"].iloc[0], length)
        c.hashed()
        has, ref_chunk, ref_at, is_first = held(c, number, refs)
        run_of = factors(c, has, ref_chunk, ref_at)
        opens = np.flatnonzero(np.diff(run_of, prepend=-1))
        closes = np.append(opens[1:], len(run_of)) - 1
        lo, hi = c.anchors[opens], c.anchors[closes] + c.seed if len(opens) else c.anchors[opens]
        long = has[opens] & (hi - lo >= length)
        there = ref_at[opens] - lo
        spans = _merged(np.concatenate([np.full(long.sum(), number), ref_chunk[opens][long]]), np.concatenate([lo[long], (lo + there)[long]]), np.concatenate([hi[long], (hi + there)[long]]))
        mine = run_of[c.anchor_index]
        inside = (lo[mine] <= c.windows) & (c.windows + length <= hi[mine])
        cut = has[c.anchor_index] & (~inside | is_first[c.anchor_index])
        h1, h2 = c.window_hashes(c.windows[cut])
        counted = pd.DataFrame({"h1": h1, "h2": h2}).value_counts().rename("n").reset_index() if len(h1) else pd.DataFrame({"h1": h1, "h2": h2, "n": h1})
        return pd.concat([spans.assign(h1=0, h2=0, n=0), counted.assign(chunk=number, lo=0, hi=0)])[["chunk", "lo", "hi", "h1", "h2", "n"]].astype(np.int64)

    return run


_OUT = "doc_id long, n_words long, starts array<long>, ends array<long>, kept string"


def _cleaned(length: int) -> Callable:
    """A chunk and its marks (spans, and windows by their hashes) to its documents."""

    def run(chunks: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(chunks["docs"].iloc[0], length)
        depth = np.zeros(c.places + 1, np.int64)
        whole = marks["n"].to_numpy(np.int64) == 0
        np.add.at(depth, marks["lo"].to_numpy(np.int64)[whole], 1)
        np.add.at(depth, marks["hi"].to_numpy(np.int64)[whole], -1)
        if not whole.all():
            c.hashed()
            a, b = (marks[k].to_numpy(np.int64)[~whole] for k in ("h1", "h2"))
            h1, h2 = c.window_hashes(c.windows)
            pairs, near = set(zip(a.tolist(), b.tolist())), np.flatnonzero(np.isin(h1, a))
            hit = c.windows[near[[pair in pairs for pair in zip(h1[near].tolist(), h2[near].tolist())]]]
            np.add.at(depth, hit, 1)
            np.add.at(depth, hit + length, -1)
        gone = np.cumsum(depth)[:-1] > 0
        edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
        opens, closes = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # spans end with their document at the latest
        rows = []
        for doc_id, words, start, end in zip(c.ids, c.words, c.starts, c.ends):
            a, b = np.searchsorted(opens, (start, end))
            if a == b:
                rows.append((doc_id, len(words), [], [], " ".join(words)))
            else:
                kept = [w for w, g in zip(words, gone[start:end]) if not g]
                rows.append((doc_id, len(words), opens[a:b] - start, closes[a:b] - start, " ".join(kept)))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "starts", "ends", "kept"]).astype({"doc_id": "Int64"})

    return run


def duplicate_passages(docs: DataFrame, length: int = 35, chunk: int = CHUNK) -> DataFrame:
    """Documents without the words covered by a run of length words that also starts anywhere else, in the same document too.

    Words are maximal runs of characters other than space and U+0009 to U+000D, compared as they are. Every occurrence
    goes, the first one too; runs are judged on the input. Null, empty and blank texts have no words; texts shorter than a
    run lose none; each of several equal rows, and rows without doc_id, have a row of their own; no rows give none. Other
    columns are ignored. A text that is longer than a chunk (in characters) is a chunk of its own and is held by one task.

    Returns doc_id, n_words, starts and ends (spans of removed words, ends exclusive) and kept (the other words
    joined by one space).
    """
    if length < 1:
        raise ValueError("a run has at least one word")
    chunks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_packed(chunk), "chunk long, docs binary"), "chunks", "none")
    anchors = chunks.mapInPandas(_anchors(length), "h long, chunk long, at long")
    refs = references(anchors)
    parsed = written(chunks.groupBy("chunk").cogroup(refs.groupBy("chunk")).applyInPandas(_parsed(length), _MARKS), "parsed", "zstd")
    counted = parsed.where("n > 0").withColumn("total", F.sum("n").over(Window.partitionBy("h1", "h2"))).where("total > 1").drop("total")
    marks = parsed.where("n = 0").distinct().unionByName(counted)
    return chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInPandas(_cleaned(length), _OUT)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_substrings": op13_substrings}
ORACLES: dict[str, str] = {
    "op13_substrings": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i) WHERE len(ws) >= 35),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT i + j) AS places FROM w JOIN twice USING (k), range(35) r(j) GROUP BY rid),
kept AS (SELECT doc_id, len(ws) AS n_words, CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(places, i)) END AS rest FROM d LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - len(rest) AS BIGINT) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""
}
