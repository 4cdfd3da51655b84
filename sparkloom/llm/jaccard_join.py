"""Exact Jaccard self-join of documents over word shingles, as a metric-space join.

Jaccard distance is a metric. Documents are first dealt into regions that no link leaves, then
each region is joined recursively: pivots split it into Voronoi cells, the triangle inequality
tells which documents of other cells lie close enough to a border to be replicated, and small or
indivisible cells are compared exactly.

The first level must separate documents that share next to nothing, which all lie at a distance of about 1 from
every pivot. Its pivots are therefore parts of the shingle universe: two sets of at most u
shingles that link differ in at most d = floor(2u * (1 - t) / (1 + t)) shingles, so of d + 1
parts of the universe at least one is hit by both in exactly the same way. Documents that agree
on a part, and whose sketches do not prove them apart, share a region; regions that share documents are
merged by connected components.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, dropped, evenly_joined, released, table, whole_text, written
from .components import connected_components, local_roots
from .counters import SCHEMA, collected, rows_of
from .ngrams import mix, shingles

BATCH_CHARS = 1 << 18
#: Documents of a region that one task compares with as many others; larger regions are dealt out in blocks.
BLOCK = 128
#: Cells of at most this many documents are compared exactly, larger ones get this many pivots, or the root of their number if that is more.
LEAF, PIVOTS = 16, 4
#: Sets farther than this from every pivot are a cell of their own, with pivots of its own.
CORE = 0.5
#: Buckets of a sketch at least, and members of a signature whose sketches one task compares with as many others.
LEAST_SKETCH, SKETCH_BLOCK = 32, 1024
#: Shingle frequencies are counted in 2 ** this many buckets; parts beyond the least number, as a share of it.
FREQUENCY_BITS, SPARE = 20, 0.12


def class_id(shingle_set: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted shingle set."""
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "big", signed=True)


def _sets(rows: list[tuple], size: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Rows, whose last field is a text, in parts with the shingle sets of their texts."""
    for part in chunks(rows, lambda r: len(r[-1]), BATCH_CHARS):
        values, bounds = shingles([r[-1] for r in part], size)
        yield part, values, bounds


def _classes(size: int) -> Callable:
    """Rows (doc_id, digest, text) -> a row for each document, and at the end the task's document frequencies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1, 1 << FREQUENCY_BITS), np.int64)
        for pdf in batches:
            for part, values, bounds in _sets(list(pdf.itertuples(index=False, name=None)), size):
                each = np.split(values, bounds[1:-1])
                ids = [class_id(v) if len(v) else None for v in each]
                total[0] += np.bincount(_bucket(values), minlength=1 << FREQUENCY_BITS)
                yield pd.DataFrame({"doc_id": [r[0] for r in part], "digest": [r[1] for r in part], "n_shingles": pd.array(np.diff(bounds), "Int64"), "cid": pd.array(ids, "Int64"), "sketch": [sketch(v) if len(v) else None for v in each], "model": pd.array([None] * len(part), "Int32"), "block": pd.array([None] * len(part), "Int32"), "counts": None})
        counted = rows_of(total)
        yield counted.assign(doc_id=None, digest=None, n_shingles=pd.array([None] * len(counted), "Int64"), cid=pd.array([None] * len(counted), "Int64"), sketch=None)

    return run


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def common_buckets(frequencies: np.ndarray) -> np.ndarray:
    """Marks buckets that far more documents hit than the average bucket: those of boilerplate."""
    return frequencies > 32 * frequencies.mean() + 32


@lru_cache(maxsize=8)
def _steps(percent: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest sizes of the size classes up to top; links join a class and the next at most."""
    low, high, at = [], [], 1
    while at <= top or len(low) < 2:
        low.append(at)
        high.append(at * 100 // percent)
        at = high[-1] + 1
    low.append(at)
    high.append(at * 100 // percent)
    return np.array(low), np.array(high)


def signatures(values: np.ndarray, bounds: np.ndarray, percent: int, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) rows; sets that link share a row's signature.

    Every set signs for its own size class and, where a partner can be that large, the next. Only
    rare shingles enter the parts: dropping the same shingles from all sets never adds a
    difference, and documents no longer meet in parts that hold nothing but boilerplate. Beyond
    the d + 1 parts there are spare ones, so that as many empty parts need not sign; a set
    with more empty parts than spare ones signs those too, and so does any partner it could
    only agree with there.
    """
    sizes = np.diff(bounds)
    low, high = _steps(percent, 1 << int(max(1, sizes.max(initial=1))).bit_length())
    own = np.searchsorted(low, sizes, "right") - 1
    out_set, out_sig = [], []
    element_set = np.repeat(np.arange(len(sizes)), sizes)
    hashed = mix(values ^ np.uint64(0xA0761D6478BD642F))
    for ahead in (0, 1):
        k = own + ahead
        used = (sizes > 0) & (100 * sizes >= percent * low[k]) if ahead else sizes > 0
        differ = 2 * high[k] * (100 - percent) // (100 + percent)
        spare = np.ceil(differ * SPARE).astype(np.int64)
        parts = np.where(used, differ + 1 + spare, 0)
        first = np.concatenate([[0], np.cumsum(parts)])
        mine = used[element_set] & rare
        s, h = element_set[mine], hashed[mine]
        cell = first[s] + ((h >> np.uint64(20)) % parts[s].astype(np.uint64)).astype(np.int64)
        total = int(first[-1])
        count = np.bincount(cell, minlength=total)
        lower = np.bincount(cell, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        upper = np.bincount(cell, (h >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(total) - first[owner]
        empty = np.bincount(owner[count == 0], minlength=len(sizes))
        signs = (count > 0) | (empty > spare)[owner]
        sig = mix(mix(lower + np.uint64(0x632BE59BD9B4E019) * upper) + (k[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))
        out_set.append(owner[signs])
        out_sig.append(sig[signs])
    return np.concatenate(out_set), np.concatenate(out_sig)


def _signature_rows(size: int, percent: int, common: Broadcast) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare = ~np.unpackbits(common.value).astype(bool)
        for pdf in batches:
            for _, values, bounds in _sets([(t,) for t in pdf["text"]], size):
                full = [(class_id(values[a:b]), a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
                once = list({c: (c, a, b) for c, a, b in full}.values())
                if once:
                    ends = np.cumsum([0, *(b - a for _, a, b in once)])
                    kept = np.concatenate([values[a:b] for _, a, b in once])
                    owner, sig = signatures(kept, ends, percent, rare[_bucket(kept)])
                    yield pd.DataFrame({"sig": sig.view(np.int64), "cid": np.array([c for c, _, _ in once], np.int64)[owner]})

    return run


def sketch(shingle_set: np.ndarray) -> bytes:
    """How many shingles fall in each of about an eighth as many buckets (one byte each, a power of two of them)."""
    length = max(LEAST_SKETCH, 1 << ((len(shingle_set) - 1) // 8).bit_length())
    at = (shingle_set & np.uint64(length - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=length), 255).astype(np.uint8).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of the least length among them; buckets fold onto each other."""
    length = min(map(len, sketches))
    return np.stack([np.frombuffer(s, np.uint8).reshape(-1, length).sum(axis=0, dtype=np.int32) for s in sketches])


def may_link(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets whose sketches differ by apart can link; sizes are the sums of their two sizes.

    Every shingle of just one set changes one bucket by one, and clipped or folded buckets
    differ less, so apart never exceeds the symmetric difference, which links bound from above.
    """
    return (100 + percent) * apart <= (100 - percent) * sizes


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by (sig, cid): the distinct ones of signatures that several classes have, with the first class."""
    held = None  # the last row, its signature's first class, and whether others came before it
    for pdf in batches:
        sig, cid = pdf["sig"].to_numpy(), pdf["cid"].to_numpy()
        if held:
            sig, cid = np.append(held[0], sig), np.append(held[1], cid)
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])
        sig, cid = sig[fresh], cid[fresh]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        at = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
        head, later = cid[at], ~first
        if held:
            head[at == 0], later[0] = held[2], held[3]
        met = later | np.append(~first[1:], False)
        met[-1] = False  # held back until the next row is known
        held = (sig[-1], cid[-1], head[-1], later[-1])
        yield pd.DataFrame({"sig": sig[met], "cid": cid[met], "head": head[met]})
    if held and held[3]:
        yield pd.DataFrame({"sig": [held[0]], "cid": [held[1]], "head": [held[2]]})


def _near_stars(percent: int) -> Callable:
    """Rows (a, b, with sizes and sketches) -> the edges a-b that the sketches do not refute."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            apart = np.zeros(len(pdf), np.int64)
            for i, pair in enumerate(zip(pdf["sketch_a"], pdf["sketch_b"], strict=True)):
                x, y = folded(pair)
                apart[i] = np.abs(x - y).sum()
            kept = may_link(apart, (pdf["size_a"] + pdf["size_b"]).to_numpy(np.int64), percent)
            yield pdf.loc[kept, ["a", "b"]]

    return run


def near_edges(piece: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all pieces of a group which chains of unrefuted pairs connect.

    Sets of one piece are not compared; the largest piece comes last, where it meets smaller ones only.
    """
    _, code, count = np.unique(piece, return_inverse=True, return_counts=True)
    order = np.lexsort((code, count[code]))
    piece, sizes, rows = piece[order], sizes[order], folded(sketches)[order]
    starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    ends = np.append(starts[1:], len(piece))
    found = [np.zeros((0, 2), np.int64)]
    for i in range(ends[-2] if len(ends) > 1 else 0):
        later = ends[np.searchsorted(ends, i, "right")]
        j = np.flatnonzero(may_link(np.abs(rows[later:] - rows[i]).sum(axis=1), sizes[later:] + sizes[i], percent)) + later
        found.append(np.stack([np.full(len(j), i), j], 1))
    pairs = np.concatenate(found)
    node, root = local_roots(piece[pairs[:, 0]], piece[pairs[:, 1]])
    return root[node != root], node[node != root]


def _near_groups(percent: int) -> Callable:
    """Of rows sorted by (gid, n, lo, hi): the edges between the pieces of each such group; one group is in memory at a time."""

    def edges(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        once = list({r[4]: r for r in group}.values())
        return near_edges(np.array([r[7] for r in once], np.int64), np.array([r[5] for r in once], np.int64), [r[6] for r in once], percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        for pdf in batches:
            done = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for r in pdf[["gid", "n", "lo", "hi", "cid", "size", "sketch", "piece"]].itertuples(index=False, name=None):
                if group and group[-1][:4] != r[:4]:
                    done.append(edges(group))
                    group = []
                group.append(r)
            a, b = map(np.concatenate, zip(*done, strict=True))
            yield pd.DataFrame({"a": a, "b": b})
        if group:
            a, b = edges(group)
            yield pd.DataFrame({"a": a, "b": b})

    return run


def _dealt(rows: DataFrame, count: str, block: int) -> DataFrame:
    """Rows (cid, ...) of groups of count rows, in tasks (lo, hi) with the row's own block: every two rows of a group meet in one."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    each = rows.withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return each.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")


def _regions(signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cid, gid): classes that chains of shared signatures and unrefuted sketches connect.

    Sharing a signature alone would chain documents with common passages into regions that grow
    with the corpus. First every class meets the head of each of its signatures; signatures that
    this leaves in several pieces, and that have more members than head and partner, are then
    compared sketch by sketch.
    """
    shared = written(signed.repartition("sig").sortWithinPartitions("sig", "cid").mapInPandas(_shared, "sig long, cid long, head long"), "shared")
    sketches = sets.groupBy("cid").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    stars = shared.where("head <> cid").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    sides = [sketches.withColumnsRenamed({"cid": end, "size": f"size_{end}", "sketch": f"sketch_{end}"}) for end in "ab"]
    released(signed.sparkSession)
    near = written(stars.join(sides[0], "a").join(sides[1], "b").mapInPandas(_near_stars(percent), "a long, b long"), "near")
    released(signed.sparkSession)

    pieces = connected_components(near).withColumnsRenamed({"node": "cid", "component": "piece"})
    placed = shared.join(pieces, "cid", "left").select("sig", "cid", F.coalesce("piece", "cid").alias("piece"))
    split = placed.groupBy("sig").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("members"))
    groups = split.where("lo <> hi and n > 2").select("sig", F.xxhash64("n", "members").alias("gid"), "n")
    members = placed.join(groups, "sig").select("gid", "n", "cid", "piece").distinct()  # many signatures have the same members
    tasks = _dealt(members.join(sketches, "cid"), "n", SKETCH_BLOCK)
    more = tasks.repartition("gid", "n", "lo", "hi").sortWithinPartitions("gid", "n", "lo", "hi").mapInPandas(_near_groups(percent), "a long, b long")
    merges = connected_components(more)
    regions = written(_merged(pieces, merges).withColumnsRenamed({"piece": "gid"}), "regions")
    for gone in (shared, near, pieces, merges):
        dropped(gone)
    released(signed.sparkSession)
    return regions


def _merged(pieces: DataFrame, merges: DataFrame) -> DataFrame:
    """(cid, piece) after the components of pieces in merges(node, component); single classes may be pieces of their own."""
    names = merges.withColumnsRenamed({"node": "piece", "component": "whole"})
    moved = evenly_joined(pieces, names, ["piece"], ["cid"]).select("cid", F.coalesce("whole", "piece").alias("piece"))
    single = merges.select(F.col("node").alias("cid"), F.col("component").alias("piece")).join(pieces.select("cid"), "cid", "left_anti")
    return moved.unionByName(single)


def distances(values: np.ndarray, bounds: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Jaccard distance of every set to pivot (sorted)."""
    at = np.minimum(np.searchsorted(pivot, values), len(pivot) - 1)
    hits = np.concatenate([[0], np.cumsum(pivot[at] == values)])
    common = hits[bounds[1:]] - hits[bounds[:-1]]
    return 1 - common / (np.diff(bounds) + len(pivot) - common)


def _compare(values: np.ndarray, bounds: np.ndarray, home: np.ndarray, percent: int) -> np.ndarray:
    """Linked pairs, at least one of them at home, by exact intersection sizes."""
    sizes = np.diff(bounds)
    _, code, df = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = df[code] > 1
    column = np.cumsum(df > 1) - 1
    code, owner = column[code[shared]], owner[shared]
    common = np.zeros((len(sizes), len(sizes)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    n = int(code[-1]) + 1 if len(code) else 0
    for first in range(0, n, 8192):
        a, b = np.searchsorted(code, [first, first + 8192])
        dense = np.zeros((len(sizes), min(8192, n - first)), np.float32)
        dense[owner[a:b], code[a:b] - first] = 1
        common += dense @ dense.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = np.triu((100 * common >= percent * union) & (home[:, None] | home[None, :]), 1)
    return np.argwhere(linked)


def region_pairs(values: np.ndarray, bounds: np.ndarray, percent: int, home: np.ndarray | None = None, seen: Counter | None = None) -> np.ndarray:
    """Index pairs of linked sets, each pair with a set at home found at least once.

    Voronoi cells around a few pivots, spread by farthest-first choice. If x and y link, then
    d(y, p) <= d(x, p) + e for x's pivot p, and y's own pivot q has d(x, q) >= d(x, p), hence
    d(y, p) - d(y, q) <= 2e: y is at home in x's cell or replicated into it. Of those only the ones are replicated
    whose distance to p is in the window of the distances at home, widened by e on both sides. Sets that share next to nothing with any
    pivot are no cell's: they are one of their own, whose window is over the distance to the nearest pivot. seen counts
    the cells, the sets at home in them and replicated into them, and the sets and pairs compared exactly.
    """
    n = len(bounds) - 1
    home = np.ones(n, bool) if home is None else home
    seen = Counter() if seen is None else seen
    if n > LEAF:
        reach = (100 - percent) / 100
        pivots, to = [0], []
        for _ in range(max(PIVOTS, math.isqrt(n))):
            p = pivots[-1]
            to.append(distances(values, bounds, values[bounds[p] : bounds[p + 1]]))
            pivots.append(int(np.argmax(np.min(to, axis=0))))
        to = np.stack(to)
        nearest, least = np.argmin(to, axis=0), to.min(axis=0)
        cells = []
        for k in range(-1, len(to)):
            inside = home & (least > CORE if k < 0 else (nearest == k) & (least <= CORE))  # a pair is found in the cell of its document at home
            if inside.any():
                d = least if k < 0 else to[k]
                low, high = d[inside].min() - reach - 1e-9, d[inside].max() + reach + 1e-9
                cells.append((inside, inside | ((d - least <= 2 * reach + 1e-9) & (d >= low) & (d <= high))))
        if sum(int(c.sum()) ** 2 for _, c in cells) < n * n:
            found = [np.zeros((0, 2), np.int64)]
            for inside, member in cells:
                cell = np.flatnonzero(member)
                seen.update(cells=1, home=int(inside.sum()), replicated=len(cell) - int(inside.sum()))
                ends = np.concatenate([[0], np.cumsum(np.diff(bounds)[cell])])
                flat = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in cell])
                found.append(cell[region_pairs(flat, ends, percent, inside[cell], seen)])
            return np.concatenate(found)
        seen.update(whole=1)  # no pivot separates these documents
    seen.update(compared=n, pairs=n * n)
    return _compare(values, bounds, home, percent)


def _join_region(percent: int) -> Callable:
    """Rows (cid, piece, home, shingles) of one task -> edges that join pieces as the links of sets at home do."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cid", "home"], ascending=[True, False]).drop_duplicates("cid")
        piece = pdf["piece"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        pairs = region_pairs(np.concatenate(sets), bounds, percent, pdf["home"].to_numpy(bool))
        node, root = local_roots(piece[pairs[:, 0]], piece[pairs[:, 1]])
        kept = node != root
        return pd.DataFrame({"a": root[kept], "b": node[kept]})

    return run


def _count_links(percent: int) -> Callable:
    """Rows (cid, n, own, shingles) of the task (lo, hi) -> (cid, links): how many documents of the other block, or of the one block, each links to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cid").reset_index(drop=True)
        sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        own, n = pdf["own"].to_numpy(), pdf["n"].to_numpy(np.int64)
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        pairs = np.unique(np.sort(region_pairs(np.concatenate(sets), bounds, percent, own == lo), axis=1), axis=0)
        pairs = pairs[(own[pairs[:, 0]] != own[pairs[:, 1]]) | (lo == hi)]
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, pairs[:, 0], n[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], n[pairs[:, 0]])
        return pd.DataFrame({"cid": pdf["cid"], "links": links})[links > 0]

    return run


def _block(count: str) -> Column:
    """The block of a class in a group of count classes."""
    return F.pmod(F.xxhash64("cid"), F.ceil(F.col(count) / BLOCK)).cast("int")


def _first_tasks(loaded: DataFrame) -> DataFrame:
    """Every block of a region with the region's block 0: rows and tasks grow as the region does."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    each = loaded.withColumn("lo", _block("members"))
    other = F.when((F.col("lo") == 0) & (blocks > 1), F.sequence(F.lit(1), F.greatest(blocks - 1, F.lit(1)))).otherwise(F.array("lo"))
    return each.select("gid", F.explode(other).alias("lo"), F.lit(0).alias("hi"), "cid", F.col("cid").alias("piece"), F.lit(True).alias("home"), "shingles")


def _rest_tasks(loaded: DataFrame) -> DataFrame:
    """Every block of the sets outside a region's largest piece with every block of the region."""
    blocks, strays = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("members", "strays"))
    at_home = loaded.where("piece <> main").withColumn("lo", _block("strays")).withColumn("hi", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("home", F.lit(True))
    visits = loaded.withColumn("hi", _block("members")).withColumn("lo", F.explode(F.sequence(F.lit(0), strays - 1))).withColumn("home", F.lit(False))
    columns = ["gid", "lo", "hi", "cid", "piece", "home", "shingles"]
    return at_home.select(columns).unionByName(visits.select(columns))


def _wanted_sets(size: int) -> Callable:
    """Rows (cid, doc_id, text) -> the shingles of texts whose class is the wanted one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates("cid")  # copies of a text under one doc_id
            for part, values, bounds in _sets(list(pdf.itertuples(index=False, name=None)), size):
                rows = [(*r[:-1], s.tobytes()) for r, s in zip(part, np.split(values, bounds[1:-1]), strict=True) if len(s) and class_id(s) == r[0]]
                yield pd.DataFrame(rows, columns=[*pdf.columns[:-1], "shingles"])

    return run


def _loaded(rows: DataFrame, wanted: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """wanted (cid, ...) with the shingles of each class, from one row of it: the one of its least doc_id and text digest."""
    rest = [f.name for f in wanted.schema.fields if f.name != "cid"]
    named = rows.select("doc_id", F.xxhash64("text").alias("digest"), "text").alias("t")
    reps = wanted.join(classes.select("cid", "doc_id", "digest"), "cid").alias("w")
    # rows without doc_id are told apart by their digest
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.digest") == F.col("w.digest"))
    texts = named.join(reps, same).select("cid", *rest, "text")
    return texts.mapInPandas(_wanted_sets(size), ", ".join(["cid long", *(f"{n} long" for n in rest), "shingles binary"]))


def _linked(rows: DataFrame, members: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(cid, root) of all members of regions, joined by exact comparison.

    First every block of a region meets one of its blocks, which already connects the bulk of a
    class of near copies. Sets still outside a region's largest piece then meet all of it; two
    sets of one piece need no comparison, so a large class costs no square of its size.
    """
    edges = "a long, b long"
    first = _first_tasks(_loaded(rows, members, classes, size)).groupBy("gid", "lo", "hi").applyInPandas(_join_region(percent), edges)
    bulk = connected_components(first)
    found = bulk.withColumnsRenamed({"node": "cid", "component": "piece"})
    pieces = written(members.join(found, "cid", "left").select("cid", "gid", "members", F.coalesce("piece", "cid").alias("piece")), "pieces")
    released(rows.sparkSession)
    counts = pieces.where(F.col("members") > 2 * BLOCK).groupBy("gid", "piece").agg(F.count("*").alias("n"))  # two blocks have met
    split = counts.groupBy("gid").agg(F.max_by("piece", F.struct("n", "piece")).alias("main"), (F.sum("n") - F.max("n")).alias("strays")).where("strays > 0")
    rest = _rest_tasks(_loaded(rows, evenly_joined(pieces, split, ["gid"], ["cid"], "inner"), classes, size)).groupBy("gid", "lo", "hi").applyInPandas(_join_region(percent), edges)
    strays = connected_components(rest)
    linked = written(_merged(pieces.select("cid", "piece"), strays).withColumnsRenamed({"piece": "root"}), "linked")
    for gone in (bulk, pieces, strays):
        dropped(gone)
    released(rows.sparkSession)
    return linked


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, links: bool = False) -> DataFrame:
    """Classes of documents linked, directly or through others, by Jaccard similarity >= percent / 100.

    Words are runs without ASCII white space, A-Z lowered; a document's set is its distinct
    size-word shingles, the whole sequence if it has fewer words. Null, empty and wordless texts have
    no shingles and link with nothing. Equal sets are one class from the start, so copies cost one row each.
    Returns one row per input row, repeated rows included: doc_id, n_shingles and component_id, the smallest
    doc_id of the class (nulls aside; null if there is no other). With links also n_links, the number of other
    rows linked directly; for that all blocks of a region meet, also those already known to be connected, which
    the classes alone do not need. Other columns are ignored.
    Shingles are compared by 64-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    strings = rows.select(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string").alias("digest"), "text")
    both = written(strings.mapInPandas(_classes(size), f"doc_id string, digest string, n_shingles long, cid long, sketch binary, {SCHEMA}"), "sets")
    sets = both.where("block is null").select(F.col("doc_id").cast("long"), F.col("digest").cast("long"), "n_shingles", "cid", "sketch")
    frequencies = collected(both.where("block is not null").select("model", "block", "counts"), 1, 1 << FREQUENCY_BITS)[0]
    common = docs.sparkSession.sparkContext.broadcast(np.packbits(common_buckets(frequencies)))  # one bit a bucket
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest")))
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.col("digest")))
    grouped = sets.where("cid is not null").groupBy("cid").agg(first.alias("first"), nameless.alias("nameless"), F.count("*").alias("n"))
    classes = written(grouped.select("cid", "first.doc_id", F.coalesce("first.digest", "nameless").alias("digest"), "n"), "classes")

    signed = rows.select("text").mapInPandas(_signature_rows(size, percent, common), "sig long, cid long")
    regions = _regions(signed, sets.where("cid is not null"), percent)

    members = written(evenly_joined(regions, regions.groupBy("gid").agg(F.count("*").alias("members")), ["gid"], ["cid"]), "members")
    linked = _linked(rows, members, classes, size, percent)
    heads = classes.join(linked, "cid", "left").select("cid", "doc_id", "n", F.coalesce("root", "cid").alias("root"), F.col("root").isNotNull().alias("many"))
    grouped = heads.where("many or n > 1")
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = evenly_joined(grouped, least, ["root"], ["cid"])
    if links:
        tasks = _dealt(_loaded(rows, members.join(classes.select("cid", "n"), "cid"), classes, size), "members", BLOCK)
        degrees = tasks.groupBy("gid", "lo", "hi").applyInPandas(_count_links(percent), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
        found = found.join(degrees, "cid", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("links", F.lit(0)))
    extra = ["n_links"] if links else []
    of_class = written(found.select("cid", "component_id", *extra), "set-classes")
    for gone in (regions, members, linked, classes):
        dropped(gone)
    rows_of_class = evenly_joined(sets.select("doc_id", "digest", "n_shingles", "cid"), of_class, ["cid"], ["doc_id", "digest"])
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in extra]
    return rows_of_class.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *counts)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_jaccard_join": op6_jaccard_join}
ORACLES: dict[str, str] = {
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
"""
}
