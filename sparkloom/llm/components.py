"""Connected components of an edge table by repeated contraction.

Each round maps every node to the first node, in a random order, among itself and its neighbours and replaces
the edges by the edges between those images. The node maps are kept as tables and chained at
the end, so nothing about single nodes reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FREQUENT_ROWS, FREQUENT_SHARE, dropped, evenly_joined, written
from .ngrams import mix, unmix


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b, and for each the smallest node of its component."""
    nodes, pos = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = pos[: len(a)], pos[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            return nodes, nodes[root]
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def shuffled(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of signed 64-bit numbers, another one for each seed."""
    return mix(x.view(np.uint64) ^ mix(np.array([seed], np.uint64))).view(np.int64)


def restored(x: np.ndarray, seed: int) -> np.ndarray:
    return (unmix(x.view(np.uint64)) ^ mix(np.array([seed], np.uint64))).view(np.int64)


def _stars(old: int | None, seed: int) -> Callable:
    """Edges (a, b) whose ends are shuffled by the seed old, if any -> stars with the same pieces, shuffled by seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (shuffled(pdf[c].to_numpy(np.int64) if old is None else restored(pdf[c].to_numpy(np.int64), old), seed) for c in "ab")
            nodes, roots = local_roots(a, b)
            kept = nodes != roots
            yield pd.DataFrame({"a": roots[kept], "b": nodes[kept]})

    return run


def _plain(seed: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": restored(pdf["node"].to_numpy(np.int64), seed), "to": restored(pdf["to"].to_numpy(np.int64), seed)})

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is one node of the component, the same for all.

    Self-loops, repeated and reversed edges are harmless; null ends are dropped; no edges give
    an empty table. In every round the nodes are put in a new random order, and each goes over to the first among
    itself and its neighbours. Whatever the graph and the names of its nodes, a round leaves two thirds of the
    nodes that still have edges at most on average (randomised contraction), so rounds grow with the
    logarithm of the nodes. Nodes with many edges are joined apart, so hubs gather in no task.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = written(edges.mapInPandas(_stars(None, 0), "a long, b long").distinct(), "edges")
    maps: list[DataFrame] = []
    while not now.isEmpty():
        first = F.least("a", "b").alias("to")
        ends = now.select(F.col("a").alias("node"), first).unionByName(now.select(F.col("b").alias("node"), first))
        step = written(ends.groupBy("node").agg(F.min("to").alias("to"), F.count("*").alias("degree")), "map")
        maps.append(step)
        total = F.broadcast(step.agg(F.sum("degree").alias("total")))
        hubs = step.join(total).where((F.col("degree") > FREQUENT_ROWS) & (F.col("degree") * FREQUENT_SHARE > F.col("total"))).select("node")
        both = now
        for end, image in (("a", "ra"), ("b", "rb")):
            both = evenly_joined(both, step.select(F.col("node").alias(end), F.col("to").alias(image)), [end], ["a", "b"], "inner", hubs.withColumnRenamed("node", end))
        moved = both.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        after = written(moved.mapInPandas(_stars(len(maps) - 1, len(maps)), "a long, b long").distinct(), "edges")
        dropped(now)
        now = after
    if not maps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    dropped(now)
    plain = [step.select("node", "to").mapInPandas(_plain(seed), "node long, to long") for seed, step in enumerate(maps)]
    out = plain[-1].withColumnsRenamed({"to": "component"})
    for step in reversed(plain[:-1]):
        later = out.withColumnsRenamed({"node": "to", "component": "c2"})
        out = evenly_joined(step, later, ["to"], ["node"]).select("node", F.coalesce("c2", "to").alias("component"))
    result = written(out, "components")
    for step in maps:
        dropped(step)
    return result
