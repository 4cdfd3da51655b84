"""Near-duplicate vectors by an epsilon grid order join within equal labels.

Unit vectors with cosine >= c are at most e = sqrt(2 - 2c) apart, and so are their projections
on any orthonormal directions. The grid has cells of side e / 2 on the leading principal
directions; vectors sorted by label and cell form one long sequence, cut into partitions
and blocks with bounding boxes. Intervals of the sequence are joined recursively, and two
intervals whose boxes are over e apart are skipped.

What is skipped depends on how the variance falls from direction to direction: of 20,000 vectors of 64 dimensions
under one label, 60 % of the block pairs if it falls as 1 / i, 71 % if as i ** -1.5, but 2 % if it is the
same in all, where no bound on boxes separates the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, evenly_joined, table, written
from .components import connected_components, local_roots

#: Principal directions of the grid, cells a reach, vectors a block, vectors a partition on average, and vectors sampled to find the directions.
DIRECTIONS, FINE, BLOCK, PART, SAMPLE = 4, 2, 64, 4096, 4096
_SLACK = 1e-9


def usable(embedding: Column, label: Column) -> Column:
    """False for vectors that are null, zero or hold null or non-finite components, or have no label."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(embedding, lambda x: x == 0)
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & ~zero, F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the largest component first."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_directions(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Leading principal directions for each length of vectors, from a bounded sample.

    They only decide how well the grid separates; any orthonormal directions give the same links.
    """
    share = F.pmod(F.col("h1"), F.lit(1 << 30)).cast("double") < (1 << 30) * min(1.0, SAMPLE / max(1, n))
    by_length: dict[int, list] = {}
    for r in classes.where(share).select("embedding").limit(4 * SAMPLE).collect():
        by_length.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for dim, rows in by_length.items():
        u = unit(np.array(rows, np.float64))
        _, axes = np.linalg.eigh(np.cov(u.T).reshape(dim, dim) if len(u) > 1 else np.eye(dim))
        out[dim] = np.ascontiguousarray(axes[:, ::-1][:, :DIRECTIONS])
    return out


def _project(axes: dict[int, np.ndarray], reach: float) -> Callable:
    names = [f"x{k}" for k in range(DIRECTIONS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                u = unit(np.array(part["embedding"].tolist(), np.float64))
                flat = axes.get(dim, np.eye(dim)[:, :DIRECTIONS])
                x = np.zeros((len(u), DIRECTIONS))
                x[:, : flat.shape[1]] = u @ flat
                out = pd.DataFrame({"cid": part["cid"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "n": part["n"].to_numpy(), "vector": [r.tobytes() for r in u]})
                for k, name in enumerate(names):
                    out[name] = x[:, k]
                    out[f"c{k}"] = np.floor(x[:, k] * FINE / reach).astype(np.int64)
                yield out

    return run


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of at most BLOCK rows of the sequence with equal label and dim, numbered in its order, with their boxes."""
    seq = 0
    for pdf in batches:
        change = (pdf["label"].ne(pdf["label"].shift()) | pdf["dim"].ne(pdf["dim"].shift())).cumsum()
        place = pdf.groupby(change).cumcount() // BLOCK
        rows = []
        for _, part in pdf.groupby([change, place], sort=False):
            seq += 1
            row = {"seq": seq, "label": part["label"].iloc[0], "dim": part["dim"].iloc[0], "cids": part["cid"].to_numpy(np.int64).tobytes(), "ns": part["n"].to_numpy(np.int64).tobytes(), "vectors": b"".join(part["vector"])}
            for k in range(DIRECTIONS):
                row[f"lo{k}"], row[f"hi{k}"] = part[f"x{k}"].min(), part[f"x{k}"].max()
            rows.append(row)
        if rows:
            yield pd.DataFrame(rows)


def near_blocks(lo: np.ndarray, hi: np.ndarray, a: tuple[int, int], b: tuple[int, int], reach: float) -> Iterator[tuple[int, int]]:
    """Pairs of blocks, from the intervals a and b of a sequence, whose boxes are within reach.

    Recursive: intervals whose joint boxes are over reach apart are skipped whole; otherwise the longer
    one is halved. With a equal to b, each unordered pair comes once.
    """
    gap = np.maximum(0, np.maximum(lo[a[0] : a[1]].min(0) - hi[b[0] : b[1]].max(0), lo[b[0] : b[1]].min(0) - hi[a[0] : a[1]].max(0)))
    if (gap * gap).sum() > reach * reach + _SLACK:
        return
    na, nb = a[1] - a[0], b[1] - b[0]
    if na == 1 and nb == 1:
        yield a[0], b[0]
    elif a == b:
        mid = a[0] + na // 2
        left, right = (a[0], mid), (mid, a[1])
        for x, y in ((left, left), (left, right), (right, right)):
            yield from near_blocks(lo, hi, x, y, reach)
    else:
        whole, other, swap = (a, b, False) if na >= nb else (b, a, True)
        mid = (whole[0] + whole[1]) // 2
        for part in ((whole[0], mid), (mid, whole[1])):
            yield from near_blocks(lo, hi, *((other, part) if swap else (part, other)), reach)


def _join(cosine: float) -> Callable:
    reach = float(np.sqrt(2 - 2 * cosine))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "seq"], kind="stable")
        lo, hi = (pdf[[f"{w}{k}" for k in range(DIRECTIONS)]].to_numpy(np.float64) for w in ("lo", "hi"))
        dim, side = int(pdf["dim"].iloc[0]), pdf["side"].to_numpy()
        cids = [np.frombuffer(b, np.int64) for b in pdf["cids"]]
        counts = [np.frombuffer(b, np.int64) for b in pdf["ns"]]
        vectors = [np.frombuffer(b, np.float64).reshape(-1, dim) for b in pdf["vectors"]]
        degree = [np.zeros(len(c), np.int64) for c in cids]
        cut, n = int((side == 0).sum()), len(pdf)
        pairs = near_blocks(lo, hi, (0, cut), (0, cut), reach) if cut == n else near_blocks(lo, hi, (0, cut), (cut, n), reach)
        ends_a, ends_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in pairs:
            linked = vectors[i] @ vectors[j].T >= cosine
            if i == j:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            degree[i] += linked @ counts[j]
            if i != j:
                degree[j] += linked.T @ counts[i]
            # a few edges that connect what the block pair connects, instead of all its links
            x, y = np.nonzero(linked)
            node, root = local_roots(cids[i][x], cids[j][y])
            ends_a.append(root)
            ends_b.append(node)
        all_cids, all_degrees = np.concatenate(cids), np.concatenate(degree)
        node, root = local_roots(np.concatenate(ends_a), np.concatenate(ends_b))
        out = pd.DataFrame({"cid": all_cids, "degree": all_degrees}).query("degree > 0")
        return out.merge(pd.DataFrame({"cid": node, "root": root}), on="cid")[["cid", "degree", "root"]]

    return run


def similar_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Links between vectors of equal label with cosine >= the bound, as counts and components.

    Equal vectors of a label are one class that enters the join once. Vectors that are null, zero, or hold
    null or non-finite components, and rows without label, link with nothing; vectors of different lengths
    don't link. Returns one row per input row, repeated rows included: vec_id, n_links (other
    rows linked directly), component_id (smallest vec_id reachable, nulls aside) and kept
    (vec_id = component_id; null for a null vec_id). Other columns are ignored. A label's sequence is cut into
    partitions of about PART vectors, and a task compares two of them; copies of one vector, and the
    members of one component, however many, meet their result in no one task.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    good = usable(F.col("embedding"), F.col("label"))
    values = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(good, F.col("label").cast("string")).alias("label"), F.when(good, values).alias("embedding"))
    # + 0.0 makes negative zeros equal zeros; two hashes with different seeds stand for the vector
    plain = F.transform("embedding", lambda x: x + 0.0)
    keyed = rows.select("vec_id", "label", plain.alias("embedding")).withColumns({"h1": F.when(F.col("label").isNotNull(), F.xxhash64("label", "embedding")), "h2": F.when(F.col("label").isNotNull(), F.xxhash64(F.lit("second"), "embedding", "label"))})
    grouped = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "vectors")

    coordinates = ", ".join(f"x{k} double, c{k} long" for k in range(DIRECTIONS))
    size = classes.count()
    placed = classes.select("cid", "label", "n", "embedding").mapInPandas(_project(principal_directions(classes, size), reach), f"cid long, label string, dim int, n long, vector binary, {coordinates}")
    order = ["label", "dim", *[f"c{k}" for k in range(DIRECTIONS)], "cid"]
    boxes = ", ".join(f"lo{k} double, hi{k} double" for k in range(DIRECTIONS))
    sequence = placed.repartitionByRange(max(8, -(-size // PART)), *order).sortWithinPartitions(*order).mapInPandas(_blocks, f"seq long, label string, dim int, cids binary, ns binary, vectors binary, {boxes}")
    blocks = written(sequence.withColumn("part", F.spark_partition_id()), "blocks")

    extent = [f(f"{w}{k}").alias(f"{w}{k}") for k in range(DIRECTIONS) for w, f in (("lo", F.min), ("hi", F.max))]
    parts = blocks.groupBy("label", "dim", "part").agg(*extent)
    left, right = parts.alias("l"), parts.alias("r")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"l.lo{k}") - F.col(f"r.hi{k}"), F.col(f"r.lo{k}") - F.col(f"l.hi{k}")), 2) for k in range(DIRECTIONS)), F.lit(0.0))
    near = (F.col("l.label") == F.col("r.label")) & (F.col("l.dim") == F.col("r.dim")) & (F.col("l.part") <= F.col("r.part")) & (gap <= reach * reach + _SLACK)
    pairs = left.join(right, near).select(F.col("l.label"), F.col("l.dim"), F.col("l.part").alias("pa"), F.col("r.part").alias("pb"))
    first = blocks.join(pairs.withColumn("part", F.col("pa")), ["label", "dim", "part"]).withColumn("side", F.lit(0))
    second = blocks.join(pairs.where("pa < pb").withColumn("part", F.col("pb")), ["label", "dim", "part"]).withColumn("side", F.lit(1))
    found = written(first.unionByName(second).groupBy("label", "dim", "pa", "pb").applyInPandas(_join(cosine), "cid long, degree long, root long"), "links")

    degrees = found.groupBy("cid").agg(F.sum("degree").alias("degree"))
    pieces = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    components = pieces.withColumnsRenamed({"node": "cid", "component": "root"})
    full = classes.select("cid", "h1", "h2", "n", "least").join(degrees, "cid", "left").join(components, "cid", "left")
    full = full.select("h1", "h2", "least", (F.col("n") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    linked = full.where("n_links > 0")
    heads = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = written(evenly_joined(linked, heads, ["root"], ["h1"], "inner").select("h1", "h2", "n_links", "component_id"), "vector-classes")
    for gone in (classes, blocks, found, pieces):
        dropped(gone)
    out = evenly_joined(keyed.select("vec_id", "h1", "h2"), of_class, ["h1", "h2"], ["vec_id"])
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_embedding_join": op5_embedding_join}
ORACLES: dict[str, str] = {
    "op5_embedding_join": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id
"""
}
