"""Merkle manifest of a dataset: a tree a group, and a tree over the groups' roots.

A level is one window: nodes are partitioned by tree and parent index, and the ordered list of a run's digests is both
the preimage of the parent and, without the node itself, its siblings. One node of each run goes on as the parent. A window
holds one run, whatever the size of its group, and a tree of n leaves has log n levels to the base of the run length.
Paths come down again level by level, so a leaf gets its whole path from its parent in one join of narrow rows.

Digests are bytes between jobs and lowercase hexadecimal text where they are hashed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import indexed
from .common import dropped, table, written

#: Trees up to which the start of each one is broadcast; beyond, it is joined by its own key.
FEW = 100_000
#: Columns of a document that its leaf seals, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left: binary, right: binary>>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """A value with the number of its UTF-8 bytes ahead, so that no two rows give one preimage; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _level(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, at, digest, n) with their parent's index and digest, the digests left and right of them in the run, and the number of parents."""
    run = Window.partitionBy("tree", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = (F.col("at") % arity).cast("int")
    keyed = nodes.where("n > 1").withColumn("parent", F.floor(F.col("at") / F.lit(arity)).cast("long")).withColumn("kids", F.collect_list("digest").over(run))
    join = lambda part: F.aggregate(part, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    left, right = F.slice("kids", F.lit(1), before), F.slice("kids", before + 2, F.lit(arity))
    return keyed.select("tree", "at", "parent", "n", join(left).alias("left"), join(right).alias("right"), digest(hexed(join(F.col("kids")))).alias("above"))


class Tree:
    """The trees of nodes (tree, at, digest, n), n being the number of leaves of the tree; at runs from 0 to n - 1."""

    def __init__(self, nodes: DataFrame, arity: int):
        self.levels: list[DataFrame] = []
        most = nodes.agg(F.max("n")).first()[0] or 0
        self.roots = nodes.where("n = 1").select("tree", F.lit(0).alias("height"), "digest")
        while most > 1:
            level = written(_level(nodes, arity), "level", "zstd")
            self.levels.append(level)
            parents = F.ceil(F.col("n") / F.lit(arity)).cast("long")
            nodes = level.where(F.col("at") % arity == 0).select("tree", F.col("parent").alias("at"), F.col("above").alias("digest"), parents.alias("n"))
            self.roots = self.roots.unionByName(nodes.where("n = 1").select("tree", F.lit(len(self.levels)).alias("height"), "digest"))
            most = -(-most // arity)

    def paths(self, tops: DataFrame) -> DataFrame:
        """(tree, at, root of its tree, path) of every leaf; tops has the root of each tree (tree, root, height) and the path above it.

        A path is a list of steps from the leaf up, each with the digests left and right.
        """
        found = tops.where(F.col("height") == len(self.levels)).select("tree", F.lit(0).cast("long").alias("at"), "root", "path")
        for height in range(len(self.levels) - 1, -1, -1):
            above = found.withColumnRenamed("at", "parent")
            step = F.array(F.struct("left", "right"))
            below = self.levels[height].join(above, ["tree", "parent"]).select("tree", "at", "root", F.concat(step, "path").alias("path"))
            found = below.unionByName(tops.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("at"), "root", "path"))
        return found


def _grouped(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with tree (a number a group, rising with it), at (place in the group) and n (size of the group), written."""
    placed = indexed(rows, [group, *order], "place")
    groups = written(placed.groupBy(group).agg(F.min("place").alias("tree"), F.count("*").alias("n")).withColumnRenamed(group, "_group"), "groups")
    few = groups.count() <= FEW
    if few:
        found = placed.join(F.broadcast(groups), F.col(group).eqNullSafe(F.col("_group")))
    else:  # starts of runs of places, so that a large group is no key of many rows
        run = lambda c: F.floor(c / F.lit(1 << 16)).cast("long")
        spans = groups.select("tree", "n", F.explode(F.sequence(run(F.col("tree")), run(F.col("tree") + F.col("n") - 1))).alias("_run"))
        near = placed.withColumn("_run", run(F.col("place"))).join(spans, "_run")
        found = near.where((F.col("place") >= F.col("tree")) & (F.col("place") < F.col("tree") + F.col("n")))
    out = written(found.select(*rows.columns, "tree", (F.col("place") - F.col("tree")).alias("at"), "n"), "leaves", "zstd")
    dropped(placed)
    dropped(groups)
    return out


def folded(start: Column, path: Column) -> Column:
    """The root that start and the siblings of its path give."""
    return F.aggregate(path, start, lambda got, step: digest(F.concat(hexed(step["left"]), hexed(got), hexed(step["right"]))))


def manifest(rows: DataFrame, sealed: Column, changed: Column, key: str = "doc_id", group: str = "source", arity: int = 3) -> DataFrame:
    """A manifest of rows and the proof of each one.

    sealed and changed are expressions over rows: the leaf's digest when the manifest was made, and as it would be made now.
    Rows of a group ascend by key, null first; rows of one key by their leaf. Groups ascend bytewise, null first, and
    null is a group of its own. Repeated rows have a leaf each. No rows give no rows. The only column of rows carried on is key;
    texts are read once and leave digests.

    Returns key, leaf, subroot, root (bytes), path (steps up, each with the siblings left and right) and folded (the root from changed and
    the path).
    """
    spark = rows.sparkSession
    leaves = rows.select(F.col(key).alias("key"), F.col(group).alias("grp"), sealed.alias("digest"), changed.alias("changed"))
    numbered = _grouped(leaves, "grp", ["key", "digest"])
    low = Tree(numbered.select("tree", "at", "digest", "n"), arity)
    roots = written(low.roots, "subroots")
    # the tree numbers rise with the group; all of them are the leaves of one tree
    tops = written(indexed(roots, ["tree"], "at"), "tops")
    high = Tree(tops.select(F.lit(0).cast("long").alias("tree"), "at", "digest", F.lit(tops.count()).alias("n")), arity)
    root = high.roots.first()  # one row
    none = F.lit([]).cast(_STEP)
    start = spark.createDataFrame([] if root is None else [(0, root.height, bytearray(root.digest))], "tree long, height int, root binary").withColumn("path", none)
    whole = high.paths(start).select("at", "root", F.col("path"))
    heads = written(tops.join(whole, "at").select("tree", "height", F.col("digest").alias("root"), "path"), "heads")
    paths = low.paths(heads)
    out = numbered.join(paths, ["tree", "at"])
    everything = F.lit(None if root is None else bytes(root.digest)).cast("binary")
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), everything.alias("root"), "path", folded(F.col("changed"), F.col("path")).alias("folded"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = {c: F.col(c) for c in FIELDS}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, leaf(*values.values()), leaf(*(values | {"text": text}).values()))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")
    shown = [hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return found.select("doc_id", *shown, F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _sql() -> str:
    part = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(part(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    up = """SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY level, tree, pos // 3, n"""
    # crc32 of the decimal doc_id, bit by bit: only its lowest bit is used
    return f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS rid FROM documents),
bytes AS (SELECT rid, CAST(doc_id AS VARCHAR) AS s FROM d),
c AS (SELECT rid, s, 1 AS i, CAST(4294967295 AS BIGINT) AS r FROM bytes UNION ALL
SELECT rid, s, i + 1, list_reduce(list_prepend(xor(r, CAST(ascii(s[i]) AS BIGINT)), range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END) FROM c WHERE i <= length(s)),
crc AS (SELECT rid, xor(r, CAST(4294967295 AS BIGINT)) AS crc FROM c WHERE i = length(s) + 1),
l AS (SELECT rid, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
{leaf_of('text')} AS leaf, {leaf_of("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS changed FROM d LEFT JOIN crc USING (rid)),
t AS (SELECT 0 AS level, tree, pos, n, leaf AS h FROM l UNION ALL ({up.format(t='t')})),
subs AS (SELECT tree, level AS height, h AS subroot FROM t WHERE n = 1),
u AS (SELECT 0 AS level, 0 AS tree, tree AS pos, (SELECT count(*) FROM subs) AS n, subroot AS h FROM subs UNION ALL ({up.format(t='u')})),
nodes AS (SELECT level, tree, pos, h FROM t WHERE n > 1 UNION ALL SELECT level + 1000, -1, pos, h FROM u WHERE n > 1),
steps AS (SELECT l.rid, o.level, o.pos, o.h, l.pos // CAST(pow(3, o.level) AS BIGINT) AS mine FROM l JOIN nodes o ON o.tree = l.tree AND o.pos // 3 = l.pos // CAST(pow(3, o.level + 1) AS BIGINT)
UNION ALL SELECT l.rid, o.level, o.pos, o.h, l.tree // CAST(pow(3, o.level - 1000) AS BIGINT) FROM l JOIN nodes o ON o.tree = -1 AND o.pos // 3 = l.tree // CAST(pow(3, o.level - 999) AS BIGINT)),
proofs AS (SELECT rid, string_agg(h, '' ORDER BY level, pos) AS siblings FROM steps WHERE pos <> mine GROUP BY rid),
sides AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS k, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < mine), '') AS lft, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > mine), '') AS rgt FROM steps GROUP BY rid, level),
f AS (SELECT rid, 1 AS k, changed AS h FROM l UNION ALL SELECT f.rid, f.k + 1, sha256(lft || f.h || rgt) FROM f JOIN sides s ON s.rid = f.rid AND s.k = f.k),
top AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM l JOIN subs USING (tree) CROSS JOIN top LEFT JOIN proofs USING (rid) JOIN (SELECT rid, arg_max(h, k) AS h FROM f GROUP BY rid) f USING (rid)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_merkle": op12_merkle}
ORACLES: dict[str, str] = {"op12_merkle": _sql()}
