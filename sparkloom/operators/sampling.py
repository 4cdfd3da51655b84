"""Seeded, group-preserving sampling as prefix sums over an order of the groups."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group whose running totals one task computes.
RUN = 1 << 16
#: Separates the values of a group of several values in its name.
VALUES = "\x1f"
# Orders of groups. "hash" is distributed; "cpython" is that of Python's own generator, for parity.
ORDERS = ("hash", "cpython")


def hash_order(group: Column, seed: int) -> Column:
    """A seeded order that any engine reproduces: md5 of seed and group."""
    return F.md5(F.concat(F.lit(f"{seed}:"), group).cast("binary"))


def shuffled_ranks(groups: Sequence[tuple], seed: int) -> dict[tuple, int]:
    """The order of Python's own generator over groups sorted by their text as tuples."""
    order = sorted(groups, key=str)
    random.Random(seed).shuffle(order)
    return {g: i for i, g in enumerate(order)}


def with_order(groups: DataFrame, group: str, seed: int, order: str = "hash") -> DataFrame:
    """Adds ord, a string that sorts the distinct groups.

    The cpython order gathers the names of the groups in the driver, as that generator is sequential; the hash order does not.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, not {order!r}")
    if order == "hash":
        return groups.withColumn("ord", hash_order(F.col(group), seed))
    names = [r[0] for r in groups.select(group).distinct().collect()]
    ranks = shuffled_ranks([tuple(n.split(VALUES)) if n else () for n in names], seed)
    rows = [(n, f"{ranks[tuple(n.split(VALUES)) if n else ()]:012d}") for n in names]
    return groups.join(groups.sparkSession.createDataFrame(rows, f"`{group}` string, ord string"), group)


def prefix_before(df: DataFrame, size: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds the sum of size over all rows before this one, in two levels.

    bucket must rise with order, so that totals of buckets are summed first; no task then sees more
    than one bucket's rows or the list of buckets.
    """
    keyed = df.withColumn("_bucket", bucket)
    totals = keyed.groupBy("_bucket").agg(F.sum(size).alias("_total"))
    offsets = totals.select("_bucket", _sum_before("_total", Window.orderBy("_bucket")).alias("_offset"))
    inside = _sum_before(size, Window.partitionBy("_bucket").orderBy(*order))
    return keyed.withColumn(name, inside).join(offsets, "_bucket").withColumn(name, F.col(name) + F.col("_offset")).drop("_bucket", "_offset")


def _sum_before(size: str, window) -> Column:
    return F.coalesce(F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def group_totals(rows: DataFrame, group: str, size: str, seed: int, order: str = "hash") -> DataFrame:
    """(group, group_size, ord, before): size of each group and of all groups ahead of it in the order."""
    totals = with_order(rows.groupBy(group).agg(F.sum(size).alias("group_size")), group, seed, order)
    bucket = F.substring("ord", 1, 3) if order == "hash" else F.substring("ord", 1, 9)
    return prefix_before(totals, "group_size", ["ord", group], bucket, "before")


def target_of(size: float, rows: DataFrame, size_column: str, amount: bool, rounding: str = "even") -> DataFrame:
    """One row: size itself if it is an amount, of the rows' total the fraction if under 1, else the whole number.

    The fraction is rounded to the next whole number, half to even, or with rounding "up" to the one above.
    """
    if rounding not in ("even", "up"):
        raise ValueError(f"rounding must be even or up, not {rounding!r}")
    if not amount and size < 1:
        part = F.coalesce(F.sum(size_column), F.lit(0)).cast("double") * size
        return rows.agg((F.bround(part) if rounding == "even" else F.ceil(part).cast("double")).alias("target"))
    return rows.sparkSession.range(1).select(F.lit(float(size) if amount else float(int(size))).alias("target"))


def sample_groups(rows: DataFrame, group: str, size: float, seed: int, size_column: str = "unit", amount: bool = False, order: str = "hash", rounding: str = "even") -> DataFrame:
    """Groups taken whole, in seeded order, while the total so far is under the target; overshoots by a group at most.

    A size of 0 takes none. With amount, size is the target in units of size_column, also under 1; else a size
    under 1 is a fraction of the total. Units are whole numbers, as sums of fractions depend on their order.
    """
    if not size:
        return rows.select(group).limit(0)
    return group_totals(rows, group, size_column, seed, order).join(F.broadcast(target_of(size, rows, size_column, amount, rounding))).where("before < target").select(group)


def fill_to_budget(rows: DataFrame, group: str, index: str, budget: DataFrame, seed: int, size_column: str = "unit", order: str = "hash") -> DataFrame:
    """Rows in (group order, index) while the total so far is under the budget (one row, column budget).

    The last group may stay partial; overshoots by a row at most. A large group is summed and
    joined in runs of RUN indices, so it gathers in no task.
    """
    ahead = group_totals(rows, group, size_column, seed, order).join(F.broadcast(budget)).where("before < budget").select(group, "before", "budget")
    keyed = rows.withColumn("_run", F.floor(F.col(index) / RUN))
    runs = keyed.groupBy(group, "_run").agg(F.sum(size_column).alias("_total"))
    offset = _sum_before("_total", Window.partitionBy(group).orderBy("_run"))
    starts = runs.select(group, "_run", offset.alias("_offset")).join(ahead, group).select(group, "_run", (F.col("before") + F.col("_offset")).alias("_start"), "budget")
    inside = _sum_before(size_column, Window.partitionBy(group, "_run").orderBy(index))
    return keyed.withColumn("_inside", inside).join(starts, [group, "_run"]).where("_start + _inside < budget").select(*rows.columns)


class Cut:
    """Where a draw in the order of groups ends, as a predicate of single rows.

    What is drawn are all groups before one group, that one whole or up to an index. So a draw is one small row in
    the driver, and rows are told apart where they are read, without a join or a shuffle. In the cpython order
    the ranks of the groups are joined instead.
    """

    def __init__(self, rows: DataFrame, group: str, seed: int, order: str, size_column: str, target: DataFrame, index: str | None = None):
        self.group, self.seed, self.order, self.index, self.last = group, seed, order, index, None
        self.ranks = with_order(rows.select(group).distinct(), group, seed, order) if order != "hash" else None
        totals = group_totals(rows, group, size_column, seed, order).join(F.broadcast(target)).where("before < target")
        self.end = totals.agg(F.max(F.struct("ord", group, "before", "target")).alias("end")).first().end
        if self.end is not None and index:
            inside = prefix_before(rows.where(F.col(group) == self.end[group]), size_column, [index], F.floor(F.col(index) / RUN), "inside")
            self.last = inside.where(F.col("inside") < self.end.target - self.end.before).agg(F.max(index)).first()[0]

    def mark(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with the column name: whether the row is drawn. Only rows of the kind the draw was made from are told rightly."""
        if self.end is None:
            return rows.withColumn(name, F.lit(False))
        rank = hash_order(F.col(self.group), self.seed) if self.ranks is None else F.col("ord")
        rows = rows if self.ranks is None else rows.join(self.ranks, self.group, "left")
        whole = (rank < self.end.ord) | ((rank == self.end.ord) & (F.col(self.group) < self.end[self.group]))
        last = (rank == self.end.ord) & (F.col(self.group) == self.end[self.group])
        last = last & (F.col(self.index) <= self.last) if self.index else last
        return rows.withColumn(name, F.coalesce(whole | last, F.lit(False))).drop("ord")


def group_cut(rows: DataFrame, group: str, size: float, seed: int, size_column: str, amount: bool = False, order: str = "hash") -> Cut:
    """sample_groups() as a Cut."""
    target = target_of(size, rows, size_column, amount) if size else rows.sparkSession.range(1).select(F.lit(0.0).alias("target"))
    return Cut(rows, group, seed, order, size_column, target)


def budget_cut(rows: DataFrame, group: str, index: str, budget: float, seed: int, size_column: str, order: str = "hash") -> Cut:
    """fill_to_budget() as a Cut."""
    return Cut(rows, group, seed, order, size_column, rows.sparkSession.range(1).select(F.lit(float(budget)).alias("target")), index)


def sample_rows(rows: DataFrame, index: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, those first in the hash order of index; all if there are fewer. Sort by index for their old order."""
    ordered = rows.withColumn("_ord", hash_order(F.col(index).cast("string"), seed))
    return ordered.orderBy("_ord", index).limit(n).drop("_ord")
