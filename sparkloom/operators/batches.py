"""Length-grouped batches: examples of like length together, in a seeded order, without sorting the whole corpus by length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import hash_order


def length_batches(rows: DataFrame, index: str, length: str, size: int, seed: int, mega: int = 50) -> DataFrame:
    """(index, length, batch, place): batches of size examples, the last one maybe smaller.

    The seeded hash order of index is cut into runs of size * mega examples; a run is sorted by length, longest
    first, and cut into batches. So lengths in a batch are alike, and batches come in a random order as far as runs go. No task
    sorts more than a run, and the order of the corpus is one range partitioning by hash. Null lengths count as 0; index must tell rows apart.
    """
    from ..sources import indexed

    if size < 1 or mega < 1:
        raise ValueError("size and mega are at least 1")
    named = rows.select(F.col(index).alias("_index"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("_length"))
    placed = indexed(named.withColumn("_hash", hash_order(F.col("_index").cast("string"), seed)), ["_hash", "_index"], "_place")
    run = F.floor(F.col("_place") / F.lit(size * mega))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy(F.col("_length").desc(), "_place")) - 1
    sorted_ = placed.withColumn("_run", run).withColumn("_at", inside)
    batch = F.col("_run") * mega + F.floor(F.col("_at") / F.lit(size))
    return sorted_.select(F.col("_index").alias(index), F.col("_length").alias(length), batch.cast("long").alias("batch"), (F.col("_at") % size).cast("int").alias("place"))


def padding(batches: DataFrame, length: str) -> DataFrame:
    """One row: batches, examples, units (sum of lengths) and padded (units after each batch is padded to its longest)."""
    each = batches.groupBy("batch").agg(F.count("*").alias("n"), F.sum(length).alias("units"), F.max(length).alias("longest"))
    return each.agg(F.count("*").alias("batches"), F.sum("n").alias("examples"), F.sum("units").alias("units"), F.sum(F.col("n") * F.col("longest")).alias("padded"))
