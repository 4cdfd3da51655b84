"""Shared helpers: text input, shared scratch tables, batch iteration."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import dropped, scratch_dir, written

__all__ = ["dropped", "scratch_dir", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """The text with null read as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def released(spark: SparkSession) -> None:
    """Lets the driver collect its garbage, Python's and the JVM's: a join of many jobs otherwise fills its heap with plans and metrics of the ones that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def chunks(items: list, weight, limit: int) -> Iterator[list]:
    """Consecutive runs of items whose weights add up to limit, or single heavier items."""
    run, total = [], 0
    for item in items:
        w = weight(item)
        if run and total + w > limit:
            yield run
            run, total = [], 0
        run.append(item)
        total += w
    if run:
        yield run


def per_text(text: Column, schema: str, build: Callable[[], Callable[[list[str]], pd.DataFrame]], limit: int) -> Column:
    """A struct column computed from texts in Arrow batches.

    build runs once a task and gives a function from a list of texts to a row for each; it
    gets about limit characters at a time. All other columns of the rows stay in the JVM.
    """

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compute = build()
        for texts in batches:
            yield pd.concat([compute(part) for part in chunks(texts.tolist(), len, limit)] or [compute([])], ignore_index=True)

    return run(text)


def with_texts(docs: DataFrame, keys: list[str | Column], result: Column) -> DataFrame:
    """The keys and the fields of result for every row."""
    return docs.select(*keys, result.alias("r")).select("*", "r.*").drop("r")


#: A key is frequent if it holds more than one in this many rows, and more than this many rows.
FREQUENT_SHARE, FREQUENT_ROWS = 1000, 128


def frequent(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold over a thousandth of the rows of df each: fewer than FREQUENT_SHARE rows, whatever its size."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.join(F.broadcast(total)).where((F.col("_n") > FREQUENT_ROWS) & (F.col("_n") * FREQUENT_SHARE > F.col("_total"))).select(*keys)


def evenly_joined(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has one row a key, so that no key gathers more than about a thousandth of left in one task.

    Rows of frequent keys meet their partner in a broadcast of fewer than FREQUENT_SHARE rows; the
    others are joined by key, and the frequent ones are dealt there by the columns spread. hot are the
    frequent keys, if the caller knows them. how is left or inner; null keys find nothing.
    """
    rest = [c for c in right.columns if c not in keys]
    hot = frequent(left, keys) if hot is None else hot
    few = right.join(F.broadcast(hot), keys, "left_semi").select(*keys, F.struct(*rest).alias("_hot"))
    marked = left.join(F.broadcast(few), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).cast("long"))
    plain = right.select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*rest).alias("_rest"))
    both = marked.join(plain, [*keys, "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_rest"))
    if how == "inner":
        both = both.where("_got is not null")
    return both.select(*left.columns, *[F.col("_got")[c].alias(c) for c in rest])
