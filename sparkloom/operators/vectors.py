"""Vectors of vocabularies: cosine, sparsemax weights, weighted combination, restore by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sparsemax(scores: DataFrame, by: str, value: str) -> DataFrame:
    """Adds weight: the projection of the scores of each by onto the simplex; many become 0.

    Only scores over the largest less 1 can have weight, so those alone are gathered and sorted for each by.
    """
    top = scores.groupBy(by).agg(F.max(value).alias("_top"))
    near = scores.join(top, by).where(F.col(value) > F.col("_top") - 1).select(by, F.col(value).alias("_v"))
    # equal scores are one row with their number
    counted = near.groupBy(by, "_v").agg(F.count("*").alias("_n"))
    run = Window.partitionBy(by).orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_k", F.sum("_n").over(run)).withColumn("_sum", F.sum(F.col("_v") * F.col("_n")).over(run))
    support = ranked.where(1 + F.col("_k") * F.col("_v") > F.col("_sum"))
    tau = support.groupBy(by).agg(((F.max_by("_sum", "_k") - 1) / F.max("_k")).alias("_tau"))
    return scores.join(tau, by, "left").withColumn("weight", F.greatest(F.col(value) - F.col("_tau"), F.lit(0.0))).drop("_tau")


def initialised(tokens: DataFrame, source: DataFrame, seed: int, least: int = 1) -> DataFrame:
    """(token, vector) for tokens(token, n) seen fewer than least times: draws from the normal distribution of the source's components."""
    spread = source.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    first = source.select(F.size("vector").alias("n")).first()
    places = F.explode(F.sequence(F.lit(0), F.lit((first.n if first else 1) - 1)))
    drawn = tokens.where(F.col("n") < least).select("token", places.alias("pos")).join(spread, "pos").withColumn("x", F.col("mean") + F.col("std") * F.randn(seed))
    return drawn.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("vector"))


def combine(weights: DataFrame, vectors: DataFrame, by: str, key: str) -> DataFrame:
    """(by, pos, value): weighted sums of the vectors' components."""
    parts = weights.where("weight > 0").join(vectors, key).select(by, "weight", F.posexplode("vector").alias("pos", "x"))
    return parts.groupBy(by, "pos").agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("value"))


def restore(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target rows with the source's vector where the source has the token."""
    return target.alias("t").join(source.alias("s"), F.col("t.token") == F.col("s.token"), "left").select("t.token", F.coalesce("s.vector", "t.vector").alias("vector"), F.col("s.token").isNotNull().alias("restored"))


def restore_all(target: DataFrame, source: DataFrame) -> DataFrame:
    """restore(), after raising if the target lacks a token of the source."""
    missing = [r[0] for r in source.join(target, "token", "left_anti").select("token").orderBy("token").limit(3).collect()]
    if missing:
        raise ValueError(f"the target lacks tokens to restore, for instance {', '.join(missing)}")
    return restore(target, source)
