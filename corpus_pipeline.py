"""A corpus pipeline of four stages over documents; each stage's table feeds the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import jaccard_join, packing, secrets, toxicity
from sparkloom.llm.common import dropped, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic.

    Without usable labels of both classes nothing is known to be toxic and every document stays. A null text is
    scored as an empty one; a row without doc_id is scored like any other but never trains; each of
    several equal rows is kept or dropped like the others; no rows give none.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not model.informed:
        return docs.select(*COLUMNS)
    score = toxicity.scorer(spark, model)
    scored = docs.select(*COLUMNS, score(F.coalesce("text", F.lit(""))).alias("toxic_score"))
    return scored.where("toxic_score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class linked by shingles of five words at a similarity of 0.8: one with the smallest doc_id, null last.

    Rows are told apart by a number of their own, written with them, so doc_id may repeat or be null. Rows whose text is
    null, empty or without words link with nothing and all stay; no rows give none.
    """
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_id")), "rows", "zstd")
    classes = jaccard_join.jaccard_components(rows.select(F.col("row_id").alias("doc_id"), "text"), size=5, percent=80)
    classes = classes.select(F.col("doc_id").alias("row_id"), F.col("component_id").alias("class_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    kept = rows.select("row_id", "doc_id").join(classes, "row_id").groupBy("class_id").agg(F.min(order)["row_id"].alias("row_id"))
    return rows.join(kept, "row_id", "left_semi").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with live-looking credentials masked in its text and widely copied examples left.

    n_chars is counted anew. Every row stays, repeated ones and those without text or doc_id included; no rows
    give none.
    """
    return secrets.mask_live(docs, F.col("source"), F.concat_ws("/", "source", "lang")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their bins.

    A document without text is one piece of its end mark; repeated rows are packed each; no rows give none.
    """
    return packing.pack(docs, packing.public_tokens())


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]

#: The classifier and the packing are beyond SQL; tests/llm/test_pipeline.py compares every stage and run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other; a stage's table is deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(docs)
        docs = after
    return docs
