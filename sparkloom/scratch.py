"""Tables in the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .files import delete


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only where that setting is absent, and Spark runs in one process, a temporary folder is set instead.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='loom-')}"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


#: Whether Spark deletes the files of a query's shuffles when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside leave no shuffle files behind; a plan that runs again computes its shuffles again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, evaluated once; the files of its shuffles are deleted with the end of the job."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that no later plan reads; other tables are left alone."""
    path = getattr(df, "_loom_path", None)
    if path:
        delete(df.sparkSession, path)
