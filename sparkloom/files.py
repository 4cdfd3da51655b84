"""Small files and folders on any file system that Spark reaches, by way of Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _at(spark, path)
    return fs.exists(jpath)


def folders(spark: SparkSession, path: str) -> set[str]:
    """The names of the folders in path; FileNotFoundError if there is no path."""
    fs, jpath = _at(spark, path)
    if not fs.exists(jpath):
        raise FileNotFoundError(path)
    return {s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()}


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _at(spark, path)
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place and renamed, so that no reader sees a part of it."""
    fs, jpath = _at(spark, path)
    _, partial = _at(spark, f"{path}.partial")
    stream = fs.create(partial, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(jpath, False)
    if not fs.rename(partial, jpath):
        raise OSError(f"can't rename to {path}")


def delete(spark: SparkSession, path: str) -> bool:
    fs, jpath = _at(spark, path)
    return fs.delete(jpath, True)


def rename(spark: SparkSession, path: str, target: str) -> bool:
    """False if nothing is there or the target exists."""
    fs, jpath = _at(spark, path)
    _, other = _at(spark, target)
    return fs.exists(jpath) and not fs.exists(other) and fs.rename(jpath, other)


def copy(spark: SparkSession, path: str, target: str) -> None:
    fs, jpath = _at(spark, path)
    other_fs, other = _at(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, jpath, other_fs, other, False, spark.sparkContext._jsc.hadoopConfiguration())
