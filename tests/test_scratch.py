"""Tables of the scratch folder."""

from pathlib import Path

from pyspark.sql import functions as F

from sparkloom import scratch


def test_written_leaves_no_shuffle_files(spark):
    """Shuffle files of the job go with its end; those of other queries stay, and the setting is put back."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [Path(str(f)) for f in manager.localDirsString()]
    files = lambda: {p for d in folders for p in d.rglob("shuffle_*")}
    before, kept = files(), spark.conf.get(scratch.CLEANUP)
    df = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))
    df.write.format("noop").mode("overwrite").save()
    other = files()
    assert other - before  # what a plain query leaves
    table = scratch.written(df.join(df.withColumnRenamed("s", "t"), "k"))
    assert not files() - other and table.count() == 1000 and spark.conf.get(scratch.CLEANUP) == kept
    path = Path(table._loom_path.removeprefix("file:"))
    assert path.exists()
    scratch.dropped(table)
    assert not path.exists()
    scratch.dropped(df)  # not one of its tables: nothing happens
