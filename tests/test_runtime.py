"""Stored intermediates and what they leave behind."""

import time

from pyspark.sql import functions as F

from staylens.runtime import SHUFFLE_CLEANUP, materialize


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_of_a_write_go(spark):
    before, switch = _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    out = materialize(rows)
    end = time.time() + 30
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == switch
    # the same plan can be run again, and cached rows are not touched
    kept = rows.cache()
    assert materialize(kept).count() == 100 and kept.agg(F.sum("s")).first()[0] == out.agg(F.sum("s")).first()[0] == 49_995_000
    kept.unpersist()
