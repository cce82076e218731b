"""Stored intermediates of one run, in the shared folder the session names, and their clean-up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from staylens.runtime import checkpoint_root, materialize


class Scratch:
    """A folder for the tables of one operator call.

    ``put`` writes a table and reads it back, which cuts lineage and outlives executors. ``drop`` deletes one that
    nothing reads any more. What the returned result still reads stays, under the folder's retention rule.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        out = materialize(df, path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
