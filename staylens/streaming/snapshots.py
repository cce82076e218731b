"""Snapshot files read as a stream; the row-local cleaning steps apply to it unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from staylens.functions.clean import file_date
from staylens.sources.files import CSV_OPTIONS, with_source


def stream_snapshots(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*listings*") -> DataFrame:
    """Files of one layout as they arrive in a folder, with source and snapshot date."""
    reader = spark.readStream.options(**CSV_OPTIONS).option("pathGlobFilter", pattern).schema(schema)
    return with_source(reader.csv(folder)).withColumn("filedate", file_date("source_file"))
