"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated export of a small summary, as a single file."""
    df.coalesce(1).write.mode(mode).options(header=True, sep="\t").csv(path)


def write_snapshots(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by snapshot date, so a later read of one date touches only its files."""
    df.write.mode(mode).partitionBy("filedate").parquet(path)
