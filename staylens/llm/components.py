"""Distributed union-find: smallest id of each connected component from a table of links.

Alternating stars: every node with larger neighbours hands them to the smallest node it knows, then every node links
itself and its smaller neighbours to the smallest one. Each step is a grouped minimum, which is combined before the
shuffle, and a join that skew handling may split. Every round's links are stored. Rounds grow with the logarithm of the
number of nodes; links, components and nodes are never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.stored import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """``links`` holds (u, v) with u > v; both directions matter here."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = links.select(F.col("v").alias("node"), F.col("u").alias("big"))
    joined = up.join(least.withColumnRenamed("u", "node"), "node").select(F.col("big").alias("u"), F.col("m").alias("v"))
    return joined.where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u > v")
        .distinct()
    )


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node that has a link to another; ``links`` has two columns of one integer type.

    Nulls and links of a node to itself are left out. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    now = scratch.put(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        nxt = scratch.put(_small_star(_large_star(now)))
        scratch.drop(now)
        now = nxt
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_if(F.col("u").isNull())
        ).first()
        # Links that no longer change point from every node straight to the smallest of its component.
        if state == seen or not state[0]:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
