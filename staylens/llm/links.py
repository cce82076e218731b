"""From shared keys to components of truly linked items, without all pairs of a group.

Items that share a key may be linked; a verifier tells. A first round holds each item of a key only against the smallest
item of that key, beginning with the one it shares most keys with, the next ones against the next smallest. What turns out to be one component needs no further look,
however large the group is. Only items of one key that are in different components after these rounds are still open:
they are taken pair by pair, which skew handling may split. So no link between two items that share a key is missed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.components import components
from staylens.llm.stored import Scratch

Verify = Callable[[DataFrame], DataFrame]
# Keys that are dealt with apart because a large part of all rows has them; bounds what is broadcast.
HOT_KEYS = 4096
# Share of the rows that tells them, and how many of it a key must have.
HOT_SHARE, HOT_ROWS = 64, 32
# Pairs of open items, for each open item, up to which all are compared.
PAIRS_A_ROW = 16


def _stars(on: list[str]):
    """Over rows sorted by key and item: each item with the smallest one of its key, batch after batch."""

    def over(batches):
        last_key, hub, last_item = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(on))]
            item = batch.column(len(on)).to_numpy(zero_copy_only=False)
            fresh = np.zeros(n, bool)
            for k in keys:
                fresh[1:] |= k[1:] != k[:-1]
            first = tuple(k[0] for k in keys)
            fresh[0] = last_key is None or first != last_key
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            lo = np.where(start >= 0, item[np.maximum(start, 0)], hub)
            again = np.zeros(n, bool)
            again[1:] = (item[1:] == item[:-1]) & ~fresh[1:]
            again[0] = not fresh[0] and item[0] == last_item
            keep = (item != lo) & ~again
            last_key, hub, last_item = tuple(k[-1] for k in keys), lo[-1], item[-1]
            if keep.any():
                mask = pa.array(keep)
                columns = [batch.column(i).filter(mask) for i in range(len(on))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lo[keep]), pa.array(item[keep])], names=[*on, "lo", "item"])

    return over


def star_members(marks: DataFrame, on: list[str], sample: DataFrame, scratch: Scratch) -> DataFrame:
    """(``on``, lo, item): every item of a key but the smallest, with the smallest; keys of one item are left out.

    ``marks`` has columns ``on`` and ``item``. ``sample`` holds about one of HOT_SHARE of its rows and only tells which
    keys are hot: those meet a broadcast of their smallest items, all others are dealt out by key and sorted.
    """
    hot = scratch.put(
        sample.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS).select(*on)
    )
    kinds = ", ".join(f"`{c}` {marks.schema[c].dataType.simpleString()}" for c in [*on, "item"])
    kinds = kinds.replace("`item`", "lo long, item")
    cold, parts = marks.select(*on, "item"), []
    if not hot.isEmpty():
        cold = cold.join(F.broadcast(hot), on, "left_anti")
        ours = marks.select(*on, "item").join(F.broadcast(hot), on)
        least = ours.groupBy(*on).agg(F.min("item").alias("lo"))
        parts = [ours.join(F.broadcast(least), on).where("item > lo").select(*on, "lo", "item").distinct()]
    dealt = cold.repartition(*on).sortWithinPartitions(*on, "item")
    out = dealt.mapInArrow(_stars(on), kinds)
    for p in parts:
        out = out.unionByName(p)
    return scratch.put(out)


def _with_more(links: DataFrame, found: DataFrame, more: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links and their components, with further links."""
    if more.isEmpty():
        return links, found
    tree = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return links.unionByName(more), scratch.put(components(tree.unionByName(more), scratch))


def linked_components(
    members: DataFrame, on: list[str], verify: Verify, scratch: Scratch, sketches: DataFrame, may_link: Callable[[Column, Column], Column], rounds: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(verified links, (node, component) of all linked items) from ``star_members``.

    ``verify`` keeps the true links of a table (a, b) with a < b. ``sketches`` has for each item a small ``sketch``, and
    ``may_link`` is false for two sketches only if their items cannot be linked; it is tested within the joins.
    """
    of_a, of_b = (sketches.select(F.col("item").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    star = members.groupBy(F.col("lo").alias("a"), F.col("item").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    star = scratch.put(star.join(of_a, "a").join(of_b, "b").where(may_link(F.col("sa"), F.col("sb"))).select("a", "b", "n"))
    # An item meets the one it shares most keys with first; near copies are then one component before their other pairs are looked at.
    closest = star.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    links = scratch.put(verify(closest))
    found = scratch.put(components(links, scratch))
    apart = star.select("a", "b").join(closest, ["a", "b"], "left_anti")
    for x in "ab":
        apart = apart.join(found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links, found = _with_more(links, found, scratch.put(verify(apart)), scratch)
    scratch.drop(star)

    # ``lo`` is the last item of a key that was held against all others.
    todo = members.select(*on, "lo", "item")
    hubs = members.groupBy(*on).agg(F.min("lo").alias("lo")).withColumn("item", F.col("lo"))
    todo = todo.unionByName(hubs)
    for turn in range(rounds + 1):
        own = found.select(F.col("node").alias("item"), "component")
        known = todo.join(own, "item", "left").withColumn("component", F.coalesce("component", "item"))
        mixed = known.groupBy(*on).agg(
            F.min("component").alias("least"), F.max("component").alias("most"), F.min(F.when(F.col("item") > F.col("lo"), F.col("item"))).alias("next")
        )
        mixed = mixed.where("least < most and next is not null").select(*on, "next")
        opened = scratch.put(known.join(mixed, on).join(sketches, "item").select(*on, "lo", "next", "item", "component", "sketch"))
        # Small keys, as most are, are taken pair by pair at once: that is cheaper than a round.
        n = F.col("n")
        rows, pairs = opened.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n), F.sum(n * (n - 1) / 2)).first()
        if not rows:
            break
        last = turn == rounds or pairs <= PAIRS_A_ROW * rows
        left, right = (
            opened.where("item > lo").select(*[F.col(c).alias(f"{c}_{x}") for c in on], F.col("item").alias(x), F.col("component").alias(f"c{x}"), F.col("sketch").alias(f"s{x}"))
            for x in "ab"
        )
        if not last:
            left = opened.where("item = next").select(*[F.col(c).alias(f"{c}_a") for c in on], F.col("item").alias("a"), F.col("component").alias("ca"), F.col("sketch").alias("sa"))
        same = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in on]
        rest = left.join(right, [*same, F.col("a") < F.col("b"), F.col("ca") != F.col("cb"), may_link(F.col("sa"), F.col("sb"))])
        more = scratch.put(verify(rest.select("a", "b").distinct()))
        links, found = _with_more(links, found, more, scratch)
        if last:
            scratch.drop(opened)
            break
        todo = opened.select(*on, F.col("next").alias("lo"), "item")
    return links, found
