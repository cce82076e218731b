"""Uniform shuffle of a table into shards of exact size by a hypergeometric communication matrix.

Row counts of the input's partitions fix the law of how many rows each partition sends to each shard: with the shard
sizes given, the counts of a uniform random permutation follow the multivariate hypergeometric distribution. That
matrix, partitions by shards, is drawn first, from one count per partition. Each partition then permutes its rows
locally and sends the first so many of them to shard 0, the next to shard 1 and so on; after the exchange the rows of a
shard are permuted again. Shards are dealt in blocks of bounded size, so no task ever holds a whole shard, and the
counts of the blocks, which follow from the matrix alone, give every row its final slot without reading a row twice.

Only DataFrame functions touch rows. The law is ``rows``: the sizes of any two shards differ by at most one row.

Cases: nulls, empty texts, repeated rows and ties are rows like any others; each row gets a place of its own. An empty
table gives an empty result. Columns of the input are handed on as they are; ``shard`` and ``slot`` replace columns of
those names. The input has to give the same partitions each time it is read, as tables in files do; anything else is
stored first (``stored=False``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.runtime import materialize

SHARDS = 16
# Rows of a block, the unit of the second permutation.
BLOCK_ROWS = 10_000
_LOCAL = (1 << 33) - 1
_NUMPY_LIMIT = 1_000_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad are good."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if good + bad else 0
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max(int((draws + 1) * (good + 1) / (good + bad + 2)), low), high)
    mean = good / (good + bad)
    reach = int(45 * np.sqrt(draws * mean * (1 - mean)) + 60)
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    # Ratios of neighbouring probabilities, summed from one end; what lies further out has no weight in doubles.
    step = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[1:]) - np.log(bad - draws + k[1:])
    log_p = np.concatenate(([0.0], np.cumsum(step)))
    p = np.exp(log_p - log_p.max())
    edge = np.cumsum(p)
    return int(k[np.searchsorted(edge, rng.random() * edge[-1])])


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard: row sums are ``counts``, column sums are ``sizes``."""
    rng = np.random.default_rng(seed)
    left, out = list(sizes), np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest = sum(left)
        for s in range(len(left)):
            rest -= left[s]
            out[p, s] = got = _hypergeometric(rng, left[s], rest, n)
            left[s] -= got
            n -= got
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = 20, block_rows: int = BLOCK_ROWS, stored: bool = True) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 within the shard)."""
    df = df if stored else materialize(df)
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    part, local = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))
    places = df.select(part.alias("__p"), local.alias("__j"))
    # One count per partition of the input comes to the driver, and one line of the matrix per partition goes back.
    counted = sorted(places.groupBy("__p").count().collect())
    counts = [r["count"] for r in counted]
    rows = sum(counts)
    matrix = communication_matrix(counts, shard_sizes(rows, shards), seed)
    lines = [(r["__p"], edges) for r, edges in zip(counted, np.cumsum(matrix, axis=1).tolist())]
    edges = F.broadcast(spark.createDataFrame(lines, "__p int, __edges array<long>"))

    blocks = max(1, -(-rows // (shards * block_rows)))

    def place(frame: DataFrame) -> DataFrame:
        """Shard, block in it and the random key of a row, all from its partition and local place."""
        draw = F.xxhash64("__p", "__j", F.lit(seed))
        return frame.join(edges, "__p").withColumns(
            {"shard": F.size(F.filter("__edges", lambda e: e <= F.col("__j"))), "__block": F.pmod(draw, F.lit(blocks)), "__key": F.xxhash64(draw, F.lit(seed + 1))}
        )

    sizes = place(places).groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))

    permuted = df.withColumn("__r", F.rand(seed)).sortWithinPartitions("__r").withColumns({"__p": part, "__j": local})
    dealt = place(permuted).drop("__edges", "__r").join(starts, ["shard", "__block"])
    inside = Window.partitionBy("shard", "__block").orderBy("__key", "__p", "__j")
    slotted = dealt.withColumn("slot", F.col("__start") + F.row_number().over(inside) - 1)
    return slotted.select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")
