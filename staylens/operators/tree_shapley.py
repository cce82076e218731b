"""Exact Shapley values of boosted trees.

What a tree expects of a row of which only some features are known goes down both branches of a split on an unknown
feature, in proportion to the training rows there. For one leaf that is a product over the features on its path: 1 or 0
for a known one, by whether the row meets all its splits on the path, and the share of training rows that do for an
unknown one. The Shapley values of such a product only depend on which features of the path the row meets, so each leaf
has a small table, one line per such pattern, and a row's values are the sum of its lines over all leaves.

Trees are read as rows of nodes from the saved model; rows to explain go through Arrow batches, and nothing is
multiplied by features or subsets of them in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.runtime import Rounds

# Leaves whose tables are held at once, and rows that are looked up together.
LEAVES_AT_ONCE, ROWS_AT_ONCE = 512, 4_096
# A table has two to the number of features on the path lines.
MOST_ON_PATH = 16


@dataclass
class Leaves:
    """Leaves with equally many features on their paths: value, the features, their bounds (above, up to) and shares."""

    value: np.ndarray
    feature: np.ndarray
    above: np.ndarray
    up_to: np.ndarray
    share: np.ndarray


def read_nodes(model: GBTClassificationModel, spark: SparkSession, rounds: Rounds) -> list[dict[int, tuple]]:
    """Per tree: node -> (prediction, rows, left, right, feature, threshold). As large as the model."""
    path = rounds.place()
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"], node["prediction"], node["rawCount"], node["leftChild"], node["rightChild"],
        node["split"]["featureIndex"], F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), node["split"]["numCategories"],
    )
    trees: dict[int, dict[int, tuple]] = {}
    for tree, i, prediction, n, left, right, feature, threshold, categories in rows.collect():
        if left >= 0 and categories >= 0:
            raise ValueError("splits on categories are not explained; encode them as numbers")
        trees.setdefault(tree, {})[i] = (prediction, n, left, right, feature, threshold)
    return [trees[t] for t in sorted(trees)]


def leaf_paths(trees: list[dict[int, tuple]], weights: list[float]) -> list[Leaves]:
    """All leaves of the trees, those with equally many features on the path together."""
    found: dict[int, list[tuple]] = {}
    for nodes, weight in zip(trees, weights):
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            prediction, n, left, right, feature, threshold = nodes[at]
            if left < 0:
                rows = [(f, *p) for f, p in sorted(path.items())]
                found.setdefault(len(rows), []).append((prediction * weight, rows))
                continue
            above, up_to, share = path.get(feature, (-math.inf, math.inf, 1.0))
            todo.append((left, {**path, feature: (above, min(up_to, threshold), share * nodes[left][1] / n)}))
            todo.append((right, {**path, feature: (max(above, threshold), up_to, share * nodes[right][1] / n)}))
    out = []
    for m, leaves in sorted(found.items()):
        if m > MOST_ON_PATH:
            raise ValueError(f"a path holds {m} features, more than {MOST_ON_PATH}")
        cells = np.array([rows for _, rows in leaves], float).reshape(len(leaves), m, 4)
        out.append(Leaves(np.array([v for v, _ in leaves]), cells[..., 0].astype(int), cells[..., 1], cells[..., 2], cells[..., 3]))
    return out


def tables(value: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each leaf, pattern of met features (bits) and feature on the path, what the leaf adds to the feature's value.

    The sum over subsets of the other features, by their size, is the polynomial product of (share + met * t) over them.
    """
    leaves, m = share.shape
    met = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    weight = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    out = np.zeros((leaves, 1 << m, m))
    for j in range(m):
        sums = np.zeros((leaves, 1 << m, m))
        sums[..., 0] = 1
        for i in range(m):
            if i != j:
                higher = sums[..., :-1] * met[None, :, i, None]
                sums = sums * share[:, None, i, None]
                sums[..., 1:] += higher
        out[..., j] = (sums @ np.array(weight)) * (met[None, :, j] - share[:, None, j]) * value[:, None]
    return out


def values_of(x: np.ndarray, groups: list[Leaves]) -> tuple[np.ndarray, float]:
    """Shapley values, features by rows, of the rows ``x`` (features by rows), and what is expected of a row unknown."""
    phi, base = np.zeros_like(x), 0.0
    for g in groups:
        base += float((g.value * g.share.prod(axis=1)).sum())
        for a in range(0, len(g.value), LEAVES_AT_ONCE):
            part = slice(a, a + LEAVES_AT_ONCE)
            lines = tables(g.value[part], g.share[part])
            for leaf, (feature, above, up_to) in enumerate(zip(g.feature[part], g.above[part], g.up_to[part])):
                pattern = np.zeros(x.shape[1], np.int32)
                for i, f in enumerate(feature):
                    pattern |= ((x[f] > above[i]) & (x[f] <= up_to[i])).astype(np.int32) << i
                for i, f in enumerate(feature):
                    phi[f] += lines[leaf, :, i][pattern]
    return phi, base


def shapley_arrays(models: list[GBTClassificationModel], classes: list[int], features: list[str], df: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, class, phi, base, prediction): one per row and class, with the exact values of all features as an array."""
    spark = df.sparkSession
    rounds = Rounds(spark, "tree-shapley")
    fits = [leaf_paths(read_nodes(m, spark, rounds), list(m.treeWeights)) for m in models]
    rows = df.select(F.col(id_col), F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"))
    p = len(features)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                n = part.num_rows
                x = np.ascontiguousarray(part.column(1).flatten().to_numpy().reshape(n, p).T)
                for cls, groups in zip(classes, fits):
                    phi, base = values_of(x, groups)
                    bounds = pa.array(np.arange(n + 1, dtype=np.int32) * p)
                    columns = [
                        part.column(0), pa.array(np.full(n, cls, np.int32)), pa.ListArray.from_arrays(bounds, pa.array(phi.T.reshape(-1))),
                        pa.array(np.full(n, base)), pa.array(base + phi.sum(axis=0)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "phi", "base", "prediction"])

    kind = df.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(over, f"id {kind}, class int, phi array<double>, base double, prediction double")
    return out.withColumnRenamed("id", id_col)


def by_feature(arrays: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """Rows (id, class, feature, shapley, base, prediction) of what ``shapley_arrays`` gives."""
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("j"))
    out = arrays.select(id_col, "class", "base", "prediction", F.posexplode("phi").alias("j", "shapley"))
    return out.select(id_col, "class", name.alias("feature"), "shapley", "base", "prediction")


def shapley(models: list[GBTClassificationModel], classes: list[int], features: list[str], df: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, class, feature, shapley, base, prediction), exact; the values of a row add up to prediction minus base."""
    return by_feature(shapley_arrays(models, classes, features, df, id_col), features, id_col)
