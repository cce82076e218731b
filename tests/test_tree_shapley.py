"""Exact Shapley values of trees against the definition over all subsets of features."""

import itertools
import math

import numpy as np
import pytest

from staylens.operators import tree_shapley as ts
from staylens.operators import trees
from staylens.runtime import Rounds, materialize


def random_tree(rng, depth, features, rows=4096):
    """Nodes as ``read_nodes`` gives them; a feature may split more than once on a path."""
    nodes = {}

    def grow(level, n):
        at = len(nodes)
        nodes[at] = None
        if level == depth or n < 4 or rng.random() < 0.1:
            nodes[at] = (float(rng.normal()), n, -1, -1, -1, None)
            return at
        left = int(rng.integers(1, n))
        f, t = int(rng.integers(0, features)), float(rng.normal())
        a = grow(level + 1, left)
        b = grow(level + 1, n - left)
        nodes[at] = (0.0, n, a, b, f, t)
        return at

    grow(0, rows)
    return nodes


def expected(nodes, x, known, at=0):
    """What the tree expects of a row of which only the features in ``known`` are looked at."""
    value, n, left, right, f, t = nodes[at]
    if left < 0:
        return value
    if f in known:
        return expected(nodes, x, known, left if x[f] <= t else right)
    return sum(nodes[c][1] / n * expected(nodes, x, known, c) for c in (left, right))


def by_definition(nodes, x, p):
    phi = np.zeros(p)
    for j in range(p):
        others = [i for i in range(p) if i != j]
        for s in range(p):
            w = math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p)
            for known in itertools.combinations(others, s):
                phi[j] += w * (expected(nodes, x, {*known, j}) - expected(nodes, x, set(known)))
    return phi


@pytest.mark.parametrize("seed", range(6))
def test_values_over_all_subsets(seed):
    rng = np.random.default_rng(seed)
    forest, weights = [random_tree(rng, 5, 6) for _ in range(3)], [1.0, 0.3, -0.5]
    groups = ts.leaf_paths(forest, weights)
    x = rng.normal(size=(6, 9))
    phi, base = ts.values_of(x, groups)
    for r in range(9):
        want = sum(w * by_definition(t, x[:, r], 6) for t, w in zip(forest, weights))
        assert np.abs(phi[:, r] - want).max() < 1e-10
    assert abs(base - sum(w * expected(t, None, set()) for t, w in zip(forest, weights))) < 1e-10


def test_a_leaf_alone_and_a_long_path():
    groups = ts.leaf_paths([{0: (2.5, 10, -1, -1, -1, None)}], [2.0])
    phi, base = ts.values_of(np.zeros((3, 2)), groups)
    assert base == 5.0 and not phi.any()
    chain = {2 * i: (0.0, 100 - i, 2 * i + 1, 2 * i + 2, i, 0.0) for i in range(17)} | {2 * i + 1: (1.0, 1, -1, -1, -1, None) for i in range(17)}
    chain[34] = (0.0, 83, -1, -1, -1, None)
    with pytest.raises(ValueError):
        ts.leaf_paths([chain], [1.0])


def test_trained_model(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    rows = [(i, *map(float, r), int(r[0] * r[1] > 0) + int(r[2] > 1)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "key string, a double, b double, `c.d` double, e double, y int").repartition(3)
    fit = trees.gbt_multiclass(df, ["a", "b", "e"], "y", max_iter=4, max_depth=4, min_rows=5)
    got = trees.shapley_exact(fit, df, "key").collect()
    assert len(got) == 400 * 3 * 3
    stored = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(trees, "materialize", lambda d: (stored.append(materialize(d)), stored[-1])[1])
        kept = trees.stored_shapley(fit, df, "key")
    assert [d.count() for d in stored] == [400 * 3]  # one stored row per row and class
    assert sorted(map(str, kept.collect())) == sorted(map(str, got))
    nodes = ts.read_nodes(fit.models[1], spark, Rounds(spark, "test"))
    mine = {(r["key"], r["feature"]): r["shapley"] for r in got if r["class"] == 1}
    for i in range(0, 400, 40):
        v = x[i][[0, 1, 3]]
        want = sum(w * by_definition(t, v, 3) for t, w in zip(nodes, fit.models[1].treeWeights))
        assert all(abs(mine[str(i), f] - w) < 1e-9 for f, w in zip(("a", "b", "e"), want))
    assert trees.shapley_exact(fit, df.where("false"), "key").count() == 0
