"""Linear and logistic models from sums that one pass over the rows yields.

The passes run as Spark jobs: each task folds its Arrow batches into small matrices, which are then summed
over the cluster. What is solved afterwards has the size of the model, not of the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb, exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.clean import odds_change_pct, ratio, row_count, row_mean
from staylens.operators.sparse_logit import fit_path, sparse_columns
from staylens.runtime import MAX_LEVELS, column_names

# --- features -------------------------------------------------------------------------------


def one_hot(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """0/1 column ``<col>_<value>`` for every value of every column, nulls being a value of their own (``nan``)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    seen = df.select(each.alias("e")).select("e.c", "e.v").distinct().limit(MAX_LEVELS + 1).collect()
    if len(seen) > MAX_LEVELS:
        raise ValueError("too many distinct values for one-hot columns")
    levels = sorted(((r.c, r.v) for r in seen), key=lambda e: (cols.index(e[0]), e[1] is None, e[1] or ""))
    names = column_names([f"{c}_{'nan' if v is None else v}" for c, v in levels], df.columns)
    made = {n: F.col(c).cast("string").eqNullSafe(F.lit(v)).cast("int") for n, (c, v) in zip(names, levels)}
    return df.withColumns(made).drop(*cols), names


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Centre and scale columns by population deviation, learnt on ``fit_on`` (the training rows)."""
    src = df if fit_on is None else fit_on
    s = src.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in cols})


# --- sums of products -----------------------------------------------------------------------


def _sum_arrays(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = Summarizer.metrics("sum").summary(array_to_vector("values"))
    return parts.groupBy(*keys).agg(total.alias("s")).select(*keys, vector_to_array("s.sum").alias("values"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Array column of equal lengths as a matrix, without a Python object per row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gram(df: DataFrame, cols: Sequence[str], by: Sequence[str], shift: Sequence[float]) -> DataFrame:
    """Rows (by..., i, values): row i of the matrix of sums of products of (cols - shift, 1) per group."""
    p, by = len(cols), list(by)
    moved = F.array(*[F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, shift)], F.lit(1.0))
    source = df.select(*by, moved.alias("x"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*by).schema), "i int, values array<double>"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            rows = [(*k, i, m[i]) for k, m in sums.items() for i in range(p + 1)]
            sums.clear()
            kinds = [*types, pa.int32(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*by, "i", "values"])

        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            types[:] = [b.schema.field(c).type for c in by]
            for key, at in b.select(by).to_pandas().groupby(by, sort=False, dropna=False).indices.items() if by else [((), slice(None))]:
                part, key = x[at], key if isinstance(key, tuple) else (key,)
                key = tuple(k.item() if isinstance(k, np.generic) else k for k in key)
                sums[key] = sums.get(key, 0.0) + part.T @ part
            if len(sums) * p * p > 20_000_000:  # many groups: hand on what there is
                yield flush()
        if sums:
            yield flush()

    return _sum_arrays(source.mapInArrow(fold, schema), [*by, "i"])


def column_means(df: DataFrame, cols: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first()
    return [m or 0.0 for m in row]


# --- ordinary least squares and relative importance -------------------------------------------


def covariances(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and population covariance matrix of the complete rows; one stable JVM-side aggregate."""
    data = df.select(*[F.col(c).cast("double") for c in cols]).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = data.agg(
        F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.covar_pop(cols[i], cols[j]) for i, j in pairs]
    ).first()
    n, means, cov = row[0], np.array(row[1 : 1 + len(cols)], dtype=float), np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row[1 + len(cols) :]):
        cov[i, j] = cov[j, i] = v
    return n, means, cov


def _t_two_sided(t: float, dof: int) -> float:
    """Two-sided p-value of Student's t: the regularised incomplete beta function at dof / (dof + t^2)."""
    return _incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)) if np.isfinite(t) else 0.0


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction, from the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    c, d, tiny = 1.0, 0.0, 1e-300
    f = 1.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or tiny)
        c = (1 + step / c) or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Rows (term, estimate, std_error, t, p, r2, n) of the least squares fit on the complete rows."""
    n, means, cov = covariances(df, [y, *xs])
    sxx, sxy, syy = cov[1:, 1:], cov[1:, 0], cov[0, 0]
    inv = np.linalg.inv(sxx)
    b = inv @ sxy
    dof = n - len(xs) - 1
    sigma2 = max(0.0, n * (syy - b @ sxy)) / dof
    fit = float(b @ sxy / syy)
    mx = means[1:]
    names = ["(Intercept)", *xs]
    est = [means[0] - b @ mx, *b]
    err = np.sqrt(sigma2 * np.array([(1 + mx @ inv @ mx) / n, *(np.diag(inv) / n)]))
    rows = []
    for name, e, s in zip(names, est, err):
        t = float(e / s) if s > 0 else float("inf")
        rows.append((name, float(e), float(s), t, _t_two_sided(t, dof), fit, n))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t double, p double, r2 double, n long")


def relative_importance(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Rows (term, share): gain in R² averaged over all orders of the predictors, scaled to sum 1."""
    _, _, cov = covariances(df, [y, *xs])
    p = len(xs)

    def fit(subset: tuple[int, ...]) -> float:
        if not subset:
            return 0.0
        s = [i + 1 for i in subset]
        return float(cov[0, s] @ np.linalg.solve(cov[np.ix_(s, s)], cov[s, 0]) / cov[0, 0])

    fits = {s: fit(s) for k in range(p + 1) for s in combinations(range(p), k)}
    gains = np.zeros(p)
    for s, value in fits.items():
        for j in set(range(p)) - set(s):
            gain = fits[tuple(sorted((*s, j)))] - value
            gains[j] += gain / (p * comb(p - 1, len(s)))
    gains /= gains.sum()
    return df.sparkSession.createDataFrame([(x, float(g)) for x, g in zip(xs, gains)], "term string, share double")


# --- lasso ----------------------------------------------------------------------------------


def _descend(q: np.ndarray, c: np.ndarray, alpha: float, b: np.ndarray, tol: float, sweeps: int = 1000) -> np.ndarray:
    """Coordinate descent for half b'qb - c'b + alpha |b|, started at ``b``."""
    b, diag = b.copy(), np.diag(q)
    qb = q @ b
    usable = np.flatnonzero(diag > 1e-12)
    active = usable
    for sweep in range(sweeps):
        largest = 0.0
        for j in active:
            old = b[j]
            z = c[j] - qb[j] + diag[j] * old
            new = np.sign(z) * max(abs(z) - alpha, 0.0) / diag[j]
            if new != old:
                b[j] = new
                qb += q[:, j] * (new - old)
                largest = max(largest, abs(new - old))
        if largest <= tol:
            if active is usable:
                break
            active = usable  # settled on the active ones: check all once more
        else:
            nonzero = usable[b[usable] != 0]
            active = nonzero if len(nonzero) and sweep > 0 else usable
    return b


def _standard(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and population covariances from a sums-of-products matrix whose last column is the count."""
    n = m[-1, -1]
    mean = m[:-1, -1] / n
    return n, mean, m[:-1, :-1] / n - np.outer(mean, mean)


def _fit_lasso(folds: Mapping[int, np.ndarray], n_alphas: int, eps: float) -> tuple[np.ndarray, float, float, int, int]:
    """Lasso on standardised features with the penalty chosen by cross-validation; fold -1 is the test set."""
    train = {f: m for f, m in folds.items() if f >= 0}
    whole = sum(train.values())
    n, mean, cov = _standard(whole)
    sd = np.sqrt(np.clip(np.diag(cov)[:-1], 0, None))
    sd = np.where(sd < 1e-9, 0.0, sd)
    inv = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)

    def scaled(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        k, _, s = _standard(m)
        return k, s[:-1, :-1] * np.outer(inv, inv), s[:-1, -1] * inv

    _, q, c = scaled(whole)
    top = np.abs(c).max()
    alphas = np.geomspace(top, top * eps, n_alphas) if top > 0 else np.zeros(1)
    tol = 1e-5 * max(np.sqrt(cov[-1, -1]), 1e-12)

    def error(m: np.ndarray, b: np.ndarray, centre: np.ndarray) -> float:
        """Mean squared error of y - centre_y - b.(x - centre_x) from the sums of the held-out rows."""
        k, mu, s = _standard(m)
        w = np.append(-b * inv, 1.0)
        return float(w @ s @ w + (w @ (mu - centre)) ** 2)

    errors = np.zeros(len(alphas))
    for f, held in train.items():
        rest = whole - held
        _, centre, _ = _standard(rest)
        _, qf, cf = scaled(rest)
        b = np.zeros(len(inv))
        for i, a in enumerate(alphas):
            b = _descend(qf, cf, a, b, tol)
            errors[i] += error(held, b, centre) / len(train)
    best = int(errors.argmin())
    b = np.zeros(len(inv))
    for a in alphas[: best + 1]:
        b = _descend(q, c, a, b, tol)
    score, n_test = float("nan"), 0
    if -1 in folds:
        n_test, _, ct = _standard(folds[-1])
        score = 1 - error(folds[-1], b, mean) / ct[-1, -1] if ct[-1, -1] > 0 else float("nan")
    return b, float(alphas[best]), score, int(n), int(n_test)


def lasso_cv(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    by: str,
    folds: int = 5,
    n_alphas: int = 100,
    eps: float = 1e-3,
    test_share: float = 0.2,
    seed: int = 123,
    allowed: DataFrame | None = None,
    optional: Sequence[str] = (),
) -> DataFrame:
    """Cross-validated lasso per group: rows (by, variable, coef, alpha, r2, n_train, n_test).

    Coefficients are per standard deviation of the training rows. One pass gives the sums of products of
    every group and fold (the test rows being one more fold); penalties, folds and the test score are all
    computed from those. ``allowed`` (by, variables) restricts the features of a group; ``optional`` 0/1 features that no row
    of a group has get no coefficient there.
    """
    cols = [*features, label]
    data = df.dropna(subset=[by, *cols])
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    fold = F.when(u < test_share, -1).otherwise(F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(folds)).cast("int"))
    data = data.withColumn("__fold", fold)
    shift = column_means(data, cols)
    sums = gram(data, cols, [by, "__fold"], shift)
    if allowed is not None:
        sums = sums.join(allowed.select(by, F.col("variables").alias("__allowed")), by)
    else:
        sums = sums.withColumn("__allowed", F.array(*[F.lit(f) for f in features]))
    names, optional = list(features), set(optional)
    kind = df.schema[by].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        matrices = {int(f): np.vstack(part.sort_values("i")["values"].to_numpy()) for f, part in pdf.groupby("__fold")}
        whole, usable = sum(matrices.values()), set(pdf["__allowed"].iloc[0])
        held = whole[-1, :] + np.append(shift, 0.0) * whole[-1, -1]  # column totals
        mine = [i for i, f in enumerate(names) if f in usable and (f not in optional or held[i] > 0.5)]
        take = [*mine, len(names), len(names) + 1]
        matrices = {f: m[np.ix_(take, take)] for f, m in matrices.items()}
        b, alpha, score, n, n_test = _fit_lasso(matrices, n_alphas, eps)
        return pd.DataFrame(
            {by: pdf[by].iloc[0], "variable": [names[i] for i in mine], "coef": b, "alpha": alpha, "r2": score, "n_train": n, "n_test": n_test}
        )

    schema = f"`{by}` {kind}, variable string, coef double, alpha double, r2 double, n_train long, n_test long"
    # one group here is the sums of one model, never the rows behind them
    return sums.groupBy(by).applyInPandas(fit, schema)


def influence_index(coefs: DataFrame, prices: DataFrame, by: str, groups: Sequence, least: int = 4) -> DataFrame:
    """Coefficients relative to the mean price of their group, one column per group, with mean and count.

    Variables with fewer than ``least`` groups are dropped; the strongest come first.
    """
    scaled = coefs.join(prices.select(by, "avg_price"), by, "left").withColumn("index", ratio("coef", "avg_price"))
    wide = scaled.groupBy("variable").pivot(by, list(groups)).avg("index")
    cols = [f"`{g}`" for g in groups]
    wide = wide.withColumns({"average": row_mean(*cols), "held": row_count(*cols)})
    return wide.where(F.col("held") >= least).orderBy(F.desc("average"))


# --- logistic regression --------------------------------------------------------------------


@dataclass
class LogitFit:
    """A fitted logistic regression: names, coefficients, intercept, inverse penalty, accuracy per penalty."""

    features: list[str]
    coef: np.ndarray
    intercept: float
    c: float
    cv_accuracy: dict[float, float]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score`` (probability of 1) and ``prediction``; JVM-side arithmetic on the feature columns."""
        z = F.lit(self.intercept)
        for f, b in zip(self.features, self.coef):
            z = z + F.col(f"`{f}`") * F.lit(float(b))
        return df.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("prediction", (F.col("score") > 0.5).cast("int"))

    def score_sparse(self, rows: DataFrame) -> DataFrame:
        """``score`` for rows with ``idx`` and ``val``; the coefficients are looked up by number."""
        coef = F.array(*[F.lit(float(b)) for b in self.coef])
        terms = F.zip_with("idx", "val", lambda i, v: F.get(coef, i) * v)
        z = F.aggregate(terms, F.lit(self.intercept), lambda a, t: a + t)
        return rows.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("prediction", (F.col("score") > 0.5).cast("int"))

    def table(self, spark) -> DataFrame:
        """Rows (variable, coef)."""
        return spark.createDataFrame([(f, float(b)) for f, b in zip(self.features, self.coef)], "variable string, coef double")


def logit_cv(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    cs: Sequence[float] = tuple(np.logspace(-4, 4, 10)),
    folds: int = 5,
    max_iter: int = 1000,
    seed: int = 123,
) -> LogitFit:
    """L2 logistic regression on number columns with the penalty chosen by cross-validated accuracy (lowest C among equals)."""
    features = list(features)
    return logit_cv_sparse(sparse_columns(df, features, key, label), key, features, label, cs, folds, max_iter, seed)


def logit_cv_sparse(
    rows: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    cs: Sequence[float] = tuple(np.logspace(-4, 4, 10)),
    folds: int = 5,
    max_iter: int = 1000,
    seed: int = 123,
) -> LogitFit:
    """``logit_cv`` of rows (key, idx, val, label): ``idx`` numbers into ``features``, whose names are as many as coefficients."""
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(folds)).cast("int")
    data = rows.select("idx", "val", F.col(label).cast("double").alias("y"), fold.alias("fold")).dropna()
    w, best, cv = fit_path(data, len(features), cs, folds, max_iter)
    return LogitFit(list(features), w[:-1], float(w[-1]), best, cv)


def odds_table(coefs: DataFrame, support: DataFrame | None = None, item: str = "item") -> DataFrame:
    """Coefficients with the change of the odds in percent, and the support of the feature if given."""
    out = coefs
    if support is not None:
        out = coefs.join(support.withColumnRenamed(item, "variable"), "variable")
    return out.withColumn("odds_change_pct", odds_change_pct("coef")).orderBy(F.desc("odds_change_pct"))
