"""Whitening of vectors by shifted CholeskyQR.

Entries become whole numbers, floor(scale * c). The fit list is each distinct vector of them once. Its mean comes from exact
sums; its centred rows X are then orthogonalised in passes: a pass takes each row through triangular solves with the
factors found so far, sums the Gram matrix of the results over all tasks, and its Cholesky factor, shifted where rounding
could make the matrix indefinite, becomes the next factor. Passes go on until the rows are orthonormal. The product R of
all factors has the singular values and right singular vectors of X, to which its condition number came in only once
and not squared: they are the components and, squared over n, the eigenvalues of the covariance.

The driver holds matrices of dimension times dimension. Rows are never collected, and the fit list is read from a stored
table in each pass.

Cases: a vector that is null, empty, or holds a null or non-finite entry (or one of 2^53 or more after scaling, where whole
numbers are no longer exact) takes no part. If vectors differ in length, those of the length that most have (of several
such the longest) take part, the others do not. Equal vectors are one row of the fit list, and every row of the table
gets its own result, repeated ids and null ids too. Components whose eigenvalue is zero up to rounding can't be scaled to
variance one and are left out, so that a fit list of one vector, like an empty table, gives an empty result. Further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.scan import list_array, map_batches
from staylens.llm.stored import Scratch

SCALE = 256
# Whole numbers at least this large are not exact as doubles.
EXACT = 1 << 53
# Largest distance of the Gram matrix from the identity at which rows count as orthonormal, and the most passes.
ORTHONORMAL, PASSES = 1e-12, 12
# Rows whose solves are done together; bounds the memory of a task.
ROWS = 8_192
# Whole numbers are summed in two halves, so that 64-bit sums hold for 2^36 rows.
HALF = 26


@dataclass
class Model:
    """Size and sums of the fit list, unit components by falling eigenvalue, and shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Id, dimension and whole numbers (64-bit, packed in bytes) of every vector that takes part."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, dims, packed = [], [], []
        for i, vector in enumerate(batch.column(1)):
            values = vector.values
            if values is None or len(values) == 0 or values.null_count:
                continue
            x = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all() and (np.abs(x) < EXACT).all():
                at.append(i)
                dims.append(len(x))
                packed.append(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "dim", "x"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return map_batches(rows.select("vec_id", F.col("embedding").cast("array<double>")), over, f"vec_id {kind}, dim int, x binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def _blocks(batches, dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.column(0).slice(a, ROWS), dim)


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension; tasks add up first, one row per dimension comes back."""

    def over(batches):
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for x in _blocks(batches, dim):
            n += len(x)
            high += (x >> HALF).sum(axis=0)
            low += (x & ((1 << HALF) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(high), pa.array(low)], names=["at", "n", "high", "low"])

    got = fit.select("x").mapInArrow(over, "at int, n long, high long, low long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    rows = sorted(got.collect())
    return rows[0]["n"], [(r["high"] << HALF) + r["low"] for r in rows]


def solve_rows(x: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Q with Q @ upper = x, column by column from the left."""
    q = np.empty_like(x)
    for j in range(len(upper)):
        q[:, j] = (x[:, j] - q[:, :j] @ upper[:j, j]) / upper[j, j]
    return q


def gram(fit: DataFrame, mean: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows after solves with all factors: upper triangles summed in tasks, then by place."""
    dim = len(mean)
    triangle = np.triu_indices(dim)

    def over(batches):
        total = np.zeros((dim, dim))
        for x in _blocks(batches, dim):
            q = np.asfortranarray(x - mean)
            for upper in factors:
                q = solve_rows(q, upper)
            total += q.T @ q
        own = total[triangle]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), pa.array(own)], names=["at", "value"])

    got = fit.select("x").mapInArrow(over, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros((dim, dim))
    for at, value in got.collect():
        out[triangle[0][at], triangle[1][at]] = out[triangle[1][at], triangle[0][at]] = value
    return out


def factor(matrix: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor, of the matrix shifted by what rounding can take from it where asked for or needed."""
    dim = len(matrix)
    shift = 11 * (rows * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(matrix, 2)
    shift = min(shift, 1e-3 * np.linalg.norm(matrix, 2)) or np.finfo(float).tiny
    add = shift if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(matrix + add * np.eye(dim)).T
        except np.linalg.LinAlgError:
            add = max(10 * add, shift)


def upper_factor(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """R of the centred rows."""
    factors: list[np.ndarray] = []
    r = np.eye(len(mean))
    for k in range(PASSES):
        matrix = gram(fit, mean, factors)
        if k and np.abs(matrix - np.eye(len(mean))).max() <= ORTHONORMAL:
            break
        factors.append(factor(matrix, n, k == 0))
        r = factors[-1] @ r
    return r


def fit_model(fit: DataFrame, dim: int, components: int) -> Model | None:
    """Components of the distinct whole vectors ``fit``; None if there is no variance."""
    n, sums = exact_sums(fit, dim)
    mean = np.array([s / n for s in sums])
    _, sigma, right = np.linalg.svd(upper_factor(fit, mean, n))
    values = sigma**2 / n
    # What rounding of the rows and of their mean leaves of a component without variance.
    noise = (np.abs(mean).max() * np.sqrt(n) + sigma[0]) * np.finfo(float).eps * dim
    keep = min(components, int((sigma > noise).sum()))
    if not keep:
        return None
    model = Model(n, sums, right[:keep].T.copy(), values[:keep], values[:keep] / values.sum())
    cov = gram_of_whitened(fit, model)
    model.identity_error = float(np.abs(cov - np.eye(keep)).max())
    return model


def gram_of_whitened(fit: DataFrame, model: Model) -> np.ndarray:
    """Covariance of the whitened fit list, whose rows are centred before they are projected."""
    mean, weights = model.mean, model.weights
    k = weights.shape[1]

    def over(batches):
        total = np.zeros((k, k))
        for x in _blocks(batches, len(mean)):
            y = (x - mean) @ weights
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.reshape(-1))], names=["at", "value"])

    got = fit.select("x").mapInArrow(over, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(k * k)
    for at, value in got.collect():
        out[at] = value
    return out.reshape(k, k) / model.n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n * x - S)^2."""
    s = np.array(sums, object)
    bound = (n * int(np.abs(x).max(initial=0)) + max(abs(v) for v in sums)) ** 2 * len(sums)
    gap = n * x - s.astype(np.int64) if bound < 1 << 63 else n * x.astype(object) - s
    return (gap * gap).sum(axis=1).tolist()


def transform(vectors: DataFrame, model: Model) -> DataFrame:
    """One row per vector: deviation (decimal, exact) and the whitened values of all components."""
    mean, weights, n, sums = model.mean, model.weights, model.n, model.sums

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            x = _matrix(part.column(1), len(mean))
            y = (x - mean) @ weights
            bounds = np.arange(len(x) + 1) * weights.shape[1]
            deviation = pa.array([str(v) for v in deviations(x, n, sums)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), deviation, list_array(pa.array(y.reshape(-1)), bounds)], names=["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = map_batches(vectors.select("vec_id", "x"), over, f"vec_id {kind}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(rows: DataFrame, components: int = 4, scale: int = SCALE) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    kind = rows.schema["vec_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    vectors = scratch.put(whole_vectors(rows, scale))
    dims = vectors.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not dims:
        return empty
    dim = dims[0]["dim"]
    vectors = vectors.where(F.col("dim") == dim)
    fit = scratch.put(vectors.select("x").dropDuplicates(["x"]))
    model = fit_model(fit, dim, components)
    scratch.drop(fit)
    if model is None:
        return empty
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    out = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
