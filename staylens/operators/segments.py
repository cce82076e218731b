"""Host segments: imputation by predictive mean matching, k-means, elbow curve, projection, overrides."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from staylens.operators.ranks import running_totals
from staylens.operators.regress import covariances
from staylens.runtime import materialize, side_by_side


def _draw(n: int, means: np.ndarray, cov: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Least squares coefficients (intercept last) and a draw from their posterior."""
    mx, my, sxx, sxy = means[1:], means[0], cov[1:, 1:], cov[1:, 0]
    p = len(mx)
    inv = np.linalg.inv(sxx + np.diag(np.diag(sxx) * 1e-5 + 1e-12))
    b = inv @ sxy
    rss = max(0.0, n * (cov[0, 0] - b @ sxy))
    sigma = np.sqrt(rss / rng.chisquare(max(n - p - 1, 1)))
    drawn = b + sigma * np.linalg.cholesky(inv / n) @ rng.standard_normal(p)
    shift = sigma / np.sqrt(n) * rng.standard_normal()
    return np.append(b, my - mx @ b), np.append(drawn, my - mx @ drawn + shift)


def _linear(xs: Sequence[str], b: np.ndarray) -> Column:
    z = F.lit(float(b[-1]))
    for x, w in zip(xs, b):
        z = z + F.col(x) * F.lit(float(w))
    return z


def _match(df: DataFrame, id_col: str, col: str, observed: Column, predicted: Column, donors: int, seed: int) -> DataFrame:
    """(id, value): for each row without ``col`` the value of one of the ``donors`` nearest observed rows.

    All rows are numbered along their prediction, equal predictions in random order. The nearest donors
    are then among the ``donors`` places below and above, which an equi-join on the place finds: no row
    is compared with more than 2 x ``donors`` others, whatever the number of ties.
    """
    rows = df.select(id_col, col, observed.alias("__seen"), predicted.alias("__z"), F.xxhash64(id_col, F.lit(seed)).alias("__h"))
    placed = running_totals(rows, [], [F.col("__z"), F.col("__h"), F.col(id_col)], {"__place": F.col("__seen").cast("long")})
    placed = materialize(placed)
    giver = placed.where("__seen").select(F.col("__place"), F.col("__z").alias("__dz"), F.col(col).alias("__value"))
    taker = placed.where("NOT __seen").select(
        id_col, "__z", "__h", F.explode(F.sequence(F.col("__place") - donors, F.col("__place") + (donors - 1))).alias("__place")
    )
    near = taker.join(giver, "__place").groupBy(id_col, "__h").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.abs(F.col("__z") - F.col("__dz")).alias("d"), "__place", "__value"))), 1, donors).alias("c")
    )
    pick = F.pmod(F.xxhash64("__h", F.lit(seed + 1)), F.size("c").cast("long")).cast("int")
    return near.select(id_col, F.get("c", pick)["__value"].alias("__value"))


def observed_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Those of the columns that have a value in some row."""
    seen = df.agg(*[F.count(c).alias(c) for c in cols]).first() if cols else {}
    return [c for c in cols if seen[c]]


def impute_pmm(
    df: DataFrame,
    id_col: str,
    cols: Sequence[str],
    maxit: int = 5,
    seed: int = 1,
    donors: int = 5,
    imputation: int = 1,
) -> DataFrame:
    """Chained imputation by predictive mean matching: (id, cols...) with the nulls of ``cols`` filled.

    ``imputation`` numbers the set; sets are independent of each other, so only the one that is asked for
    is computed. Imputed values are always values that were observed. A column without a single value has nothing to
    draw from: it stays null and takes no part in the predictions of the others.
    """
    given, cols = list(cols), observed_columns(df, cols)
    if len(cols) < len(given):
        filled = impute_pmm(df, id_col, cols, maxit, seed, donors, imputation) if cols else df.select(id_col)
        return filled.select(id_col, *[F.col(c) if c in cols else F.lit(None).cast("double").alias(c) for c in given])
    rng = np.random.default_rng([seed, imputation])
    missing_of = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first()
    todo = [c for c in cols if missing_of[c]]
    doubles = {c: F.col(c).cast("double") for c in cols}
    if not todo:
        return df.select(id_col, *[doubles[c].alias(c) for c in cols])
    means = df.agg(*[F.avg(c).alias(c) for c in todo]).first()
    state = df.select(
        id_col,
        *[F.coalesce(doubles[c], F.lit(means[c])).alias(c) if c in todo else doubles[c].alias(c) for c in cols],
        *[F.col(c).isNotNull().alias(f"__obs_{c}") for c in todo],
    )
    state = materialize(state)
    for it in range(maxit):
        for i, c in enumerate(todo):
            xs = [x for x in cols if x != c]
            n, mean, cov = covariances(state.where(f"`__obs_{c}`"), [c, *xs])
            fitted, drawn = _draw(n, mean, cov, rng)
            seen = F.col(f"__obs_{c}")
            z = F.when(seen, _linear(xs, fitted)).otherwise(_linear(xs, drawn))
            found = _match(state, id_col, c, seen, z, donors, seed * 1_000_003 + imputation * 10_007 + it * 101 + i)
            names = state.columns
            joined = state.join(found, id_col, "left")
            state = materialize(
                joined.withColumn(c, F.when(seen, F.col(c)).otherwise(F.coalesce("__value", c))).select(*names)
            )
    return state.select(id_col, *cols)


def scaled_vectors(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """(id, features): columns centred and scaled by sample deviation, as one vector."""
    s = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    scaled = df.select(id_col, *[((F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0)).alias(c) for c in cols])
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(scaled).select(id_col, "features")


def kmeans_best(vectors: DataFrame, k: int = 7, nstart: int = 5, max_iter: int = 10) -> tuple[KMeansModel, float]:
    """k-means with the lowest cost of ``nstart`` starts, and that cost. Keep ``vectors`` cached.

    Rows meet the centres in blocks, by one matrix product each: starts and steps are those of the row solver.
    """
    fits = side_by_side(
        lambda s: KMeans(k=k, seed=s, maxIter=max_iter, featuresCol="features", solver="block").fit(vectors), range(1, nstart + 1)
    )
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best, float(best.summary.trainingCost)


def assign_clusters(model: KMeansModel, vectors: DataFrame) -> DataFrame:
    """Cluster numbers from 1, in the order of the centres' first coordinates, so that they mean the same in every run."""
    order = sorted(range(model.getK()), key=lambda i: tuple(model.clusterCenters()[i]) if i < len(model.clusterCenters()) else ())
    place = F.array(*[F.lit(order.index(i) + 1) for i in range(model.getK())])
    return model.transform(vectors).withColumn("cluster", F.get(place, F.col("prediction"))).drop("prediction")


def elbow(vectors: DataFrame, ks: Sequence[int] = range(2, 21), nstart: int = 5, max_iter: int = 25) -> DataFrame:
    """Rows (k, wss): total within-cluster sum of squares for each number of clusters."""
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = [(int(k), kmeans_best(vectors, k, nstart, max_iter)[1]) for k in ks]
    finally:
        vectors.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "k int, wss double")


def pca_2d(vectors: DataFrame, id_col: str) -> DataFrame:
    """(id, pc1, pc2): first two principal components."""
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vectors)
    pc = vector_to_array("pc")
    return model.transform(vectors).select(id_col, F.get(pc, F.lit(0)).alias("pc1"), F.get(pc, F.lit(1)).alias("pc2"))


def override_segments(df: DataFrame, many: float = 30, dear: float = 200) -> DataFrame:
    """Hosts of many listings form cluster 8, expensive ones cluster 9, which wins; an unknown size or price
    leaves the cluster unknown."""
    c = F.when(F.col("max_listings").isNull(), None).when(F.col("max_listings") >= many, 8).otherwise(F.col("cluster"))
    price = F.col("avg_price_per_accommodates")
    return df.withColumn("cluster", F.when(price.isNull(), None).when(price >= dear, 9).otherwise(c))
