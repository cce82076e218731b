"""Boosted trees for ordered classes, their importances, and what each feature adds to a score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from staylens.operators.tree_shapley import by_feature, shapley, shapley_arrays
from staylens.runtime import materialize, side_by_side


@dataclass
class TreeFit:
    """One binary model per class, scored side by side in the JVM."""

    features: list[str]
    classes: list[int]
    models: list[GBTClassificationModel]

    def raw(self, df: DataFrame, vector: str) -> DataFrame:
        """Add ``raw``, an array with the score of each class, from a vector column."""
        out = df
        for k, m in zip(self.classes, self.models):
            m = m.copy()
            m.setFeaturesCol(vector).setRawPredictionCol(f"__r{k}").setProbabilityCol("").setPredictionCol("")
            out = m.transform(out)
        scores = F.array(*[F.get(vector_to_array(f"__r{k}"), F.lit(1)) for k in self.classes])
        return out.withColumn("raw", scores).drop(*[f"__r{k}" for k in self.classes])

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``raw`` and ``prediction``, the class with the highest score."""
        vec = VectorAssembler(inputCols=self.features, outputCol="__v", handleInvalid="error").transform(df)
        out = self.raw(vec, "__v").drop("__v")
        best = F.array_position("raw", F.array_max("raw")).cast("int")
        return out.withColumn("prediction", F.element_at(F.array(*[F.lit(int(c)) for c in self.classes]), best))


def gbt_multiclass(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classes: Sequence[int] = (0, 1, 2),
    max_iter: int = 100,
    max_depth: int = 6,
    step: float = 0.3,
    min_rows: int = 200,
    seed: int = 123,
) -> TreeFit:
    """Boosted trees, one model per class against the rest."""
    features = list(features)
    vec = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[*features, label]))
    data = vec.select("features", label).persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def one_class(k: int) -> GBTClassificationModel:
            one = data.select("features", (F.col(label) == k).cast("double").alias("label"))
            gbt = GBTClassifier(
                maxIter=max_iter, maxDepth=max_depth, stepSize=step, minInstancesPerNode=min_rows, seed=seed
            )
            return gbt.fit(one)

        models = side_by_side(one_class, classes)
    finally:
        data.unpersist()
    return TreeFit(features, [int(c) for c in classes], models)


def importance(fit: TreeFit, spark, n: int = 25) -> DataFrame:
    """The ``n`` features with the largest importance, averaged over the classes."""
    mean = sum(m.featureImportances.toArray() for m in fit.models) / len(fit.models)
    rows = [(f, float(v)) for f, v in zip(fit.features, mean)]
    return spark.createDataFrame(rows, "variable string, importance double").orderBy(F.desc("importance"), "variable").limit(n)


def shapley_exact(fit: TreeFit, df: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, class, feature, shapley, base, prediction); the values of a row add up to prediction minus base."""
    return shapley(fit.models, fit.classes, fit.features, df, id_col)


def stored_shapley(fit: TreeFit, df: DataFrame, id_col: str) -> DataFrame:
    """``shapley_exact``, worked out once: what is stored has one row per row and class, not one per feature."""
    return by_feature(materialize(shapley_arrays(fit.models, fit.classes, fit.features, df, id_col)), fit.features, id_col)


def shapley_summary(values: DataFrame) -> DataFrame:
    """Mean absolute Shapley value per class and feature."""
    return values.groupBy("class", "feature").agg(F.avg(F.abs("shapley")).alias("mean_abs")).orderBy("class", F.desc("mean_abs"))


def shapley_row(values: DataFrame, id_col: str, row_id, cls: int) -> DataFrame:
    """The breakdown of one row and class, largest effect first."""
    one = values.where((F.col(id_col) == row_id) & (F.col("class") == cls))
    return one.orderBy(F.desc(F.abs("shapley"))).select("feature", "shapley", "base", "prediction")
