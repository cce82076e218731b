"""Scores of classifiers and regressions, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.clean import ratio
from staylens.operators.ranks import running_totals


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def r2(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """One minus residual over total sum of squares."""
    rest = F.sum(F.pow(F.col(label) - F.col(prediction), F.lit(2)))
    return df.groupBy(*by).agg((1 - rest / (F.var_pop(label) * F.count(label))).alias("r2"))


def confusion_matrix(df: DataFrame, classes: Sequence[int], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per true class, one column ``pred_<class>`` per predicted class, zeros where there are none."""
    counted = df.groupBy(F.col(label).cast("int").alias("label")).agg(
        *[F.count(F.when(F.col(prediction) == c, 1)).alias(f"pred_{c}") for c in classes]
    )
    every = df.sparkSession.createDataFrame([(int(c),) for c in classes], "label int")
    return every.join(counted, "label", "left").fillna(0)


def classification_report(df: DataFrame, classes: Sequence[int], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, their macro and weighted means, and the accuracy.

    A score with an empty denominator counts as zero. The data is read once; the rest works on the counts.
    """
    hit = F.col(label) == F.col(prediction)
    per = df.groupBy().agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(hit, 1)).alias("hits"),
        *[
            e
            for c in classes
            for e in (
                F.count(F.when(F.col(label) == c, 1)).alias(f"true_{c}"),
                F.count(F.when(F.col(prediction) == c, 1)).alias(f"pred_{c}"),
                F.count(F.when(hit & (F.col(label) == c), 1)).alias(f"both_{c}"),
            )
        ],
    )
    zero = F.lit(0.0)

    def one(c) -> list:
        p = F.coalesce(ratio(f"both_{c}", f"pred_{c}"), zero)
        r = F.coalesce(ratio(f"both_{c}", f"true_{c}"), zero)
        return [p, r, F.coalesce(ratio(2 * p * r, p + r), zero), F.col(f"true_{c}")]

    scores = {str(c): one(c) for c in classes}
    k = len(scores)
    macro = [sum((s[i] for s in scores.values()), zero) / k for i in range(3)]
    weighted = [ratio(sum((s[i] * s[3] for s in scores.values()), zero), "total") for i in range(3)]
    acc = ratio("hits", "total")
    rows = {**scores, "accuracy": [acc, acc, acc, F.col("total")], "macro avg": [*macro, F.col("total")], "weighted avg": [*weighted, F.col("total")]}
    structs = [
        F.struct(F.lit(n).alias("class"), *[v.alias(a) for v, a in zip(vals, ("precision", "recall", "f1", "support"))])
        for n, vals in rows.items()
    ]
    return per.select(F.inline(F.array(*structs)))


def roc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One point per distinct score, from the highest down: (score, tpr, fpr, auc_part).

    Rows are first counted per score. ``auc_part`` sums to the area under the curve; each is the
    trapezoid between the point and the one before it. With one class only, the rates are null.
    """
    positive = F.col(label) == 1
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("n")
    )
    run = running_totals(counts, [], [F.desc(score)], {"p_before": F.col("p"), "n_before": F.col("n")})
    # the totals come from the stored counts, so the data is not read again
    total = run.agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    all_p, all_n = total.select("P").scalar(), total.select("N").scalar()
    return run.select(
        F.col(score).alias("score"),
        ratio(F.col("p_before") + F.col("p"), all_p).alias("tpr"),
        ratio(F.col("n_before") + F.col("n"), all_n).alias("fpr"),
        (ratio("n", all_n) * ratio(F.col("p_before") + F.col("p") / 2, all_p)).alias("auc_part"),
    )


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in the right order, ties half."""
    return roc(df, score, label).agg(F.sum("auc_part").alias("auc"))
