import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staylens.operators import regress, segments, topics, trees


def linear_frame(spark, n=600, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 2, 1] + [0, 100, 3, 0]
    y = 3 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, id=np.arange(n), g=np.where(np.arange(n) % 3 == 0, "u", "v"))
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_ols(spark):
    pdf, df = linear_frame(spark)
    df = df.unionByName(df.limit(1).withColumn("a", F.lit(None).cast("double")))  # a row with a null is left out
    got = {r.term: r for r in regress.ols(df, "y", list("abc")).collect()}
    X = np.column_stack([np.ones(len(pdf)), pdf[list("abc")]])
    b, *_ = np.linalg.lstsq(X, pdf.y, rcond=None)
    res = pdf.y - X @ b
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * (res @ res) / (len(pdf) - 4))
    assert [got[t].estimate for t in ("(Intercept)", "a", "b", "c")] == pytest.approx(list(b), rel=1e-6)
    assert [got[t].std_error for t in ("(Intercept)", "a", "b", "c")] == pytest.approx(list(se), rel=1e-6)
    assert got["a"].r2 == pytest.approx(1 - (res @ res) / ((pdf.y - pdf.y.mean()) ** 2).sum())
    assert got["a"].p < 1e-6 < got["c"].p


def test_relative_importance(spark):
    _, df = linear_frame(spark)
    got = {r.term: r.share for r in regress.relative_importance(df, "y", list("abcd")).collect()}
    assert sum(got.values()) == pytest.approx(1) and all(v > -1e-9 for v in got.values())
    rows = [(float(a), float(b), float(c), 1.0 * a + 2.0 * b) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    flat = spark.createDataFrame(rows, "a double, b double, c double, y double")
    shares = {r.term: r.share for r in regress.relative_importance(flat, "y", ["a", "b", "c"]).collect()}
    assert shares == pytest.approx({"a": 0.2, "b": 0.8, "c": 0.0}, abs=1e-9)


def test_gram_is_the_same_in_any_partitioning(spark):
    pdf, df = linear_frame(spark)
    shift = regress.column_means(df, ["a", "b"])

    def matrix(frame):
        rows = regress.gram(frame, ["a", "b"], ["g"], shift).orderBy("g", "i").collect()
        return np.array([r["values"] for r in rows])

    assert np.allclose(matrix(df.coalesce(1)), matrix(df.repartition(8)))
    x = np.column_stack([pdf[pdf.g == "u"][["a", "b"]] - shift, np.ones((pdf.g == "u").sum())])
    assert np.allclose(matrix(df)[:3], x.T @ x)


def test_lasso(spark):
    pdf, df = linear_frame(spark)
    df = df.withColumn("never", F.lit(0))
    out = regress.lasso_cv(df, "id", [*"abcd", "never"], "y", "g", optional=["never"]).toPandas()
    assert set(out.variable) == set("abcd")
    for _, part in out.groupby("g"):
        coef = part.set_index("variable").coef
        assert coef["a"] == pytest.approx(3 * pdf.a.std(), rel=0.15)
        assert coef["b"] == pytest.approx(-0.5 * pdf.b.std(), rel=0.15)
        assert abs(coef["c"]) < 0.2 and part.r2.iloc[0] > 0.8
    # the descent solves the stated problem: compare with proximal gradient on the same matrices
    rng = np.random.default_rng(1)
    z = rng.normal(size=(200, 6))
    q, c, alpha = z.T @ z / 200, rng.normal(size=6), 0.3
    b = regress._descend(q, c, alpha, np.zeros(6), 1e-10)
    w, step = np.zeros(6), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20000):
        g = w - step * (q @ w - c)
        w = np.sign(g) * np.maximum(np.abs(g) - step * alpha, 0)
    assert np.allclose(b, w, atol=1e-6)


def test_logit(spark):
    rng = np.random.default_rng(6)
    n = 800
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(int)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=y, id=np.arange(n))
    df = spark.createDataFrame(pdf).repartition(4)
    fit = regress.logit_cv(df, "id", list("abc"), "y")
    assert len(fit.cv_accuracy) == 10 and fit.cv_accuracy[fit.c] == max(fit.cv_accuracy.values())
    w = np.append(fit.coef, fit.intercept)
    X = np.column_stack([x, np.ones(n)])
    grad = X.T @ (1 / (1 + np.exp(-X @ w)) - y) + np.append(w[:-1], 0) / fit.c
    assert np.abs(grad).max() < 1e-3  # stationary point of the penalised likelihood
    odds = regress.odds_table(fit.table(spark)).collect()
    assert odds[0].variable == "a" and odds[0].odds_change_pct == pytest.approx((np.exp(fit.coef[0]) - 1) * 100)
    assert fit.score(df).where("prediction = y").count() / n > 0.75


def test_one_hot_and_standardize(spark):
    df = spark.createDataFrame([("t", 1.0), (None, 3.0), ("f.x", 5.0)], "s string, v double")
    wide, names = regress.one_hot(df, ["s"])
    assert names == ["s_f_x", "s_t", "s_nan"]
    assert [tuple(r[n] for n in names) for r in wide.orderBy("v").collect()] == [(0, 1, 0), (0, 0, 1), (1, 0, 0)]
    z = [r.v for r in regress.standardize(df, ["v"]).orderBy("v").collect()]
    assert z == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)


def test_trees_and_shapley(spark):
    rng = np.random.default_rng(7)
    x = rng.random((600, 3))
    y = (x[:, 0] * 3).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=y, id=np.arange(600)))
    fit = trees.gbt_multiclass(df, list("abc"), "y", max_iter=5, max_depth=3, min_rows=10)
    assert fit.score(df).where("prediction = y").count() > 560
    assert trees.importance(fit, spark, 2).first().variable == "a"
    values = trees.shapley_exact(fit, df, "id").toPandas()
    total = values.groupby(["id", "class"]).agg(s=("shapley", "sum"), base=("base", "first"), pred=("prediction", "first"))
    assert len(values) == 600 * 3 * 3
    assert np.allclose(total.s + total.base, total.pred, atol=1e-9)
    raw = {(r["id"], r["class"]): r["f"] for r in fit.score(df).select("id", F.posexplode("raw").alias("class", "f")).collect()}
    assert all(abs(total.pred[k] - v) < 1e-9 for k, v in raw.items())
    assert trees.shapley_summary(spark.createDataFrame(values)).where("class = 0").first().feature == "a"
    assert trees.shapley_row(spark.createDataFrame(values), "id", 5, 0).count() == 3


def test_pmm_takes_observed_near_values(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = np.round(rng.normal(size=n), 1)  # many equal predictions
    y = np.round(2 * x + rng.normal(size=n) * 0.1, 3)
    gone = rng.random(n) < 0.25
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "y": np.where(gone, np.nan, y)})
    df = spark.createDataFrame(pdf).select("id", "x", F.when(~F.isnan("y"), F.col("y")).alias("y"))
    got = segments.impute_pmm(df, "id", ["x", "y"], maxit=2).toPandas().set_index("id").sort_index()
    assert np.allclose(got.y[~gone], y[~gone])
    assert set(got.y[gone]) <= set(y[~gone])
    assert np.abs(got.y[gone] - 2 * x[gone]).mean() < 0.3
    again = segments.impute_pmm(df.repartition(3), "id", ["x", "y"], maxit=2).toPandas().set_index("id").sort_index()
    assert np.allclose(got.y, again.y)


def test_matching_against_brute_force(spark):
    rng = np.random.default_rng(9)
    n, donors = 200, 5
    z, seen = rng.normal(size=n), rng.random(n) < 0.7
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": np.arange(n) * 1.0, "z": z, "s": seen}))
    got = segments._match(df, "id", "v", F.col("s"), F.col("z"), donors, 1).toPandas().set_index("id")["__value"]
    assert set(got.index) == set(np.flatnonzero(~seen))
    for i, value in got.items():
        near = np.flatnonzero(seen)[np.argsort(np.abs(z[seen] - z[i]))[:donors]]
        assert int(value) in near


def test_kmeans_elbow_pca(spark):
    rng = np.random.default_rng(10)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0]])
    x = np.vstack([c + rng.normal(size=(60, 3)) for c in centres])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(180)))
    vec = segments.scaled_vectors(df, "id", list("abc")).cache()
    model, cost = segments.kmeans_best(vec, 3)
    found = segments.assign_clusters(model, vec).toPandas().set_index("id").cluster.sort_index().to_numpy()
    assert len({tuple(sorted(set(found[i : i + 60]))) for i in (0, 60, 120)}) == 3 and set(found) == {1, 2, 3}
    wss = [r.wss for r in segments.elbow(vec, [2, 3, 4]).orderBy("k").collect()]
    assert wss[0] > wss[1] >= wss[2] and wss[1] == pytest.approx(cost, rel=1e-6)
    pc = segments.pca_2d(vec, "id").toPandas()
    assert pc.pc1.var() >= pc.pc2.var()


def test_imputation_without_a_single_value(spark):
    rows = [(i, float(i), None, None if i % 4 == 0 else i * 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, none double, y double")
    got = segments.impute_pmm(df, "id", ["x", "none", "y"], maxit=2).collect()
    assert len(got) == 40 and all(r.none is None and r.x is not None and r.y is not None for r in got)
    assert segments.observed_columns(df, ["x", "none", "y"]) == ["x", "y"]
    assert segments.impute_pmm(df, "id", ["none"]).where("none IS NULL").count() == 40


def test_overrides(spark):
    rows = [(1, 5.0, 50.0, 3), (2, 30.0, 50.0, 3), (3, 40.0, 200.0, 3), (4, None, 50.0, 3), (5, 5.0, None, 3)]
    df = spark.createDataFrame(rows, "id int, max_listings double, avg_price_per_accommodates double, cluster int")
    assert [r.cluster for r in segments.override_segments(df).orderBy("id").collect()] == [3, 8, 9, None, None]


def test_topic_names(spark):
    beta = [(1, "a", 0.4), (1, "b", 0.2), (1, "c", 0.1), (2, "x", 0.5), (2, "y", 0.245), (3, "p", 0.3), (3, "q", 0.3), (3, "r", 0.3)]
    best = topics.top_terms(spark.createDataFrame(beta, "topic int, term string, beta double"), 2)
    assert best.where("topic = 3").count() == 3  # a tie is kept
    assert {r.topic: r.topic_name for r in topics.name_topics(best).collect()} == {1: "1) a, b", 2: "2) x", 3: "3) p, q"}


def test_p_value_has_one_formula():
    from staylens.operators.regress import _t_two_sided

    assert abs(_t_two_sided(3.5, 1000) - 0.000486) < 1e-6 and abs(_t_two_sided(3.5, 1000) - _t_two_sided(3.5, 1001)) < 1e-6
    assert abs(_t_two_sided(1.0, 1) - 0.5) < 1e-12 and abs(_t_two_sided(-2.0, 2) - 0.18350341907227) < 1e-12
    assert 0 < _t_two_sided(40.0, 500) < 1e-150 and _t_two_sided(0.0, 9) == 1


def test_kmeans_by_blocks_finds_what_rows_find(spark):
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(6 * (i % 3), 1 + i % 2, 3))) for i in range(900)]
    vectors = segments.scaled_vectors(spark.createDataFrame(rows, "id int, a double, b double, c double"), "id", ["a", "b", "c"]).cache()
    best, cost = segments.kmeans_best(vectors, 4, 3)
    assert best.getSolver() == "block"
    by_rows = [KMeans(k=4, seed=s, maxIter=10, solver="row").fit(vectors).summary.trainingCost for s in (1, 2, 3)]
    assert cost == pytest.approx(min(by_rows), rel=1e-9)


def test_terms_are_counted_in_their_row_and_frequent_ones_not_dealt_out(spark):
    from staylens.operators import reshape, terms

    texts = ["a b a", None, "", "b c d, A!", "e b"]
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "id long, text string")
    counts = terms.row_term_counts(docs, "id", "text")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == [(0, "a", 2), (0, "b", 1), (0, "b", 1), (0, "e", 1), (3, "a", 1), (3, "b", 1), (3, "c", 1), (3, "d", 1)]
    rows, dictionary = reshape.to_dtm(counts, "id", "word", "n")
    assert sorted((r.id, r.term_ids, r.counts) for r in rows.collect()) == [(0, [0, 1, 4], [2, 2, 1]), (3, [0, 1, 2, 3], [1, 1, 1, 1])]
    named = counts.withColumnRenamed("word", "term")
    whole = sorted(map(tuple, reshape._with_entries(named, dictionary).collect()))
    for bound in (0, 1, 2, 5):
        assert sorted(map(tuple, reshape._with_entries(named, dictionary, bound).collect())) == whole


def test_document_term_matrix_keeps_all_terms(spark):
    from staylens.operators.reshape import dtm_from_terms

    docs = spark.createDataFrame([(1, ["b", "a", "c", "b", None]), (2, ["d"]), (3, []), (None, ["e"])], "id long, terms array<string>")
    rows, dictionary = dtm_from_terms(docs, "id", "terms")
    assert {r.term: r.term_id for r in dictionary.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert sorted((r.id, r.term_ids, r.counts) for r in rows.collect()) == [(1, [0, 1, 2], [1, 2, 1]), (2, [3], [1])]
