"""Areas, regressions, classifiers, trees, segments and topics on the given tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.catalog.base import rounded, table
from staylens.catalog.texts import _AFINN, _BING, _SCORE, _STOP, _TOK, _afinn, _documents, _stop_words, _tokens
from staylens.functions import text as tx
from staylens.functions.geo import WGS84_A, WGS84_F, area_sq_km
from staylens.operators import evaluate, ranks, regress, segments, sentiment, sparse_logit, terms, topics, trees
from staylens.operators.groups import trend
from staylens.operators.reshape import to_dtm
from staylens.operators.topic_models import compare_topics
from staylens.runtime import materialize

NUMERIC = ["l_quantity", "l_discount", "l_tax"]


def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    """A box per customer; every second one has a hole, every third one a second part."""
    lon, lat = F.pmod("c_custkey", F.lit(350)) - 175.0, F.pmod("c_custkey", F.lit(150)) - 75.0

    def ring(dx: float, dy: float, side: float):
        corners = [(dx, dy), (dx + side, dy), (dx + side, dy + side), (dx, dy + side), (dx, dy)]
        return F.array(*[F.array(lon + x, lat + y) for x, y in corners])

    outer, hole, other = ring(0, 0, 1.0), ring(0.25, 0.25, 0.5), ring(1.5, 0, 0.5)
    first = F.when(F.col("c_custkey") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    geometry = F.when(F.col("c_custkey") % 3 == 0, F.array(first, F.array(other))).otherwise(F.array(first))
    return table(spark, d, "customer").select("c_custkey", F.round(area_sq_km(geometry), 4).alias("sq_km"))


def ols_summary(spark: SparkSession, d: str) -> DataFrame:
    out = regress.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])
    return rounded(out.drop("p"), 3)


def relative_importance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regress.relative_importance(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"]), 4)


def one_hot_standardize(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", *NUMERIC)
    wide, _ = regress.one_hot(items, ["l_returnflag", "l_linestatus"])
    return rounded(regress.standardize(wide, NUMERIC), 4)


def _line_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        "l_returnflag", *NUMERIC, (F.pmod("l_partkey", F.lit(100)) / 100).alias("part_share"),
        (F.col("l_linestatus") == "O").cast("int").alias("is_open"), (F.col("l_extendedprice") / 1000).alias("price"),
    )


def lasso_cv(spark: SparkSession, d: str) -> DataFrame:
    features = [*NUMERIC, "part_share", "is_open"]
    return rounded(regress.lasso_cv(_line_features(spark, d), "key", features, "price", "l_returnflag"), 4)


def influence_index(spark: SparkSession, d: str) -> DataFrame:
    rows = _line_features(spark, d)
    coefs = materialize(regress.lasso_cv(rows, "key", [*NUMERIC, "part_share", "is_open"], "price", "l_returnflag"))
    prices = rows.groupBy("l_returnflag").agg(F.avg("price").alias("avg_price"))
    return rounded(regress.influence_index(coefs, prices, "l_returnflag", ["A", "N", "R"], 3), 4)


def influence_of_rule(spark: SparkSession, d: str) -> DataFrame:
    """Influence index of coefficients given by a rule; one variable is known for too few groups."""
    lines = table(spark, d, "lineitem")
    prices = materialize(lines.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("avg_price")))
    coefs = lines.groupBy("l_returnflag", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("variable")).agg(F.avg("l_quantity").alias("coef"))
    coefs = materialize(coefs.where("variable != 'line 1' OR l_returnflag = 'N'"))
    return rounded(regress.influence_index(coefs, prices, "l_returnflag", ["A", "N", "R"], 3), 8)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a fixed score from their length."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    both = table(spark, d, "labels").join(docs, "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    band = F.when(F.col("n_chars") > 3000, 2).when(F.col("n_chars") > 1000, 1).otherwise(0)
    return both.select("doc_id", F.col("quality").alias("label"), score.alias("score"), (score > 0.5).cast("int").alias("prediction"), band.alias("band"),
                       (F.col("quality") + F.col("toxic")).alias("level"))


# Labelled documents that a word must stand in to become a feature.
WORD_SUPPORT = 40


def _word_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents with the numbers of their well-supported words, and the dictionary of those."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    docs = _documents(spark, d).select("doc_id", "text").join(labels, "doc_id")
    labelled = materialize(docs.select("doc_id", "quality", F.array_distinct(tx.words("text")).alias("items")))
    counts = labelled.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    dictionary = sparse_logit.item_dictionary(counts, "item", WORD_SUPPORT)
    rows = labelled.select("doc_id", "quality").join(sparse_logit.sparse_items(labelled, "doc_id", "items", dictionary), "doc_id")
    return materialize(rows), dictionary


def _fit_words(rows: DataFrame, dictionary: DataFrame) -> regress.LogitFit:
    names = [r["item"] for r in dictionary.orderBy("item_id").collect()]
    return regress.logit_cv_sparse(rows, "doc_id", names, "quality")


def logit_odds(spark: SparkSession, d: str) -> DataFrame:
    """Odds of good quality by the words of a document."""
    rows, dictionary = _word_rows(spark, d)
    odds = regress.odds_table(_fit_words(rows, dictionary).table(spark), dictionary.select("item", "n"))
    return rounded(odds, 3)


def logit_optimum(spark: SparkSession, d: str) -> DataFrame:
    """What holds at the best coefficients: the penalised likelihood has no slope. Joins work it out, not the fitting code."""
    rows, dictionary = _word_rows(spark, d)
    fit = _fit_words(rows, dictionary)
    coefs = materialize(dictionary.join(fit.table(spark).withColumnRenamed("variable", "item"), "item"))
    cells = materialize(rows.select("doc_id", "quality", F.explode(F.col("idx").cast("array<bigint>")).alias("item_id")))
    z = cells.join(coefs, "item_id").groupBy("doc_id", "quality").agg((F.sum("coef") + F.lit(fit.intercept)).alias("z"))
    off = materialize(z.select("doc_id", (1 / (1 + F.exp(-F.col("z"))) - F.col("quality")).alias("off")))
    slopes = cells.join(off, "doc_id").groupBy("item_id").agg(F.sum("off").alias("off")).join(coefs, "item_id")
    slopes = slopes.select((F.col("off") + F.col("coef") / F.lit(fit.c)).alias("slope"))
    slopes = slopes.unionByName(off.agg(F.sum("off").alias("slope")))
    flat = slopes.agg(F.count(F.lit(1)).alias("coefficients"), (F.max(F.abs("slope")) / F.lit(rows.count())).alias("steepest"))
    return flat.select("coefficients", (F.col("steepest") < 2 * sparse_logit.SETTLED).alias("flat"))


def odds_of_rule(spark: SparkSession, d: str) -> DataFrame:
    """Odds table of coefficients given by a rule, with the support of each word."""
    _, dictionary = _word_rows(spark, d)
    coefs = dictionary.select(F.col("item").alias("variable"), ((F.length("item") % 7 - 3) / 4).alias("coef"))
    return rounded(regress.odds_table(coefs, dictionary.select("item", "n")), 6)


def classifier_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.classification_report(_labelled(spark, d), [0, 1]), 6)


def confusion_three(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion_matrix(_labelled(spark, d), [0, 1, 2], "level", "band")


def confusion_roc(spark: SparkSession, d: str) -> DataFrame:
    points = evaluate.roc(_labelled(spark, d))
    return rounded(points, 6)


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    both = evaluate.auc(rows).withColumn("k", F.lit(1)).join(evaluate.accuracy(rows).withColumn("k", F.lit(1)), "k")
    return rounded(both.drop("k"), 6)


def r2_by_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    return rounded(evaluate.r2(rows, "l_extendedprice", "guess", ["l_returnflag"]), 6)


def _document_bands(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    docs = _documents(spark, d).select(
        "doc_id",
        F.size(tx.words("text")).cast("double").alias("n_words"),
        F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("n_upper"),
        F.regexp_count("text", F.lit(r"\n")).cast("double").alias("n_lines"),
        (F.col("lang") == "en").cast("double").alias("is_en"),
        F.when(F.col("n_chars") > 3000, 2).when(F.col("n_chars") > 1000, 1).otherwise(0).alias("band"),
    )
    return materialize(docs), ["n_words", "n_upper", "n_lines", "is_en"]


def gbt_importance(spark: SparkSession, d: str) -> DataFrame:
    docs, features = _document_bands(spark, d)
    fit = trees.gbt_multiclass(docs, features, "band", min_rows=20)
    return rounded(trees.importance(fit, spark), 6)


def shapley_values(spark: SparkSession, d: str) -> DataFrame:
    """What holds for the values of any fit: one per feature, adding up to the score that the trees themselves give."""
    docs, features = _document_bands(spark, d)
    fit = trees.gbt_multiclass(docs, features, "band", min_rows=20)
    values = trees.shapley_exact(fit, docs, "doc_id")
    own = fit.score(docs).select("doc_id", F.posexplode("raw").alias("class", "score"))
    sums = values.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("features"), (F.sum("shapley") + F.max("base")).alias("total"))
    both = sums.join(own, ["doc_id", "class"])
    return both.select("doc_id", "class", "features", (F.abs(F.col("total") - F.col("score")) < 1e-6).alias("adds_up"))


def shapley_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute value of each feature for each class."""
    docs, features = _document_bands(spark, d)
    return rounded(trees.shapley_summary(trees.shapley_exact(trees.gbt_multiclass(docs, features, "band", min_rows=20), docs, "doc_id")), 6)



def _customer_profile(spark: SparkSession, d: str) -> DataFrame:
    """Customers by their orders; the balance is lacking for every ninth one."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"), F.max("o_totalprice").alias("max_price")
    )
    balance = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("balance")
    return orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", "n_orders", "avg_price", "max_price", balance
    )


PROFILE = ["n_orders", "avg_price", "max_price", "balance"]


def impute_pmm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.impute_pmm(materialize(_customer_profile(spark, d)), "c_custkey", PROFILE), 4)


def _profile_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(_customer_profile(spark, d).fillna(0.0, ["balance"]))
    return segments.scaled_vectors(rows, "c_custkey", PROFILE)


def kmeans_best(spark: SparkSession, d: str) -> DataFrame:
    vectors = _profile_vectors(spark, d).cache()
    model, _ = segments.kmeans_best(vectors, 7, 5)
    return segments.assign_clusters(model, vectors).select("c_custkey", "cluster")


def elbow(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.elbow(_profile_vectors(spark, d)), 3)


def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.pca_2d(_profile_vectors(spark, d), "c_custkey"), 4)


def imputed_values(spark: SparkSession, d: str) -> DataFrame:
    """What holds for any imputation: what was observed is as it was, what was not has a value that was observed."""
    given = materialize(_customer_profile(spark, d))
    filled = materialize(segments.impute_pmm(given, "c_custkey", PROFILE).withColumnRenamed("balance", "filled"))
    seen = given.where("balance IS NOT NULL").select(F.col("balance").alias("filled")).distinct().withColumn("known", F.lit(True))
    both = filled.join(given.select("c_custkey", "balance"), "c_custkey").join(seen, "filled", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("balance").isNull(), 1)).alias("n_filled"),
        F.bool_and(F.coalesce(F.col("balance") == F.col("filled"), F.lit(True))).alias("kept"), F.bool_and(F.coalesce("known", F.lit(False))).alias("observed"),
    )


def nearest_centres(spark: SparkSession, d: str) -> DataFrame:
    """What holds for any k-means: every row is in the cluster whose centre is nearest; distances by plain columns."""
    vectors = materialize(_profile_vectors(spark, d))
    model, _ = segments.kmeans_best(vectors, 7, 5)
    x = vector_to_array("features")
    away = [sum((F.get(x, F.lit(i)) - float(v)) ** 2 for i, v in enumerate(c)) for c in model.clusterCenters()]
    rows = model.transform(vectors).select("prediction", F.array(*away).alias("away"))
    near = F.get("away", F.col("prediction")) <= F.array_min("away") + 1e-9
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(near).alias("nearest"), (F.countDistinct("prediction") <= 7).alias("at_most_k"))


def falling_costs(spark: SparkSession, d: str) -> DataFrame:
    """What holds for any elbow curve: all numbers of clusters, and more of them never cost much more."""
    curve = materialize(segments.elbow(_profile_vectors(spark, d)))
    before = curve.select((F.col("k") + 1).alias("k"), F.col("wss").alias("wider"))
    return curve.join(before, "k", "left").select("k", ((F.col("wss") > 0) & F.coalesce(F.col("wss") <= 1.1 * F.col("wider"), F.lit(True))).alias("falls"))


def component_identity(spark: SparkSession, d: str) -> DataFrame:
    """What holds for the first two components: centred like the rows, not correlated, the first one wider than any column."""
    flat = segments.pca_2d(_profile_vectors(spark, d), "c_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.corr("pc1", "pc2")).alias("r"), F.variance("pc1").alias("v1"), F.variance("pc2").alias("v2"),
        F.greatest(F.abs(F.avg("pc1")), F.abs(F.avg("pc2"))).alias("off"),
    )
    return flat.select("n", ((F.col("r") < 1e-6) & (F.col("off") < 1e-6)).alias("apart"), ((F.col("v1") >= F.col("v2")) & (F.col("v1") >= 1 - 1e-9)).alias("wide"))


def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means on the embedding vectors, counted per given label."""
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings")
    vectors = rows.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).cache()
    model, _ = segments.kmeans_best(vectors, 7, 5)
    found = segments.assign_clusters(model, vectors).select("vec_id", "cluster")
    return found.join(rows.select("vec_id", "label"), "vec_id").groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))


def _word_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = _tokens(spark, d)
    return materialize(terms.term_counts(terms.drop_stop_words(tokens, materialize(_stop_words(tokens))), ["doc_id"]))


def document_terms(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the document-term matrix, described so that SQL can say them: cells, tokens, and ids weighted by counts."""
    counts = terms.row_term_counts(_documents(spark, d), "doc_id", "text")
    stop = materialize(ranks.top_k(counts.groupBy("word").agg(F.sum("n").alias("n")), "n", 20, ["word"]).select("word"))
    rows, _ = to_dtm(terms.drop_stop_words(counts, stop), "doc_id", "word", "n")
    weighed = F.aggregate(F.zip_with("term_ids", "counts", lambda i, n: i * n), F.lit(0).cast("long"), lambda a, x: a + x)
    tokens = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("term_ids").alias("cells"), tokens.alias("tokens"), weighed.alias("weighed"))


def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    model = topics.lda(_word_counts(spark, d), "doc_id", "word", "n")
    best = materialize(topics.top_terms(topics.tidy_beta(model)))
    return rounded(best.join(topics.name_topics(best), "topic"), 5)


def lda_term_sums(spark: SparkSession, d: str) -> DataFrame:
    """What holds for the term weights of any fit: all terms in all topics, adding up to one, none below zero."""
    beta = topics.tidy_beta(topics.lda(_word_counts(spark, d), "doc_id", "word", "n"))
    return beta.groupBy("topic").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("beta"), 6).alias("total"), (F.min("beta") >= 0).alias("valid"))


def lda_document_topics(spark: SparkSession, d: str) -> DataFrame:
    """What holds for the topic shares of any fit: all topics in every document, adding up to one, none below zero."""
    gamma = topics.tidy_gamma(topics.lda(_word_counts(spark, d), "doc_id", "word", "n"))
    return gamma.groupBy("document").agg(F.count(F.lit(1)).alias("topics"), F.round(F.sum("gamma"), 6).alias("total"), (F.min("gamma") > 0).alias("valid"))


def topic_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(topics.topic_search(_word_counts(spark, d), "doc_id", "word", "n"), 4)


def topic_criteria(spark: SparkSession, d: str) -> DataFrame:
    """The measures that the search ranks models by, of two topics given by a rule: words of even and of odd length."""
    counts = materialize(terms.term_counts(_tokens(spark, d), ["doc_id"]))
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("topic", F.explode(F.array(F.lit(1), F.lit(2))))
    weight = F.when(F.length("word") % 2 + 1 == F.col("topic"), F.col("n")).otherwise(0) + 1.0
    words = materialize(words.select("topic", F.col("word").alias("term"), weight.alias("w")))
    beta = words.join(words.groupBy("topic").agg(F.sum("w").alias("total")), "topic").select("topic", "term", (F.col("w") / F.col("total")).alias("beta"))
    shares = counts.groupBy(F.col("doc_id").alias("document")).agg(F.sum("n").alias("n"), F.sum(F.when(F.length("word") % 2 == 0, F.col("n")).otherwise(0)).alias("even"))
    shares = materialize(shares.withColumn("g", (F.col("even") + 1) / (F.col("n") + 2)))
    gamma = shares.select("document", F.lit(1).alias("topic"), F.col("g").alias("gamma")).unionByName(shares.select("document", F.lit(2).alias("topic"), (1 - F.col("g")).alias("gamma")))
    found = compare_topics(beta, gamma, shares.select("document", "n"))
    return spark.createDataFrame([(m, round(v, 6)) for m, v in found.items()], "criterion string, value double")


# topics given by a rule on word length, so that SQL can say what the tables must hold


def _rule_beta(spark: SparkSession, d: str) -> DataFrame:
    counts = terms.term_counts(_tokens(spark, d).withColumn("topic", F.length("word") % 5 + 1), ["topic"])
    total = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    return counts.join(total, "topic").select("topic", F.col("word").alias("term"), (F.col("n") / F.col("total")).alias("beta"))


def _rule_gamma(spark: SparkSession, d: str) -> DataFrame:
    counts = terms.term_counts(_tokens(spark, d).withColumn("topic", F.length("word") % 5 + 1), ["doc_id"], "topic")
    total = counts.groupBy("doc_id").agg(F.sum("n").alias("total"))
    return counts.join(total, "doc_id").select(F.col("doc_id").alias("document"), "topic", (F.col("n") / F.col("total")).alias("gamma"))


def topic_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(topics.top_terms(materialize(_rule_beta(spark, d))), 8)


def _names(spark: SparkSession, d: str) -> DataFrame:
    return materialize(topics.name_topics(topics.top_terms(materialize(_rule_beta(spark, d)))))


def topic_names(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d)


def topic_frequency(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_frequency(_rule_gamma(spark, d), _names(spark, d))


def _rule_reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scores = sentiment.afinn_sentiment(_documents(spark, d), "doc_id", "text", materialize(_afinn(_tokens(spark, d))))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.pmod("doc_id", F.lit(97)).alias("listing_id"))
    reviews = docs.join(scores.withColumnRenamed("doc_id", "id"), "id", "left")
    labels = table(spark, d, "labels")
    rated = labels.groupBy(F.pmod("doc_id", F.lit(97)).alias("id")).agg((70 + 30 * F.round(F.avg("quality"), 1)).alias("review_scores_rating"))
    return reviews, rated


def topic_severity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(topics.topic_severity(_rule_gamma(spark, d), _names(spark, d), _rule_reviews(spark, d)[0]), 4)


def topic_impact(spark: SparkSession, d: str) -> DataFrame:
    reviews, rated = _rule_reviews(spark, d)
    return rounded(topics.topic_impact(_rule_gamma(spark, d), _names(spark, d), reviews, rated), 4)


def severity_impact_trend(spark: SparkSession, d: str) -> DataFrame:
    reviews, rated = _rule_reviews(spark, d)
    gamma, names = materialize(_rule_gamma(spark, d)), _names(spark, d)
    both = topics.severity_and_impact(topics.topic_severity(gamma, names, reviews), topics.topic_impact(gamma, names, reviews, rated))
    return rounded(trend(both, "avg_overall_rating", "avg_sentiment"), 3)


QUERIES = {
    f.__name__: f
    for f in (
        polygon_area, ols_summary, relative_importance, one_hot_standardize, lasso_cv, influence_index, influence_of_rule, logit_odds, logit_optimum, odds_of_rule,
        classifier_report, confusion_three, confusion_roc, roc_auc, r2_by_flag, gbt_importance, shapley_values, shapley_ranking, impute_pmm, imputed_values,
        kmeans_best, nearest_centres, falling_costs, component_identity, elbow, pca_2d, embedding_clusters, document_terms, lda_topics, lda_term_sums, lda_document_topics, topic_search, topic_criteria, topic_top_terms,
        topic_names, topic_frequency, topic_severity, topic_impact, severity_impact_trend,
    )
}

# --- SQL ------------------------------------------------------------------------------------

_E2 = WGS84_F * (2 - WGS84_F)


def northing_sql(lat: str) -> str:
    """q of the equal-area projection at a latitude given in degrees."""
    s, e = f"sin(radians({lat}))", _E2**0.5
    return f"({1 - _E2!r}::DOUBLE * ({s} / (1 - {_E2!r}::DOUBLE * {s} * {s}) - {1 / (2 * e)!r}::DOUBLE * ln((1 - {e!r}::DOUBLE * {s}) / (1 + {e!r}::DOUBLE * {s}))))"


def box_sql(lat: str, side: str) -> str:
    """Square kilometres of a box of ``side`` degrees whose lower edge is at ``lat``."""
    return f"({WGS84_A**2!r}::DOUBLE / 2e6 * radians({side}) * ({northing_sql(f'({lat} + {side})')} - {northing_sql(lat)}))"


_LAB = """lab AS (SELECT doc_id, quality AS label, n_chars / (n_chars + 2000.0::DOUBLE) AS score, (n_chars / (n_chars + 2000.0::DOUBLE) > 0.5)::INT AS prediction,
  CASE WHEN n_chars > 3000 THEN 2 WHEN n_chars > 1000 THEN 1 ELSE 0 END AS band, quality + toxic AS level FROM labels JOIN documents USING (doc_id))"""
_COV = """c AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_tax) AS m2, var_pop(l_extendedprice) AS vy, var_pop(l_quantity) AS v1,
  var_pop(l_tax) AS v2, covar_pop(l_extendedprice, l_quantity) AS c1, covar_pop(l_extendedprice, l_tax) AS c2, covar_pop(l_quantity, l_tax) AS c12 FROM lineitem),
b AS (SELECT *, v1 * v2 - c12 * c12 AS det, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM c),
s AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (b1 * c1 + b2 * c2) / vy AS r2, n * (vy - b1 * c1 - b2 * c2) / (n - 3) AS s2 FROM b)"""
_TOPIC = """tt AS (SELECT doc_id, pos, word, length(word) % 5 + 1 AS topic FROM tok),
beta AS (SELECT topic, word AS term, count(*) / (sum(count(*)) OVER (PARTITION BY topic))::DOUBLE AS beta FROM tt GROUP BY topic, word),
nm AS (SELECT topic, topic || ') ' || CASE WHEN max(beta) FILTER (k = 2) / max(beta) FILTER (k = 1) >= 0.5
    THEN max(term) FILTER (k = 1) || ', ' || max(term) FILTER (k = 2) ELSE max(term) FILTER (k = 1) END AS topic_name
  FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY beta DESC, term) AS k FROM beta) WHERE k <= 2 GROUP BY topic),
gm AS (SELECT doc_id, topic, count(*) / (sum(count(*)) OVER (PARTITION BY doc_id))::DOUBLE AS gamma FROM tt GROUP BY doc_id, topic),
ng AS (SELECT doc_id, topic, topic_name FROM gm JOIN nm USING (topic) WHERE gamma > 0.1)"""
_SEV = "sev AS (SELECT topic, topic_name, -avg(afinn_sentiment) AS s FROM ng JOIN sc USING (doc_id) GROUP BY 1, 2)"
_IMP = "imp AS (SELECT topic, topic_name, avg(r / 20) AS a, count(*) AS n FROM ng JOIN ls ON ls.id = doc_id % 97 GROUP BY 1, 2)"

_LWORD = f"""{_TOK}, sup AS (SELECT word, count(DISTINCT doc_id) AS n FROM tok JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT doc_id) >= {WORD_SUPPORT})"""

SQL = {
    "polygon_area": f"""
WITH b AS (SELECT c_custkey, c_custkey % 150 - 75.0::DOUBLE AS lat FROM customer)
SELECT c_custkey, round({box_sql('lat', '1.0::DOUBLE')} - CASE WHEN c_custkey % 2 = 0 THEN {box_sql('(lat + 0.25::DOUBLE)', '0.5::DOUBLE')} ELSE 0 END
  + CASE WHEN c_custkey % 3 = 0 THEN {box_sql('lat', '0.5::DOUBLE')} ELSE 0 END, 4) AS sq_km FROM b""",
    "ols_summary": f"""WITH {_COV}, t AS (
SELECT '(Intercept)' AS term, b0 AS e, sqrt(s2 * (1 + (m1 * m1 * v2 - 2 * m1 * m2 * c12 + m2 * m2 * v1) / det) / n) AS se, r2, n FROM s
UNION ALL SELECT 'l_quantity', b1, sqrt(s2 * v2 / det / n), r2, n FROM s UNION ALL SELECT 'l_tax', b2, sqrt(s2 * v1 / det / n), r2, n FROM s)
SELECT term, round(e, 3) AS estimate, round(se, 3) AS std_error, round(e / se, 3) AS t, round(r2, 3) AS r2, n FROM t""",
    "relative_importance": f"""WITH {_COV}, q AS (SELECT r2, c1 * c1 / (v1 * vy) AS r1, c2 * c2 / (v2 * vy) AS r22 FROM s)
SELECT 'l_quantity' AS term, round((r1 + r2 - r22) / 2 / r2, 4) AS share FROM q UNION ALL SELECT 'l_tax', round((r22 + r2 - r1) / 2 / r2, 4) FROM q""",
    "one_hot_standardize": """
WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 4) AS l_quantity, round((l_discount - md) / sd, 4) AS l_discount, round((l_tax - mt) / st, 4) AS l_tax,
  (l_returnflag = 'A')::INT AS "l_returnflag_A", (l_returnflag = 'N')::INT AS "l_returnflag_N", (l_returnflag = 'R')::INT AS "l_returnflag_R",
  (l_linestatus = 'F')::INT AS "l_linestatus_F", (l_linestatus = 'O')::INT AS "l_linestatus_O" FROM lineitem, m""",
    "classifier_report": f"""WITH {_LAB},
k AS (SELECT c, count(*) FILTER (label = c) AS t, count(*) FILTER (prediction = c) AS p, count(*) FILTER (label = c AND prediction = c) AS b, count(*) AS n
  FROM lab, range(2) r(c) GROUP BY c),
s AS (SELECT c, t, n, b, coalesce(b / nullif(p, 0)::DOUBLE, 0) AS pr, coalesce(b / nullif(t, 0)::DOUBLE, 0) AS re FROM k),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM s),
o AS (SELECT c::VARCHAR AS class, pr, re, f1, t FROM f
  UNION ALL SELECT 'accuracy', sum(b) / max(n)::DOUBLE, sum(b) / max(n)::DOUBLE, sum(b) / max(n)::DOUBLE, max(n) FROM f
  UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1), max(n) FROM f
  UNION ALL SELECT 'weighted avg', sum(pr * t) / max(n), sum(re * t) / max(n), sum(f1 * t) / max(n), max(n) FROM f)
SELECT class, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f1, 6) AS f1, t AS support FROM o""",
    "confusion_three": f"""WITH {_LAB} SELECT c::INTEGER AS label, count(*) FILTER (level = c AND band = 0) AS pred_0, count(*) FILTER (level = c AND band = 1) AS pred_1,
  count(*) FILTER (level = c AND band = 2) AS pred_2 FROM lab, range(3) r(c) GROUP BY c""",
    "confusion_roc": f"""WITH {_LAB}, g AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM lab GROUP BY 1),
r AS (SELECT score, n, p, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g)
SELECT round(score, 6) AS score, round(cp / ap::DOUBLE, 6) AS tpr, round(cn / an::DOUBLE, 6) AS fpr, round(n / an::DOUBLE * ((cp - p / 2.0::DOUBLE) / ap), 6) AS auc_part FROM r""",
    "roc_auc": f"""WITH {_LAB} SELECT round(sum((a.score > b.score)::INT + 0.5::DOUBLE * (a.score = b.score)::INT) / count(*), 6) AS auc,
  (SELECT round(avg((label = prediction)::INT), 6) FROM lab) AS accuracy FROM lab a JOIN lab b ON a.label = 1 AND b.label = 0""",
    "r2_by_flag": """SELECT l_returnflag, round(1 - sum((l_extendedprice - l_quantity * 1500) ^ 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1""",
    "imputed_values": """WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
SELECT count(*) AS n, count(*) FILTER (c_custkey % 9 = 0) AS n_filled, true AS kept, true AS observed FROM c""",
    "nearest_centres": "SELECT count(*) AS n, true AS nearest, true AS at_most_k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "falling_costs": "SELECT k::INTEGER AS k, true AS falls FROM range(2, 21) r(k)",
    "component_identity": "SELECT count(*) AS n, true AS apart, true AS wide FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "influence_of_rule": """WITH p AS (SELECT l_returnflag, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, 'line ' || l_linenumber AS variable, avg(l_quantity) AS coef FROM lineitem WHERE l_linenumber <> 1 OR l_returnflag = 'N' GROUP BY 1, 2),
x AS (SELECT variable, l_returnflag AS g, coef / price AS v FROM c JOIN p USING (l_returnflag))
SELECT variable, round(max(v) FILTER (g = 'A'), 8) AS "A", round(max(v) FILTER (g = 'N'), 8) AS "N", round(max(v) FILTER (g = 'R'), 8) AS "R",
  round(avg(v), 8) AS average, count(v)::INTEGER AS held FROM x GROUP BY 1 HAVING count(v) >= 3""",
    "logit_optimum": f"""WITH {_LWORD} SELECT count(*) + 1 AS coefficients, true AS flat FROM sup""",
    "odds_of_rule": f"""WITH {_LWORD} SELECT word AS variable, (length(word) % 7 - 3) / 4.0::DOUBLE AS coef, n,
  round((exp((length(word) % 7 - 3) / 4.0::DOUBLE) - 1) * 100, 6) AS odds_change_pct FROM sup""",
    "shapley_values": "SELECT doc_id, class::INTEGER AS class, 4::BIGINT AS features, true AS adds_up FROM documents, range(3) r(class)",
    "document_terms": f"""WITH {_TOK}, {_STOP}, c AS (SELECT doc_id, word, count(*) AS n FROM tok WHERE word NOT IN (SELECT word FROM stop) GROUP BY 1, 2),
v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS term_id FROM c GROUP BY 1)
SELECT doc_id, count(*)::INTEGER AS cells, sum(n)::BIGINT AS tokens, sum(n * term_id)::BIGINT AS weighed FROM c JOIN v USING (word) GROUP BY 1""",
    "lda_term_sums": f"""WITH {_TOK}, {_STOP} SELECT topic::INTEGER AS topic, count(DISTINCT word) AS terms, 1.0::DOUBLE AS total, true AS valid
FROM tok, range(1, 41) r(topic) WHERE word NOT IN (SELECT word FROM stop) GROUP BY 1""",
    "lda_document_topics": f"""WITH {_TOK}, {_STOP} SELECT doc_id AS document, 40::BIGINT AS topics, 1.0::DOUBLE AS total, true AS valid
FROM tok WHERE word NOT IN (SELECT word FROM stop) GROUP BY 1""",
    "topic_criteria": f"""WITH {_TOK}, w AS (SELECT word, count(*) AS n, length(word) % 2 AS odd FROM tok GROUP BY 1),
raw AS (SELECT CASE WHEN odd = 0 THEN n ELSE 0 END + 1.0::DOUBLE AS a, CASE WHEN odd = 1 THEN n ELSE 0 END + 1.0::DOUBLE AS b FROM w),
p AS (SELECT a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM raw),
m AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * ln(a / b)) AS kl, sum(b * ln(b / a)) AS lk FROM p),
e AS (SELECT *, sqrt((aa + bb + sqrt((aa - bb) ^ 2 + 4 * ab * ab)) / 2) AS s1, sqrt((aa + bb - sqrt((aa - bb) ^ 2 + 4 * ab * ab)) / 2) AS s2 FROM m),
g AS (SELECT count(*) AS n, (count(*) FILTER (length(word) % 2 = 0) + 1) / (count(*) + 2)::DOUBLE AS g FROM tok GROUP BY doc_id),
l AS (SELECT sum(n * g) / max(n) AS l1, sum(n * (1 - g)) / max(n) AS l2 FROM g)
SELECT 'cao_juan' AS criterion, round(ab / sqrt(aa * bb), 6) AS value FROM m
UNION ALL SELECT 'arun', round(s1 * ln(s1 / l1) + s2 * ln(s2 / l2) + l1 * ln(l1 / s1) + l2 * ln(l2 / s2), 6) FROM e, l
UNION ALL SELECT 'deveaud', round((kl + lk) / 4, 6) FROM m""",
    "topic_top_terms": f"""WITH {_TOK}, {_TOPIC} SELECT topic::INTEGER AS topic, term, round(beta, 8) AS beta FROM beta QUALIFY rank() OVER (PARTITION BY topic ORDER BY beta DESC) <= 10""",
    "topic_names": f"WITH {_TOK}, {_TOPIC} SELECT topic::INTEGER AS topic, topic_name FROM nm",
    "topic_frequency": f"WITH {_TOK}, {_TOPIC} SELECT topic::INTEGER AS topic, topic_name, count(*) AS n FROM ng GROUP BY 1, 2",
    "topic_severity": f"WITH {_TOK}, {_BING}, {_AFINN}, {_SCORE}, {_TOPIC}, {_SEV} SELECT topic::INTEGER AS topic, topic_name, round(s, 4) AS avg_sentiment FROM sev",
    "topic_impact": f"WITH {_TOK}, {_BING}, {_AFINN}, {_SCORE}, {_TOPIC}, {_IMP} SELECT topic::INTEGER AS topic, topic_name, round(a, 4) AS avg_overall_rating, n AS \"count\" FROM imp",
    "severity_impact_trend": f"""WITH {_TOK}, {_BING}, {_AFINN}, {_SCORE}, {_TOPIC}, {_SEV}, {_IMP}
SELECT round(regr_slope(s, a), 3) AS slope, round(regr_intercept(s, a), 3) AS intercept, round(corr(s, a), 3) AS r FROM sev JOIN imp USING (topic)""",
}
