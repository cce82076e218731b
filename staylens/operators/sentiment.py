"""Lexicon sentiment of texts and its relation to ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.clean import label_if, rescale_rating
from staylens.functions.text import words
from staylens.operators.groups import density_curve
from staylens.operators.phrases import WeightTable, shipped, sum_batches
from staylens.operators.ranks import sample_n
from staylens.runtime import broadcast_if_small


def bing_weights(lexicon: DataFrame) -> DataFrame:
    """(word, bing): positive entries minus negative entries of each word."""
    sign = F.when(F.col("sentiment") == "positive", 1).when(F.col("sentiment") == "negative", -1)
    return lexicon.withColumn("s", sign).where(F.col("s").isNotNull()).groupBy("word").agg(F.sum("s").alias("bing"))


def afinn_weights(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("word").agg(F.sum("value").cast("long").alias("afinn"))


def lexicon_join(tokens: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Tokens that a lexicon knows, with its columns."""
    return tokens.join(broadcast_if_small(lexicon), word)


def _in_rows(df: DataFrame, id_col: str, text: str, weights: DataFrame, names: dict[str, str]) -> DataFrame | None:
    """Ids with the sums of the weights over the words of each text, null without a known word; None if the lexicon is large."""
    table = shipped(weights.select("word", *names))
    if table is None:
        return None
    shared = df.sparkSession.sparkContext.broadcast(WeightTable(table, list(names)))
    rows = df.select(id_col, words(text).alias("__words"))
    schema = df.select(id_col, *[F.lit(None).cast("long").alias(out) for out in names.values()]).schema
    return rows.mapInArrow(sum_batches(shared, 1, schema.names), schema)


def _sums(df: DataFrame, id_col: str, text: str, weights: DataFrame, names: dict[str, str]) -> DataFrame:
    """Sums by id; only one row of sums per text is shuffled, unless the lexicon is too large for the tasks."""
    rows = _in_rows(df, id_col, text, weights, names)
    if rows is None:
        hits = lexicon_join(df.select(id_col, F.explode(words(text)).alias("word")), weights)
        rows = hits.select(id_col, *[F.col(c).alias(out) for c, out in names.items()])
    scored = rows.where(F.coalesce(*names.values()).isNotNull())
    return scored.groupBy(id_col).agg(*[F.sum(out).alias(out) for out in names.values()])


def bing_sentiment(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(id, bing_sentiment): positive minus negative words; texts without a known word are absent."""
    return _sums(df, id_col, text, bing_weights(lexicon), {"bing": "bing_sentiment"})


def afinn_sentiment(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(id, afinn_sentiment): sum of word values; texts without a known word are absent."""
    return _sums(df, id_col, text, afinn_weights(lexicon), {"afinn": "afinn_sentiment"})


def add_sentiment(df: DataFrame, id_col: str, text: str, bing: DataFrame, afinn: DataFrame) -> DataFrame:
    """Both scores beside each row, null where the text has no known word.

    One pass: the two lexicons are merged first, so every word is looked up once.
    """
    weights = bing_weights(bing).join(afinn_weights(afinn), "word", "full")
    scores = _sums(df, id_col, text, weights, {"bing": "bing_sentiment", "afinn": "afinn_sentiment"})
    return df.join(scores, id_col, "full")


def sentiment_by_rating(reviews: DataFrame, listings: DataFrame, least: float = 3.5) -> DataFrame:
    """Mean sentiment and number of listings per overall rating; the sentiment is averaged per listing first."""
    per_listing = reviews.groupBy("listing_id").agg(
        F.avg(F.coalesce("afinn_sentiment", F.lit(0))).alias("avg_sentiment")
    )
    rated = listings.select(F.col("id").alias("listing_id"), (F.col("review_scores_rating") / 20).alias("review_scores_rating"))
    both = per_listing.join(rated, "listing_id").where(F.col("review_scores_rating") >= least)
    return both.groupBy("review_scores_rating").agg(F.avg("avg_sentiment").alias("avg_sentiment"), F.count(F.lit(1)).alias("count"))


def negative_review_split(reviews: DataFrame, listings: DataFrame, threshold: float = -3) -> DataFrame:
    """(listing_id, has_negative_review, review_scores_rating): does a listing have a clearly negative review."""
    negative = F.coalesce("afinn_sentiment", F.lit(0)) < threshold
    counts = reviews.groupBy("listing_id").agg(
        F.count(F.when(negative, 1)).alias("negative"), F.count(F.when(~negative, 1)).alias("non_negative")
    )
    label = label_if(F.col("negative") > 0, "Has Negative Review(s)", "No Negative Reviews")
    rated = listings.select(F.col("id").alias("listing_id"), (F.col("review_scores_rating") / 20).alias("review_scores_rating"))
    return counts.withColumn("has_negative_review", label).join(rated, "listing_id").select(
        "listing_id", "has_negative_review", "review_scores_rating"
    )


def rating_distributions(split: DataFrame, n: int = 10_000, seed: int = 123, points: int = 512) -> DataFrame:
    """Density of ratings of listings with negative reviews and of a sample of those without."""
    without = sample_n(split.where(F.col("has_negative_review") == "No Negative Reviews"), n, "listing_id", seed)
    both = split.where(F.col("has_negative_review") != "No Negative Reviews").unionByName(without)
    return density_curve(both, "review_scores_rating", ["has_negative_review"], points, limits=(3.5, 5.0))
