"""What guests complain about, and how badly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import text as tx
from staylens.operators import language, sentiment, topics
from staylens.operators.groups import density_curve, trend
from staylens.operators.ranks import order_rank, sample_n
from staylens.operators.reshape import anti_join, natural_join, to_dtm
from staylens.runtime import materialize

# Start of the year the ratings are computed from, compounds, and words that say nothing here.
SINCE = "2019-02-27"
COMPOUNDS = ["check in", "check out", "air bnb"]
EMPTY_WORDS = [
    "stay", "space", "host", "cabin", "house", "airbnb", "condo", "apartment", "issue", "home", "property", "hosts",
    "night", "issues", "experience", "guest", "guests", "air bnb", "day", "la", "de",
]


def score_reviews(
    reviews: DataFrame,
    profiles: DataFrame,
    bing: DataFrame,
    afinn: DataFrame,
    since: str = SINCE,
    keep: str = "en",
    language_chars: int | None = None,
) -> DataFrame:
    """Recent reviews in one language with both sentiment scores. Review ids must be unique.

    The language is told from whole texts; ``language_chars`` limits it to the first characters.
    """
    recent = reviews.where(F.col("date") > F.lit(since).cast("date"))
    spoken = language.detect_language(recent, "id", "comments", profiles, language_chars).select("id", "language")
    kept = language.filter_language(natural_join(recent, spoken), keep)
    return sentiment.add_sentiment(kept, "id", "comments", bing, afinn)


def complaint_tokens(reviews: DataFrame, listings: DataFrame, stop_words: DataFrame) -> DataFrame:
    """(id, word) of clearly negative reviews of whole homes: no digits, compounds joined, stop words gone."""
    negative = reviews.where(F.col("afinn_sentiment") < -3).select("id", "listing_id", "comments")
    places = listings.select(F.col("id").alias("listing_id"), "state", "room_type")
    negative = negative.join(places, "listing_id").where((F.col("state") != "HI") & (F.col("room_type") == "Entire home/apt"))
    tokens = F.filter(tx.words("comments"), lambda w: ~w.rlike("[0-9]"))
    tokens = F.transform(tokens, lambda w: tx.replace_first(w, "beds", "bed"))
    rows = negative.select("id", tokens.alias("tokens"))
    rows = rows.select("id", F.explode(tx.recode_phrases("tokens", COMPOUNDS)).alias("word")).where(F.col("word").isNotNull())
    return anti_join(rows, stop_words, "word")


def complaint_terms(tokens: DataFrame, unwanted: Sequence[str] = tuple(EMPTY_WORDS)) -> DataFrame:
    """(id, word, n) without the words that say nothing."""
    counts = tokens.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(~F.col("word").isin(list(unwanted)))


def complaint_topics(
    reviews: DataFrame, listings: DataFrame, stop_words: DataFrame, k: int = 40, seed: int = 1234, max_iter: int = 50, n_terms: int = 10
) -> dict[str, DataFrame]:
    """Topics of the negative reviews: term weights, document shares, best terms and generated names."""
    counts = materialize(complaint_terms(complaint_tokens(reviews, listings, stop_words)))
    dtm, dictionary = to_dtm(counts, "id", "word", "n")
    model = topics.lda(counts, "id", "word", "n", k, seed, max_iter)
    if model is None:
        raise ValueError("no negative review has a word left")
    beta = topics.tidy_beta(model)
    best = materialize(topics.top_terms(beta, n_terms))
    return {
        "counts": counts,
        "dtm": dtm,
        "dictionary": dictionary,
        "beta": beta,
        "gamma": materialize(topics.tidy_gamma(model)),
        "top_terms": best,
        "names": topics.name_topics(best),
    }


def complaint_impact(gamma: DataFrame, names: DataFrame, reviews: DataFrame, listings: DataFrame) -> dict[str, DataFrame]:
    """Frequency, severity and impact of each topic, the two side by side, and the line through them."""
    frequency = topics.topic_frequency(gamma, names)
    severity = materialize(topics.topic_severity(gamma, names, reviews))
    impact = materialize(topics.topic_impact(gamma, names, reviews, listings))
    both = topics.severity_and_impact(severity, impact)
    return {
        "frequency": order_rank(materialize(frequency), "n"),
        "severity": severity,
        "impact": impact,
        "both": both,
        "trend": trend(both, "avg_overall_rating", "avg_sentiment"),
    }


def review_charts(reviews: DataFrame, listings: DataFrame, n: int = 10_000, points: int = 512) -> dict[str, DataFrame]:
    """Density of the sentiment, sentiment by rating, ratings with and without negative reviews."""
    drawn = sample_n(reviews.select("id", F.coalesce("afinn_sentiment", F.lit(0)).alias("afinn_sentiment")), n, "id")
    split = materialize(sentiment.negative_review_split(reviews, listings))
    return {
        "sentiment_density": density_curve(drawn, "afinn_sentiment", points=points, limits=(-10.0, 30.0)),
        "by_rating": sentiment.sentiment_by_rating(reviews, listings),
        "negative_split": split,
        "rating_density": sentiment.rating_distributions(split, n, points=points),
    }
