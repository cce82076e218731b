"""What raises the odds that guests rate a stay as good value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import clean
from staylens.functions.geo import area_sq_km
from staylens.functions.text import explode_items
from staylens.operators import evaluate
from staylens.operators.groups import sample_std
from staylens.operators.ranks import dedupe_last, quantiles, train_test
from staylens.operators.regress import logit_cv, logit_cv_sparse, odds_table, one_hot, standardize
from staylens.operators.sparse_logit import item_dictionary, sparse_items
from staylens.plans.common import clean_listings, with_items
from staylens.runtime import materialize

CLASSES = [0, 1]


def _scores(scored: DataFrame) -> dict[str, DataFrame]:
    scored = materialize(scored.select(F.col("has_value").alias("label"), "prediction", "score"))
    return {
        "accuracy": evaluate.accuracy(scored),
        "confusion": evaluate.confusion_matrix(scored, CLASSES),
        "report": evaluate.classification_report(scored, CLASSES),
        "roc": evaluate.roc(scored),
    }


def amenity_rows(listings: DataFrame, min_support: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Last snapshot of each rated listing with the numbers of its well-supported amenities, and their dictionary."""
    df = listings.where(
        (F.col("review_scores_rating") <= 5) & (F.col("review_scores_value") <= 5) & (F.col("number_of_reviews") >= 5)
    )
    df = df.select("id", "filedate", "amenities", "review_scores_value", "price")
    df = dedupe_last(df, ["id"], ["filedate"])
    df = materialize(df.withColumn("has_value", clean.flag(F.col("review_scores_value") >= 4.8)))
    mentions = explode_items(df.where(F.col("amenities").isNotNull()), "amenities", "brackets")
    dictionary = item_dictionary(mentions.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item", min_support + 1)
    items = sparse_items(with_items(df, "brackets"), "id", "items", dictionary)
    return materialize(df.drop("amenities").join(items, "id")), dictionary


def amenity_odds(listings: DataFrame, min_support: int = 1000, seed: int = 123) -> dict[str, DataFrame]:
    """Change of the odds by each amenity, with hold-out scores."""
    rows, dictionary = amenity_rows(listings, min_support)
    rows = train_test(rows, "id", seed=seed)
    names = [r["item"] for r in dictionary.orderBy("item_id").collect()]  # as many as coefficients
    fit = logit_cv_sparse(rows.where(~F.col("is_test")), "id", names, "has_value", seed=seed)
    support = dictionary.select(F.col("item").alias("variable"), "n")
    return {"odds": odds_table(fit.table(rows.sparkSession), support, "variable"), **_scores(fit.score_sparse(rows.where("is_test")))}


SCALED = ["host_total_listings_count", "bedrooms_per_accommodates", "security_deposit", "cleaning_fee", "extra_people", "listings_per_sq_km"]
CATEGORIES = ["host_is_superhost", "room_type", "instant_bookable", "cancellation_policy", "property_type"]
PLACE = ["city", "neighbourhood_cleansed"]
RAW = ["host_total_listings_count", "bedrooms", "accommodates", "security_deposit", "cleaning_fee", "extra_people", "review_scores_value", "amenities"]
# Property types and cancellation policies that keep a group of their own.
PROPERTY_TYPES = {"House": "House", "Apartment": "Apartment/Condo", "Condominium": "Apartment/Condo"}
POLICIES = {"moderate": "moderate", "flexible": "flexible"}
PETS = "Pets allowed"


def feature_rows(listings: DataFrame, areas: DataFrame) -> DataFrame:
    """Last snapshot of each reviewed listing with area density and grouped categories."""
    # the number that stands for the whole row keeps all columns in the plan below, and so the order of rows that it depends on
    df = listings.where(F.col("number_of_reviews") >= 5).withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in listings.columns]))
    df = df.select("id", "filedate", "__row", *PLACE, *RAW, *CATEGORIES)
    df = clean_listings(df).withColumns(
        {
            "has_value": clean.flag(F.col("review_scores_value") == 10),
            "pets_allowed": clean.flag(F.col("amenities").contains(PETS)),
            "property_type": clean.recode("property_type", PROPERTY_TYPES, "Other"),
            "cancellation_policy": clean.recode("cancellation_policy", POLICIES, "strict"),
        }
    )
    # snapshots meet as the typed columns that are read below, and once; of equal ids and dates the one kept is as for whole rows
    own = [c for c in SCALED if c != "listings_per_sq_km"]
    df = df.select("id", "filedate", "__row", *PLACE, *own, *CATEGORIES, "has_value", "pets_allowed")
    df = materialize(dedupe_last(df, ["id"], ["filedate"]).drop("__row"))
    sizes = areas.groupBy("city", F.col("neighbourhood").alias("neighbourhood_cleansed")).agg(F.sum(area_sq_km("geometry")).alias("sq_km"))
    counts = df.groupBy("filedate", "city", "neighbourhood_cleansed").agg(F.count("id").alias("listing_count"))
    density = counts.join(sizes, ["city", "neighbourhood_cleansed"]).select(
        "filedate", "city", "neighbourhood_cleansed", clean.ratio("listing_count", "sq_km").alias("listings_per_sq_km")
    )
    df = df.join(materialize(density), ["filedate", "city", "neighbourhood_cleansed"])
    df = df.where(clean.ne_keep_null("room_type", "Hotel room") & clean.ne_keep_null("room_type", "Shared room"))
    return df.select("id", "filedate", *SCALED, *CATEGORIES, "has_value", "pets_allowed")


def feature_odds(listings: DataFrame, areas: DataFrame, seed: int = 123) -> dict[str, DataFrame]:
    """Change of the odds by each feature, with hold-out scores, thresholds of the top five percent, deviations."""
    rows = materialize(feature_rows(listings, areas))
    limited = rows.where(
        (F.col("host_total_listings_count") < 100)
        & (F.col("security_deposit") < 1000)
        & (F.col("cleaning_fee") < 250)
        & (F.col("extra_people") < 50)
        & (F.col("listings_per_sq_km") < 250)
    )
    wide, levels = one_hot(limited, CATEGORIES)
    wide = train_test(materialize(clean.inf_to_null(wide).dropna()), "id", seed=seed)
    names = [*SCALED, "pets_allowed", *levels]
    scaled = standardize(wide, SCALED, fit_on=wide.where(~F.col("is_test")))
    fit = logit_cv(scaled.where(~F.col("is_test")), "id", names, "has_value", seed=seed)
    return {
        "odds": odds_table(fit.table(wide.sparkSession)),
        **_scores(fit.score(scaled.where("is_test"))),
        "quantiles": quantiles(rows, SCALED, 0.95),
        "std": sample_std(wide, SCALED),
    }
