"""What moves the price: one cross-validated lasso per city on listing features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import clean
from staylens.operators.groups import box_stats, mean_by
from staylens.operators.regress import influence_index, lasso_cv, one_hot
from staylens.plans.common import RATINGS, add_indicators, area_density, clean_listings, item_support, supported_items, with_items
from staylens.runtime import distinct_levels, materialize

# Items that are no amenities.
UNWANTED = [
    "translation missing: en.hosting_amenity_49",
    "translation missing: en.hosting_amenity_50",
    "Pets live on this property",
    "First aid kit",
]
NUMERIC = [
    "accommodates", "bedrooms", "beds", "minimum_nights_avg_ntm", "maximum_nights_avg_ntm", "listings_per_sq_km",
    "walk_score", *RATINGS,
]
CATEGORIES = ["host_is_superhost", "room_type", "instant_bookable"]


@dataclass
class Prepared:
    """Model rows of all cities, their feature names, and which amenities have support in which city."""

    rows: DataFrame
    features: list[str]
    optional: list[str]
    allowed: DataFrame


def _listed(listings: DataFrame) -> DataFrame:
    """The typed columns that are read from the listings, with the amenities as ``items``."""
    df = with_items(clean_listings(listings).where(F.col("number_of_reviews") > 3), "brackets", UNWANTED)
    own = [c for c in NUMERIC if c not in ("listings_per_sq_km", "walk_score")]
    return df.select("id", "filedate", "city", "neighbourhood_cleansed", "price", "price_per_accommodates", "items", *own, *CATEGORIES)


def _in_areas(df: DataFrame, areas: DataFrame, walkscore: DataFrame) -> DataFrame:
    """Listings that have items, with the density of their area."""
    density = area_density(df, areas, walkscore).select("city", "filedate", "neighbourhood_cleansed", "listings_per_sq_km", "walk_score")
    # stored, so that the join knows how small it is and leaves the listings where they are
    return df.where(F.col("items").isNotNull()).join(materialize(density), ["city", "filedate", "neighbourhood_cleansed"])


def _complete(df: DataFrame) -> DataFrame:
    return clean.inf_to_null(df.drop("items")).dropna().where((F.col("price") < 1000) & (F.col("price") > 0))


def chart_rows(listings: DataFrame, areas: DataFrame, walkscore: DataFrame) -> DataFrame:
    """The rows of ``prepare_city_data`` without the columns of levels and amenities, which are never null and which no chart reads."""
    df = _listed(listings).drop(*CATEGORIES).withColumn("items", F.when(F.col("items").isNotNull(), F.lit(True)))
    return materialize(_complete(_in_areas(materialize(df), areas, walkscore)))


def prepare_city_data(listings: DataFrame, areas: DataFrame, walkscore: DataFrame, min_support: int = 100) -> Prepared:
    """Clean, join and widen the listings of all cities at once; ``city`` is an ordinary column."""
    # the raw text is parsed once; counts, levels and the model rows are then read from a few typed columns
    df = materialize(_listed(listings))
    counts = materialize(item_support(df, ["city"]))
    df, levels = one_hot(_in_areas(df, areas, walkscore), CATEGORIES)
    vocabulary = supported_items(counts, min_support)
    df, amenity_cols = add_indicators(df, vocabulary)
    named = counts.sparkSession.createDataFrame(list(zip(vocabulary, amenity_cols)), "item string, name string")
    df = _complete(df)
    base = F.array(*[F.lit(c) for c in [*NUMERIC, *levels]])
    allowed = counts.where(F.col("n") >= min_support).join(named, "item").groupBy("city").agg(F.collect_set("name").alias("v"))
    cities = counts.select("city").distinct().join(allowed, "city", "left")
    allowed = cities.select("city", F.concat(base, F.coalesce("v", F.array().cast("array<string>"))).alias("variables"))
    return Prepared(materialize(df), [*NUMERIC, *levels, *amenity_cols], levels, allowed)


def fit_by_city(p: Prepared, seed: int = 123) -> DataFrame:
    """Rows (city, variable, coef, alpha, r2, n_train, n_test)."""
    rows = p.rows.withColumn("__key", F.concat_ws("|", "id", "filedate"))
    return lasso_cv(rows, "__key", p.features, "price", "city", seed=seed, allowed=p.allowed, optional=p.optional)


def price_influence(listings: DataFrame, areas: DataFrame, walkscore: DataFrame, min_support: int = 100, least_cities: int = 4) -> dict[str, DataFrame]:
    """``index``: influence of each feature per city relative to the mean price; ``r2``: fit per city and on average."""
    p = prepare_city_data(listings, areas, walkscore, min_support)
    coefs = materialize(fit_by_city(p))
    prices = p.rows.groupBy("city").agg(F.count(F.lit(1)).alias("listing_count"), F.avg("price").alias("avg_price"))
    index = influence_index(coefs, prices, "city", distinct_levels(coefs, "city"), least_cities)
    per_city = coefs.groupBy("city").agg(F.first("r2").alias("r2"))
    average = per_city.agg(F.lit("average").alias("city"), F.avg("r2").alias("r2"))
    return {"index": index, "r2": per_city.unionByName(average), "coefficients": coefs, "rows": p.rows}


def price_charts(rows: DataFrame, guests: Sequence[int] = (2, 4, 6, 8), left_out: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Tables behind the price charts: box statistics by guests, price by rating, price by area."""
    boxes = box_stats(rows.where(F.col("accommodates").isin(list(guests))), ["city", "accommodates"], "price")
    rated = rows.where((F.col("review_scores_rating") >= 4) & (F.col("price_per_accommodates") <= 150))
    return {
        "box_by_guests": boxes,
        "price_by_rating": mean_by(rated, ["city", "review_scores_rating"], ["price_per_accommodates"]),
        "price_by_area": mean_by(
            rows.where(clean.not_in("neighbourhood_cleansed", left_out)), ["city", "neighbourhood_cleansed"], ["price_per_accommodates", "walk_score"]
        ),
    }


def strong_features(index: DataFrame, least: float = 0.02) -> DataFrame:
    """Features whose average influence is clearly above or below zero."""
    return index.where((F.col("average") > least) | (F.col("average") < -least))
