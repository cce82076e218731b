"""What drives occupancy in the next thirty days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import clean
from staylens.operators import evaluate, trees
from staylens.operators.groups import cut_counts, histogram, rate_by
from staylens.operators.ranks import train_test
from staylens.operators.regress import one_hot, standardize
from staylens.plans.common import RATINGS, add_indicators, area_density, clean_listings, item_support, supported_items, with_items
from staylens.runtime import materialize

# How long ago a calendar may have been updated.
FRESH = [
    "a week ago", "today", "yesterday", "1 week ago", "2 weeks ago", "3 weeks ago", "4 weeks ago", "5 weeks ago",
    "6 weeks ago", "7 weeks ago", "2 days ago", "3 days ago", "4 days ago", "5 days ago", "6 days ago", "2 months ago",
]
HOTELS = ["Hotel", "Boutique hotel", "Hostel"]
STRICT = {"super_strict_60": "strict", "super_strict_30": "strict", "strict_14_with_grace_period": "strict"}
SCALED = [
    "host_total_listings_count", "security_deposit", "cleaning_fee", "extra_people", "listings_per_sq_km", "walk_score",
    *RATINGS, "price_per_accommodates",
]
CATEGORIES = ["month", "host_is_superhost", "room_type", "instant_bookable", "cancellation_policy", "property_type"]
PRICE_EDGES = [0, 25, 50, 75, 100, 125, 150, 175, 200]
FEES = [float(f) for f in range(0, 55, 5)]


@dataclass
class OccupancyData:
    rows: DataFrame
    features: list[str]


EXTRA = ["calendar_updated", "minimum_nights", "accommodates", "number_of_reviews"]


def _listed(listings: DataFrame) -> DataFrame:
    """The typed columns that are read from the listings, with the amenities as ``items``."""
    df = clean_listings(listings)
    df = df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("bedrooms", "cleaning_fee", "security_deposit")})
    booked = clean.booked_next30("availability_30")
    df = df.withColumns(
        {
            "month": F.month("filedate"),
            "days_booked_n30": booked,
            "days_booked_n30_cat": clean.band(booked, [10, 20]),
            "cancellation_policy": clean.recode("cancellation_policy", STRICT, keep_unmapped=True),
        }
    ).where(clean.not_in("property_type", HOTELS))
    df = df.withColumn("property_type", clean.recode("property_type", {"Apartment": "Apartment", "House": "House"}, "Other"))
    df = with_items(df, "braces")
    own = [c for c in SCALED if c not in ("listings_per_sq_km", "walk_score")]
    keep = ["id", "city", "filedate", "neighbourhood_cleansed", "days_booked_n30", "days_booked_n30_cat", "amenities_count", "items", *own, *CATEGORIES]
    return df.select(*keep, *EXTRA)


def _in_areas(df: DataFrame, areas: DataFrame, walkscore: DataFrame) -> DataFrame:
    """Listings that the model is about, with the density of their area."""
    density = area_density(df, areas, walkscore).select("city", "filedate", "neighbourhood_cleansed", "listings_per_sq_km", "walk_score")
    return df.where(F.col("items").isNotNull()).join(materialize(density), ["city", "filedate", "neighbourhood_cleansed"]).where(
        F.col("calendar_updated").isin(FRESH)
        & (F.col("minimum_nights") <= 3)
        & (F.col("accommodates") <= 4)
        & (F.col("days_booked_n30") > 0)
        & (F.col("days_booked_n30") < 30)
        & (F.col("number_of_reviews") > 3)
    ).drop(*EXTRA)


def _complete(df: DataFrame) -> DataFrame:
    df = clean.inf_to_null(df.drop("items")).dropna()
    return df.withColumn("high_occupancy", clean.flag(F.col("days_booked_n30_cat") == 2))


def rate_rows(listings: DataFrame, areas: DataFrame, walkscore: DataFrame) -> DataFrame:
    """The rows of ``prepare`` without the columns of levels and amenities, which are never null and which no rate reads."""
    df = _listed(listings).drop(*CATEGORIES).withColumn("items", F.when(F.col("items").isNotNull(), F.lit(True)))
    return materialize(_complete(_in_areas(materialize(df), areas, walkscore)))


def prepare(listings: DataFrame, areas: DataFrame, walkscore: DataFrame, min_support: int = 500) -> OccupancyData:
    """Model rows: fresh calendars, short stays, small places, some but not all nights booked."""
    # the raw text is parsed once; what follows reads a few typed columns
    df = materialize(_listed(listings))
    vocabulary = supported_items(materialize(item_support(df)), min_support)
    df, levels = one_hot(_in_areas(df, areas, walkscore), CATEGORIES)
    df, amenity_cols = add_indicators(df, vocabulary)
    return OccupancyData(materialize(_complete(df)), [*SCALED, "amenities_count", *levels, *amenity_cols])


def occupancy_model(data: OccupancyData, max_iter: int = 100, seed: int = 123) -> dict[str, DataFrame]:
    """Three-class boosted trees: hold-out scores, importances and exact Shapley values of the training rows."""
    rows = train_test(data.rows.withColumn("__key", F.concat_ws("|", "id", "filedate")), "__key", seed=seed)
    train = rows.where(~F.col("is_test"))
    scaled = materialize(standardize(rows, SCALED, fit_on=train))
    train = scaled.where(~F.col("is_test"))
    fit = trees.gbt_multiclass(train, data.features, "days_booked_n30_cat", max_iter=max_iter, seed=seed)
    tested = materialize(fit.score(scaled.where("is_test")).select(F.col("days_booked_n30_cat").alias("label"), "prediction"))
    values = trees.stored_shapley(fit, train, "__key")
    return {
        "accuracy": evaluate.accuracy(tested),
        "confusion": evaluate.confusion_matrix(tested, fit.classes),
        "importance": trees.importance(fit, rows.sparkSession),
        "shapley": values,
        "shapley_summary": trees.shapley_summary(values),
    }


def occupancy_rates(rows: DataFrame, least: int = 100) -> dict[str, DataFrame]:
    """Share of high-occupancy listings by area, month, price per guest, extra-guest fee and host size."""
    by_area = rate_by(rows, ["city", "neighbourhood_cleansed", "walk_score"], "high_occupancy", 1, ["listings_per_sq_km"])
    sized = rows.where(F.col("host_total_listings_count") > 0).withColumn("num_listings_bin", clean.cap("host_total_listings_count", 10))
    return {
        "by_area": by_area.where(F.col("n") > least),
        "by_month": rate_by(rows, ["filedate"], "high_occupancy").withColumn("month", F.date_format("filedate", "yyyy-MM")).orderBy("filedate"),
        "by_price": cut_counts(rows, "price_per_accommodates", PRICE_EDGES, "high_occupancy"),
        "by_fee": rate_by(rows.where(F.col("extra_people").isin(FEES)), ["extra_people"], "high_occupancy"),
        "by_host_size": rate_by(sized, ["num_listings_bin"], "high_occupancy"),
        "price_histogram": histogram(rows.where(F.col("price_per_accommodates") < 200), "price_per_accommodates"),
        "fee_histogram": histogram(rows, "extra_people"),
    }


def area_map(areas: DataFrame, by_area: DataFrame) -> DataFrame:
    """Every area with its rate where enough listings were seen."""
    names = areas.select("city", "neighbourhood", "geometry")
    return names.join(by_area.withColumnRenamed("neighbourhood_cleansed", "neighbourhood"), ["city", "neighbourhood"], "left")
