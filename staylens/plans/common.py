"""Steps that several jobs share: listing clean-up, area density, amenity columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import clean
from staylens.functions.geo import area_sq_km
from staylens.functions.text import delimiter_count, set_items
from staylens.operators.groups import area_stats
from staylens.operators.reshape import indicators
from staylens.runtime import MAX_LEVELS, column_names

MONEY = ["price", "cleaning_fee", "security_deposit", "extra_people"]
PERCENT = ["host_response_rate", "host_acceptance_rate"]
RATINGS = [
    "review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness", "review_scores_checkin",
    "review_scores_communication", "review_scores_location", "review_scores_value",
]


def clean_listings(df: DataFrame) -> DataFrame:
    """Money and percent text to numbers, ratings to 0..5, and the derived columns the columns at hand allow."""
    have = set(df.columns)
    cols = {c: clean.parse_money(F.col(c).cast("string")) for c in MONEY if c in have}
    cols |= {c: clean.parse_percent(F.col(c).cast("string")) for c in PERCENT if c in have}
    if "review_scores_rating" in have:
        cols["review_scores_rating"] = clean.rescale_rating("review_scores_rating")
    df = df.withColumns(cols)
    more = {}
    if {"calendar_last_scraped", "last_review"} <= have:
        more["days_since_last_review"] = F.datediff("calendar_last_scraped", "last_review")
    if {"price", "accommodates"} <= have:
        more["price_per_accommodates"] = clean.ratio("price", "accommodates")
    if {"bedrooms", "accommodates"} <= have:
        more["bedrooms_per_accommodates"] = clean.ratio("bedrooms", "accommodates")
    return df.withColumns(more) if more else df


def area_density(listings: DataFrame, areas: DataFrame, walkscore: DataFrame | None = None, keys: Sequence[str] = ("city",)) -> DataFrame:
    """Listings and, where known, people per square kilometre for each area and snapshot.

    Polygons of one area are added up. ``keys`` are the columns besides the name that identify an area.
    """
    keys = list(keys)
    stats = area_stats(listings, [*keys, "filedate", "neighbourhood_cleansed"], "id", "price_per_accommodates")
    sizes = areas.groupBy(*keys, F.col("neighbourhood").alias("neighbourhood_cleansed")).agg(F.sum(area_sq_km("geometry")).alias("sq_km"))
    out = stats.join(sizes, [*keys, "neighbourhood_cleansed"])
    out = out.withColumn("listings_per_sq_km", clean.ratio("listing_count", "sq_km"))
    if walkscore is not None:
        scores = walkscore.withColumnRenamed("neighbourhood", "neighbourhood_cleansed")
        on = [c for c in [*keys, "neighbourhood_cleansed"] if c in scores.columns]
        out = out.join(scores, on)
        if "population" in scores.columns:
            out = out.withColumn("population_per_sq_km", clean.ratio("population", "sq_km"))
    return out


def with_items(df: DataFrame, dialect: str, unwanted: Sequence[str] = ()) -> DataFrame:
    """Add ``items``, the distinct amenities as an array, and ``amenities_count``; both null without amenities."""
    items = F.array_distinct(set_items("amenities", dialect))
    if unwanted:
        items = F.filter(items, lambda x: ~x.isin(list(unwanted)))
    return df.withColumns({"amenities_count": delimiter_count("amenities"), "items": items})


def item_support(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records per amenity. (id, filedate) is the key of a snapshot row and ``items`` holds no repeats, so
    counting rows counts records, and only the counts are shuffled."""
    return df.select(*by, F.explode("items").alias("item")).groupBy(*by, "item").agg(F.count(F.lit(1)).alias("n"))


def supported_items(counts: DataFrame, least: int) -> list[str]:
    """Amenities that become columns: those with enough support anywhere."""
    rows = counts.where(F.col("n") >= least).select("item").distinct().limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError("too many amenities for columns; raise the support")
    return sorted(r[0] for r in rows)


def add_indicators(df: DataFrame, values: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One 0/1 column per amenity, computed in the row."""
    names = column_names(values, df.columns)
    return df.select("*", *[c.alias(n) for c, n in zip(indicators("items", values), names)]), names

