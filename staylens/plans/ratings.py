"""Which sub-ratings explain the overall rating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.operators.regress import ols, relative_importance

PARTS = ["rating_communication", "rating_location", "rating_value", "rating_accuracy", "rating_checkin", "rating_cleanliness"]


def titled_importance(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Relative importance with the category as a title, the most important first."""
    shares = relative_importance(df, y, xs)
    return shares.select(F.initcap(F.substring("term", 8, 2**31 - 1)).alias("category"), "share").orderBy(F.desc("share"))


def rating_drivers(listings: DataFrame) -> dict[str, DataFrame]:
    """The overall rating on its six parts, and the value rating on the other five."""
    others = [p for p in PARTS if p != "rating_value"]
    return {
        "overall": ols(listings, "star_rating", PARTS),
        "overall_importance": titled_importance(listings, "star_rating", PARTS),
        "value": ols(listings, "rating_value", others),
        "value_importance": titled_importance(listings, "rating_value", others),
    }
