"""Do checkout chores go with ratings and fees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import clean
from staylens.functions.text import explode_items, remove_phrases, strip_chars
from staylens.operators.groups import mean_by, presence_means

# The chores guests are shown, in the order they are looked for.
CHORES = ["Turn things off", "Gather used towels", "Lock up", "Additional requests", "Throw trash away", "Return keys"]
FREE_TEXT = "Additional requests"
MEASURES = ["nightly_rate_quoted", "cleaning_fee", "rating_value", "rating_cleanliness", "rating_overall"]


def prepare_quotes(quotes: DataFrame, first_digits: bool = False) -> DataFrame:
    """Amounts to numbers and the nightly rate over the quote's own nights; no nights give no rate.

    ``first_digits`` reads only the digits before a thousands comma.
    """
    read = clean.parse_first_number if first_digits else clean.parse_money
    money = [c for c in quotes.columns if c in ("total_rate", "taxes") or c.endswith("_fee")]
    df = quotes.withColumns({c: read(F.col(c).cast("string")) for c in money})
    df = df.withColumn("days_quoted", F.datediff("checkout", "checkin"))
    df = df.withColumn("nightly_rate_quoted", clean.ratio("total_rate", "days_quoted"))
    df = df.select("id", *MEASURES, "before_you_leave")
    return df.withColumns(
        {"has_cleaning_fee": ~clean.is_missing("cleaning_fee"), "has_instructions": ~clean.is_missing("before_you_leave")}
    )


def chore_rows(df: DataFrame) -> DataFrame:
    """One row per quote and chore; every kind of free request counts as one chore."""
    each = explode_items(df.where("has_instructions"), "before_you_leave", "quotes", "chore")
    return each.withColumn("chore", F.when(F.col("chore").contains(FREE_TEXT), FREE_TEXT).otherwise(F.col("chore")))


def request_text(df: DataFrame) -> DataFrame:
    """What hosts wrote besides the standard chores, and whether it is about dishes."""
    text = strip_chars(remove_phrases("before_you_leave", CHORES), "'[],\n")
    out = df.where("has_instructions").withColumn("request", F.trim(text))
    return out.withColumn("dishes", clean.contains_any("request", ["dishes", "dishwasher"]))


def checkout_chores(quotes: DataFrame, first_digits: bool = False) -> dict[str, DataFrame]:
    df = prepare_quotes(quotes, first_digits)
    known = chore_rows(df).where(F.col("chore").isin(CHORES))
    counts = known.groupBy("chore").agg(F.count("id").alias("n"))
    requests = request_text(df)
    return {
        "presence": df.agg(F.count("id").alias("listings"), F.count("before_you_leave").alias("with_instructions")),
        "means": presence_means(df, F.col("has_instructions"), MEASURES),
        "fees": df.groupBy("has_instructions", "has_cleaning_fee").agg(F.count("id").alias("n")),
        "chore_means": mean_by(known, ["chore"], MEASURES),
        "chore_counts": counts.withColumn("share", F.col("n") / df.agg(F.count("id")).scalar()),
        "dishes": requests.groupBy("dishes").agg(F.count("id").alias("n")),
        "dishes_means": requests.where("dishes").agg(*[F.avg(c).alias(f"avg_{c}") for c in MEASURES]),
    }
