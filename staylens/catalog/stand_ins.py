"""The given tables seen as the tables the jobs expect. Every row of the source is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.catalog.base import table
from staylens.runtime import spread

CITIES = ["F", "O", "P"]


def _pick(key: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with their order, customer and part."""
    items, orders = spread(table(spark, d, "lineitem")), table(spark, d, "orders")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as listing snapshots of three cities (order status), with nations as neighbourhoods."""
    items = F.array_join(F.concat(F.split("p_name", " "), F.array("p_type")), '", "')
    guests = F.ceil(F.col("l_quantity") / 7).cast("int")
    return _lines(spark, d).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.pmod("l_suppkey", F.lit(10))).alias("id"),
        F.add_months(F.lit("2022-01-15").cast("date"), (F.pmod("l_partkey", F.lit(3)) * 3).cast("int")).alias("filedate"),
        F.col("o_orderstatus").alias("city"),
        F.concat(F.lit("area_"), F.col("c_nationkey")).alias("neighbourhood_cleansed"),
        F.col("o_custkey").alias("host_id"),
        F.when(F.col("l_linestatus") == "O", "t").otherwise("f").alias("host_is_superhost"),
        F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.pmod("l_suppkey", F.lit(101)).cast("string"), F.lit("%"))).alias("host_response_rate"),
        F.when(F.col("l_partkey") % 5 != 0, F.concat(F.pmod("l_partkey", F.lit(101)).cast("string"), F.lit("%"))).alias("host_acceptance_rate"),
        (F.pmod("o_custkey", F.lit(35)) + 1).cast("int").alias("host_total_listings_count"),
        (F.pmod("o_custkey", F.lit(33)) + 1).cast("int").alias("host_listings_count"),
        (F.pmod("o_custkey", F.lit(31)) + 1).cast("int").alias("calculated_host_listings_count"),
        _pick(F.ascii("l_returnflag"), "Entire home/apt", "Private room", "Shared room").alias("room_type"),
        _pick(F.col("l_suppkey"), "Apartment", "House", "Loft", "Hotel", "Condominium").alias("property_type"),
        _pick(F.col("l_partkey"), "flexible", "moderate", "super_strict_30", "strict_14_with_grace_period").alias("cancellation_policy"),
        _pick(F.col("o_orderkey"), "today", "2 weeks ago", "3 months ago").alias("calendar_updated"),
        guests.alias("accommodates"),
        F.nullif(guests - 1, F.lit(0)).cast("double").alias("bedrooms"),
        guests.cast("double").alias("beds"),
        _dollars(20 * guests + F.col("l_extendedprice") / 1000 + F.when(F.col("p_name").contains("widget"), 30).otherwise(0)).alias("price"),
        _dollars(F.col("l_tax") * 1000).alias("cleaning_fee"),
        F.when(F.col("l_discount") > 0.01, _dollars(F.col("l_discount") * 5000)).alias("security_deposit"),
        _dollars(F.pmod("l_suppkey", F.lit(11)) * 5.0).alias("extra_people"),
        (F.pmod("l_partkey", F.lit(6)) + 1).cast("int").alias("minimum_nights"),
        (F.pmod("l_partkey", F.lit(6)) + 1.0).alias("minimum_nights_avg_ntm"),
        (F.pmod("l_partkey", F.lit(40)) + 30.0).alias("maximum_nights_avg_ntm"),
        (30 - F.dayofmonth("l_shipdate")).alias("availability_30"),
        F.pmod("l_partkey", F.lit(40)).cast("int").alias("number_of_reviews"),
        F.pmod("l_partkey", F.lit(25)).cast("int").alias("number_of_reviews_ltm"),
        F.to_date("o_orderdate").alias("last_review"),
        F.to_date("l_shipdate").alias("calendar_last_scraped"),
        F.when(F.col("l_linenumber") % 2 == 0, "t").otherwise("f").alias("instant_bookable"),
        F.concat(F.lit('["'), items, F.lit('"]')).alias("amenities"),
        (5 - F.col("l_discount") * 10).alias("review_scores_rating"),
        (5 - F.col("l_tax") * 5).alias("review_scores_accuracy"),
        (5 - F.pmod("l_partkey", F.lit(10)) / 10).alias("review_scores_cleanliness"),
        (5 - F.pmod("l_suppkey", F.lit(10)) / 10).alias("review_scores_checkin"),
        (5 - F.pmod("o_custkey", F.lit(10)) / 10).alias("review_scores_communication"),
        (5 - F.pmod("c_nationkey", F.lit(10)) / 10).alias("review_scores_location"),
        (5 - F.col("l_discount") * 4 + F.when(F.col("p_name").contains("bolt"), -0.2).otherwise(0.0)).alias("review_scores_value"),
    )


def older_listings(spark: SparkSession, d: str) -> DataFrame:
    """The same in the older layout: sets in braces, sub-ratings from 1 to 10."""
    braces = F.concat(F.lit("{"), F.translate("amenities", '["]', ""), F.lit("}"))
    return listings(spark, d).withColumns(
        {"amenities": braces, "review_scores_value": F.least(F.round((F.col("review_scores_value") - 4) * 5 + 6), F.lit(10.0))}
    )


def areas(spark: SparkSession, d: str) -> DataFrame:
    """A box per nation in every city."""
    key = F.col("n_nationkey")
    lon, lat = key * 2.0 - 25, key * 1.5 - 20
    side = 0.05 + key / 200
    points = [(lon, lat), (lon + side, lat), (lon + side, lat + side), (lon, lat + side), (lon, lat)]
    ring = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in points])
    return table(spark, d, "nation").select(
        F.concat(F.lit("area_"), key).alias("neighbourhood"),
        F.array(F.array(ring)).alias("geometry"),
        F.explode(F.array(*[F.lit(c) for c in CITIES])).alias("city"),
    )


def walkscore(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        F.concat(F.lit("area_"), key).alias("neighbourhood"),
        F.pmod(key * 37, F.lit(101)).cast("double").alias("walk_score"),
        (key * 1000 + 500).cast("long").alias("population"),
    )


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as price quotes with chores."""
    k = F.col("l_partkey")
    chores = F.array_join(
        F.array_compact(
            F.array(
                F.when(k % 2 == 0, "'Turn things off'"),
                F.when(k % 3 == 0, "'Gather used towels'"),
                F.when(k % 5 == 0, "'Lock up'"),
                F.when(k % 7 == 0, "'Additional requests: load the dishwasher'"),
                F.when(k % 11 == 0, "'Additional requests: feed the cat'"),
                F.when(k % 4 == 0, "'Return keys'"),
            )
        ),
        ", ",
    )
    joined = spread(table(spark, d, "lineitem")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("checkin"),
        F.to_date("l_shipdate").alias("checkout"),
        _dollars(F.col("l_extendedprice")).alias("total_rate"),
        F.when(F.col("l_tax") > 0, _dollars(F.col("l_tax") * 1000)).alias("cleaning_fee"),
        _dollars(F.col("l_discount") * 100).alias("service_fee"),
        (5 - F.col("l_discount") * 10).alias("rating_value"),
        (5 - F.col("l_tax") * 10).alias("rating_cleanliness"),
        (5 - F.pmod("l_suppkey", F.lit(10)) / 10).alias("rating_overall"),
        F.when(F.length(chores) > 0, F.concat(F.lit("["), chores, F.lit("]"))).alias("before_you_leave"),
    )


def rated_parts(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as listings with an overall rating made of six parts."""
    items = table(spark, d, "lineitem")
    parts = {
        "rating_communication": F.col("l_quantity") / 50,
        "rating_location": F.col("l_discount") * 10,
        "rating_value": F.col("l_tax") * 10,
        "rating_accuracy": F.nullif(F.pmod("l_partkey", F.lit(11)), F.lit(10)) / 10,
        "rating_checkin": F.pmod("l_suppkey", F.lit(7)) / 7,
        "rating_cleanliness": F.pmod("l_orderkey", F.lit(13)) / 13,
    }
    named = items.select(*[c.cast("double").alias(n) for n, c in parts.items()], (F.col("l_extendedprice") / 100000).alias("noise"))
    star = sum((F.col(n) * w for n, w in zip(parts, (0.2, 0.3, 0.8, 1.0, 0.1, 0.6))), F.lit(1.0)) + F.col("noise")
    return named.withColumn("star_rating", star)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def described(spark: SparkSession, d: str) -> DataFrame:
    """Documents as listing descriptions with the usual headings put between their sentences."""
    pieces = F.split("text", r"\. ")
    third = F.floor(F.size(pieces) / 4).cast("int")

    def part(k: int) -> Column:
        return F.array_join(F.slice("pieces", F.col("third") * k + 1, F.when(F.lit(k == 3), F.size("pieces")).otherwise(F.col("third"))), ". ")

    docs = documents(spark, d).select("doc_id", pieces.alias("pieces"), third.alias("third"))
    text = F.concat(
        part(0), F.when(F.col("doc_id") % 3 != 0, " The space ").otherwise(" "), part(1),
        F.when(F.col("doc_id") % 2 == 0, " Guest access ").otherwise(" "), part(2),
        F.when(F.col("doc_id") % 5 != 0, " Other things to note ").otherwise(" "), part(3),
    )
    return docs.select(F.concat(F.lit("https://rooms.example/"), F.col("doc_id")).alias("url"), text.alias("description"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        F.col("doc_id").alias("id"),
        F.pmod("doc_id", F.lit(97)).alias("listing_id"),
        F.date_add(F.lit("2019-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")).alias("date"),
        F.col("text").alias("comments"),
        "lang",
    )


def rated_listings(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    one = labels.groupBy(F.pmod("doc_id", F.lit(97)).alias("id")).agg((70 + 30 * F.round(F.avg("quality"), 1)).alias("review_scores_rating"))
    return one.withColumns(
        {
            "state": _pick(F.col("id"), "CA", "NY", "HI", "TX"),
            "room_type": F.when(F.col("id") % 5 == 0, "Private room").otherwise("Entire home/apt"),
        }
    )
