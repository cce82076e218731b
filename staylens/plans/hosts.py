"""What types of hosts there are and what they are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from staylens.functions import clean
from staylens.operators import segments
from staylens.operators.groups import cluster_profile, host_profile, share_of_total
from staylens.plans.common import clean_listings
from staylens.runtime import materialize

MODEL_COLS = [
    "max_listings", "avg_acceptance_rate", "avg_response_rate", "avg_min_nights", "avg_occupancy_estimate", "avg_price_per_accommodates",
]


def host_table(listings: DataFrame) -> DataFrame:
    """One row per host of reviewed, plausibly occupied, priced listings."""
    df = clean_listings(listings).withColumns(
        {
            "max_listings": clean.row_max("host_total_listings_count", "host_listings_count", "calculated_host_listings_count"),
            "days_occupied_estimate": clean.floor_at("minimum_nights_avg_ntm", 3),
        }
    )
    df = df.where(
        (F.col("number_of_reviews") > 0)
        & (F.col("minimum_nights_avg_ntm") <= 365)
        & (F.col("number_of_reviews_ltm") < clean.ratio(F.lit(365), "days_occupied_estimate"))
        & (F.col("price") > 0)
    )
    return host_profile(df.withColumn("occupancy_estimate", clean.occupancy_estimate("days_occupied_estimate", "number_of_reviews_ltm")))


def ordinary_hosts(hosts: DataFrame) -> DataFrame:
    return hosts.where((F.col("max_listings") < 30) & (F.col("avg_price_per_accommodates") < 200))


def segment_hosts(hosts: DataFrame, k: int = 7, nstart: int = 5, maxit: int = 5, seed: int = 1) -> DataFrame:
    """Hosts with ``cluster`` (1..k by k-means, then the overrides) and which rates had to be imputed.

    Columns that no host has a value in are left out of the model; without any host or column there are no clusters.
    """
    model_rows = materialize(ordinary_hosts(hosts).select("host_id", *MODEL_COLS))
    filled = segments.impute_pmm(model_rows, "host_id", MODEL_COLS, maxit=maxit, seed=seed)
    used = segments.observed_columns(model_rows, MODEL_COLS)
    if used:
        vectors = segments.scaled_vectors(filled, "host_id", used).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model, _ = segments.kmeans_best(vectors, k, nstart)
            assigned = materialize(segments.assign_clusters(model, vectors).select("host_id", "cluster"))
        finally:
            vectors.unpersist()
    else:
        assigned = model_rows.select("host_id", F.lit(None).cast("int").alias("cluster"))
    flags = model_rows.select(
        "host_id",
        clean.is_missing("avg_acceptance_rate").alias("acceptance_imputed"),
        clean.is_missing("avg_response_rate").alias("response_imputed"),
    )
    return segments.override_segments(hosts.join(assigned.join(flags, "host_id"), "host_id", "left"))


def value_shares(profile: DataFrame) -> DataFrame:
    """Yearly value of each known cluster and its share of value, listings and hosts."""
    df = profile.where(F.col("cluster").isNotNull()).withColumns(
        {
            "value": clean.cluster_value(
                F.col("count"), "avg_max_listings", "avg_occupancy_estimate", "avg_accommodates", "avg_price_per_accommodates"
            ),
            "estimated_listing_count": F.col("count") * F.col("avg_max_listings"),
        }
    )
    df = share_of_total(df, "value", "value_percent")
    df = share_of_total(df, "estimated_listing_count", "estimated_listing_count_percent")
    return share_of_total(df, "count", "host_percent")


def name_segments(df: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``cluster_name`` from a table (cluster, cluster_name)."""
    return df.join(names, "cluster", "left")


def summary_text(df: DataFrame) -> DataFrame:
    """The summary as it is printed, most valuable cluster first."""
    names = ["cluster_name"] if "cluster_name" in df.columns else []
    return df.orderBy(F.desc("value")).select(
        "cluster",
        *names,
        clean.fmt("count", "number").alias("host_count"),
        clean.fmt("host_percent", "percent").alias("host_percent"),
        clean.fmt("avg_max_listings", "number", 2).alias("avg_max_listings"),
        clean.fmt("avg_acceptance_rate", "percent").alias("avg_acceptance_rate"),
        clean.fmt("avg_response_rate", "percent").alias("avg_response_rate"),
        clean.fmt("avg_min_nights", "number", 2).alias("avg_min_nights"),
        clean.fmt("avg_occupancy_estimate", "percent").alias("avg_occupancy_estimate"),
        clean.fmt("avg_price_per_accommodates", "currency", 2).alias("avg_price_per_accommodates"),
        clean.fmt("value", "millions").alias("value"),
        clean.fmt("value_percent", "percent").alias("value_percent"),
    )


def host_segments(listings: DataFrame, names: DataFrame | None = None, k: int = 7, nstart: int = 5, maxit: int = 5, seed: int = 1) -> dict[str, DataFrame]:
    """``hosts`` with their cluster and the ``summary`` per cluster with value shares."""
    hosts = materialize(host_table(listings))
    segmented = materialize(segment_hosts(hosts, k, nstart, maxit, seed))
    summary = value_shares(materialize(cluster_profile(segmented)))
    if names is not None:
        summary = name_segments(summary, names)
    return {"hosts": segmented, "summary": summary}
