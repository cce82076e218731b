"""Grouped summaries: rates, profiles, bins, box plots, density curves, shares."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.clean import ratio, strict_avg, strict_max
from staylens.operators.ranks import exact_quantiles
from staylens.runtime import broadcast_if_small, materialize


def area_stats(df: DataFrame, keys: Sequence[str], id_col: str, price: str) -> DataFrame:
    """Listings and mean price per area and snapshot; rows without a key are left out."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(id_col).alias("listing_count"), F.avg(price).alias(f"{price}_avg"))
    )


def rate_by(df: DataFrame, keys: Sequence[str], flag: str, scale: float = 100, means: Sequence[str] = ()) -> DataFrame:
    """Rows, flagged rows and rate per group; rows without a key are left out."""
    out = (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(flag).cast("long").alias(flag),
            *[F.avg(c).alias(f"avg_{c}") for c in means],
        )
    )
    return out.withColumn("rate", scale * F.col(flag) / F.col("n"))


def mean_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def presence_means(df: DataFrame, present: Column, cols: Sequence[str]) -> DataFrame:
    """Rows and mean of each column with and without something."""
    return (
        df.groupBy(present.alias("present"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in cols])
    )


def cut_column(col: str, edges: Sequence[float]) -> Column:
    """Number of the right-closed interval (edge, next edge] a value falls in; outside all of them null."""
    c, out = F.col(col), F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        out = F.when((c > lo) & (c <= hi), i).otherwise(out)
    return out


def cut_counts(df: DataFrame, col: str, edges: Sequence[float], flag: str) -> DataFrame:
    """Rows, flagged rows and rate per right-closed bin; bins without rows are kept, with null rate."""
    spark = df.sparkSession
    bins = spark.createDataFrame(
        [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))],
        "bin int, lo double, hi double",
    )
    counted = (
        df.groupBy(cut_column(col, edges).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(flag).cast("long").alias(flag))
    )
    out = bins.join(counted, "bin", "left").fillna(0, ["n", flag])
    return out.withColumn("rate", 100 * ratio(flag, "n"))


def histogram(df: DataFrame, col: str, bins: int = 30, centred: bool = True) -> DataFrame:
    """Counts in ``bins`` bins of equal width, as rows (bin, lo, hi, n); empty bins are left out.

    ``centred`` puts the middle of the first bin on the smallest value and that of the last one on the
    largest, with right-closed bins (the default of the grammar-of-graphics plots); otherwise the edges
    lie on the extremes.
    """
    x = F.col(col).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = ((hi - lo) / (bins - 1 if centred else bins)) or 1.0
    if centred:
        start = lo - width / 2
        number = F.greatest(F.ceil((x - start) / width) - 1, F.lit(0))
    else:
        start = lo
        number = F.least(F.floor((x - start) / width), F.lit(bins - 1))
    counted = df.where(x.isNotNull()).groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (start + F.col("bin") * width).alias("lo"), (start + (F.col("bin") + 1) * width).alias("hi"), "n")


def box_stats(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 inter-quartile ranges) and outlier count per group."""
    q = materialize(exact_quantiles(df, keys, col, [0.25, 0.5, 0.75]))
    q = q.select(*keys, "n", *[F.get("q", F.lit(i)).alias(a) for i, a in enumerate(["q1", "median", "q3"])])
    x, reach = F.col(col), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    spread = (
        df.select(*keys, col).join(q, list(keys))
        .groupBy(*keys, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_lo"),
            F.max(F.when(inside, x)).alias("whisker_hi"),
            F.count(F.when(~inside, 1)).alias("outliers"),
        )
    )
    return spread.select(*keys, "n", "whisker_lo", "q1", "median", "q3", "whisker_hi", "outliers")


# Width of a density cell in bandwidths, moments kept of each cell, and bandwidths past which a kernel is below 1e-17.
CELL_WIDTH, MOMENTS, REACH = 0.25, 12, 9.0


def density_curve(
    df: DataFrame,
    col: str,
    by: Sequence[str] = (),
    points: int = 512,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Gaussian kernel density per group at ``points`` places, as rows (by..., x, density).

    Rule-of-thumb bandwidth 0.9 min(sd, IQR/1.34) n^-0.2. A value is seen by its cell, a quarter of a bandwidth wide: one
    aggregate keeps twelve moments of the values about the middle of each cell, from which the Hermite series gives the
    sum of their kernels to double precision. A cell only meets the places within nine bandwidths of it, so past that
    aggregate the work follows the places, not the rows. Null and NaN values and groups of null name are left out; groups
    of one value have a bandwidth of 1; without values there is no curve.
    """
    by = list(by)
    keys = by or ["__all"]
    data = df.select(*by, F.col(col).cast("double").alias("x")).dropna()
    if limits:
        data = data.where(F.col("x").between(*limits))
    if not by:
        data = data.withColumn("__all", F.lit(0))
    stats = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    quartiles = exact_quantiles(data, keys, "x", [0.25, 0.75]).select(*keys, (F.get("q", F.lit(1)) - F.get("q", F.lit(0))).alias("iqr"))
    narrow = F.least(F.col("sd"), F.col("iqr") / 1.34)
    narrow = F.when(narrow > 0, narrow).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    groups = materialize(stats.join(quartiles, keys).select(*keys, "n", "lo", "hi", (0.9 * narrow * F.pow(F.col("n"), F.lit(-0.2))).alias("h")))
    lo, hi = map(float, limits) if limits else groups.agg(F.min("lo"), F.max("hi")).first()
    if lo is None:
        lo = hi = 0.0
    groups = groups.drop("lo", "hi")

    place = (F.col("x") - lo) / (F.col("h") * CELL_WIDTH)
    off = (place - F.floor(place) - 0.5) * CELL_WIDTH
    cells = (
        data.join(broadcast_if_small(groups.select(*keys, "h")), keys)
        .select(*keys, F.floor(place).alias("cell"), off.alias("d"))
        .groupBy(*keys, "cell")
        .agg(F.array(*[F.sum(F.pow("d", F.lit(k))) / math.factorial(k) for k in range(MOMENTS)]).alias("m"))
    )
    gap = (hi - lo) / (points - 1) if points > 1 else 0.0
    middle = lo + (F.col("cell") + 0.5) * CELL_WIDTH * F.col("h")
    if gap:
        first = F.greatest(F.ceil((middle - REACH * F.col("h") - lo) / gap), F.lit(0))
        last = F.least(F.floor((middle + REACH * F.col("h") - lo) / gap), F.lit(points - 1))
    else:
        first, last = F.lit(0), F.lit(points - 1)
    near = cells.join(broadcast_if_small(groups), keys).select(*keys, "h", "m", middle.alias("c"), first.cast("long").alias("a"), last.cast("long").alias("b"))
    near = near.where("a <= b").select(*keys, "h", "m", "c", F.explode(F.sequence("a", "b")).alias("i"))
    t = (lo + F.col("i") * gap - F.col("c")) / F.col("h")
    near = near.select(*keys, "i", "m", t.alias("t"))

    def term(state: Column, moment: Column) -> Column:
        # the next Hermite polynomial from the last two
        return F.struct(
            (state["k"] + 1).alias("k"),
            (F.col("t") * state["p"] - state["k"] * state["q"]).alias("p"),
            state["p"].alias("q"),
            (state["s"] + state["p"] * moment).alias("s"),
        )

    start = F.struct(F.lit(0.0).alias("k"), F.lit(1.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("s"))
    sums = near.groupBy(*keys, "i").agg(F.sum(F.exp(-0.5 * F.col("t") * F.col("t")) * F.aggregate("m", start, term, lambda s: s["s"])).alias("s"))
    places = groups.select(*keys, "n", "h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    out = places.join(sums, [*keys, "i"], "left")
    density = F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return out.select(*by, (lo + F.col("i") * gap).alias("x"), density.alias("density"))


def profile(df: DataFrame, cols: Sequence[str], more: Mapping[str, float] | None = None) -> DataFrame:
    """Minimum, quartiles, mean, maximum, deviation and missing values, one row per column, and ``more`` quantiles by name."""
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, **(more or {})}
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], list(cols), "column", "value")
    simple = long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("missing"),
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.stddev_samp("value").alias("sd"),
    )
    q = exact_quantiles(long, ["column"], "value", list(wanted.values())).select(
        "column", *[F.get("q", F.lit(i)).alias(a) for i, a in enumerate(wanted)]
    )
    return simple.join(q, "column", "left")


def sample_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample standard deviation, one row per column."""
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], list(cols), "column", "value")
    return long.groupBy("column").agg(F.stddev_samp("value").alias("sd"))


def share_of_total(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Share of each row in the total of the column; the total is a scalar subquery."""
    return df.withColumn(name or f"{col}_share", ratio(F.col(col), df.agg(F.sum(col)).scalar()))


def share_of_rows(df: DataFrame, keys: Sequence[str], whole: DataFrame) -> DataFrame:
    """Rows per group and their share in the number of rows of ``whole``."""
    out = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / whole.agg(F.count(F.lit(1))).scalar())


def host_profile(df: DataFrame) -> DataFrame:
    """One row per host; a mean or maximum is null as soon as one listing lacks the value."""
    means = {
        "avg_acceptance_rate": "host_acceptance_rate",
        "avg_response_rate": "host_response_rate",
        "avg_min_nights": "minimum_nights_avg_ntm",
        "avg_occupancy_estimate": "occupancy_estimate",
        "avg_price_per_accommodates": "price_per_accommodates",
        "avg_accommodates": "accommodates",
        "avg_reviews_ltm": "number_of_reviews_ltm",
    }
    return df.groupBy("host_id").agg(
        strict_max("max_listings").alias("max_listings"), *[strict_avg(c).alias(a) for a, c in means.items()]
    )


def cluster_profile(df: DataFrame) -> DataFrame:
    """One row per host cluster. Hosts without a cluster form a group of their own."""
    strict = ["avg_min_nights", "avg_occupancy_estimate", "avg_price_per_accommodates", "avg_accommodates", "avg_reviews_ltm"]
    return df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("count"),
        strict_avg("max_listings").alias("avg_max_listings"),
        (F.avg("avg_acceptance_rate") / 100).alias("avg_acceptance_rate"),
        (F.avg("avg_response_rate") / 100).alias("avg_response_rate"),
        *[strict_avg(c).alias(c) for c in strict],
        F.coalesce(F.sum(F.col("acceptance_imputed").cast("int")), F.lit(0)).alias("acceptance_imputed"),
        F.coalesce(F.sum(F.col("response_imputed").cast("int")), F.lit(0)).alias("response_imputed"),
    )


def trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Straight line of y on x."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r")
    )
