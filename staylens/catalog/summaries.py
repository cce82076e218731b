"""Rates, bins, profiles, ranks, reshaping and cleaning on the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.catalog.base import rounded, table
from staylens.functions import clean, text
from staylens.operators import groups, ranks, reshape
from staylens.runtime import distinct_levels, materialize

QUANTITY_EDGES = [0, 10, 20, 30, 40, 50, 60]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _order_listings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as listing snapshots: customer the listing, nation the area, order year the snapshot."""
    orders = table(spark, d, "orders").where(F.col("o_totalprice") > 1000)
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("accommodates", (F.col("c_custkey") % 8 + 1).cast("int"))
        .withColumn("price_per_accommodates", clean.ratio("o_totalprice", "accommodates"))
        .withColumn("snapshot", F.year("o_orderdate"))
    )


def area_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = groups.area_stats(_order_listings(spark, d), ["snapshot", "c_nationkey"], "o_orderkey", "price_per_accommodates")
    return rounded(stats.withColumnRenamed("c_nationkey", "area"), 4)


def area_density(spark: SparkSession, d: str) -> DataFrame:
    stats = area_stats(spark, d)
    areas = (
        table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("area"), "n_name", "r_name", (F.col("n_nationkey") * 10 + 50.0).alias("sq_km"))
    )
    out = stats.join(areas, "area").withColumn("listings_per_sq_km", clean.ratio("listing_count", "sq_km"))
    return rounded(out, 4)


def occupancy_by_month(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        clean.flag(F.col("o_totalprice") >= 250000).alias("high_occupancy"),
    )
    return rounded(groups.rate_by(orders, ["month"], "high_occupancy"))


def occupancy_by_price_bin(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumn("high_occupancy", clean.flag(F.col("l_discount") >= 0.05))
    return rounded(groups.cut_counts(items, "l_quantity", QUANTITY_EDGES, "high_occupancy"))


def occupancy_by_host_size(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("listings"))
    hosts = sizes.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        clean.cap("listings", 10).alias("size"), clean.flag(F.col("c_acctbal") > 5000).alias("high_occupancy")
    )
    return rounded(groups.rate_by(hosts, ["size"], "high_occupancy"))


def map_left_join(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    least = customer.agg((F.count(F.lit(1)) / 25).alias("m")).scalar()
    counts = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("avg_bal"))
    counts = counts.where(F.col("n") > least)
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    out = nation.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").drop("c_nationkey")
    return rounded(out, 4)


def box_stats_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.box_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"), 4)


def quantile_std_profile(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(*MEASURES)
    out = groups.profile(items, MEASURES, {"q95": 0.95}).drop("sd")
    out = out.join(groups.sample_std(items, MEASURES), "column")
    return rounded(out, 4)


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.histogram(table(spark, d, "documents"), "n_chars", 30), 4)


def density_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = groups.density_curve(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"], points=64)
    return rounded(curve.withColumn("density", F.col("density") * 1e6), 4)


def recode_flag_band(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    status = clean.recode("o_orderstatus", {"F": "finished", "O": "open"}, default="other")
    merged = clean.recode("o_orderpriority", {"1-URGENT": "strict", "2-HIGH": "strict"}, keep_unmapped=True)
    days = F.dayofmonth("o_orderdate")
    rows = orders.select(
        status.alias("status"),
        merged.alias("priority"),
        clean.band(clean.booked_next30(days), [10, 20]).alias("band"),
        clean.label_if(F.col("o_totalprice") < 100000, "low", "not_low").alias("size"),
        clean.flag((F.col("o_totalprice") > 400000) | (F.col("o_totalprice") < 50000)).alias("extreme"),
        clean.occupancy_estimate(days, F.lit(4)).alias("occupancy"),
        clean.odds_change_pct(F.col("o_totalprice") / 1e6).alias("odds"),
        F.lit(1).alias("one"),
    )
    return rounded(
        rows.groupBy("status", "priority", "band", "size").agg(
            F.sum("extreme").cast("long").alias("extremes"),
            F.avg("occupancy").alias("occupancy"),
            F.avg("odds").alias("odds"),
            F.sum("one").cast("long").alias("n"),
        ),
        4,
    )


def null_rules(spark: SparkSession, d: str) -> DataFrame:
    disc, tax = F.nullif(F.col("l_discount"), F.lit(0.0)), F.nullif(F.col("l_tax"), F.lit(0.0))
    items = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", disc.alias("disc"), tax.alias("tax"))
    items = items.withColumns(
        {
            "top": clean.row_max("disc", "tax"),
            "held": clean.row_count("disc", "tax"),
            "mean": clean.row_mean("disc", "tax"),
            "floored": clean.floor_at("disc", 0.03),
            "capped": clean.cap("disc", 0.07),
        }
    )
    keep = clean.not_in("tax", [0.01, 0.02]) & clean.ne_keep_null("disc", 0.05)
    return rounded(
        items.groupBy("l_suppkey", "l_linenumber").agg(
            clean.strict_avg("disc").alias("strict_disc"),
            clean.strict_max("tax").alias("strict_tax"),
            F.sum("top").alias("top"),
            F.sum("held").cast("long").alias("held"),
            F.sum("mean").alias("mean"),
            F.sum("floored").alias("floored"),
            F.sum("capped").alias("capped"),
            F.count(F.when(keep, 1)).alias("kept"),
            F.count(F.when(clean.is_missing("disc") & F.col("tax").isNotNull(), 1)).alias("lacking"),
        ),
        6,
    )


def money_percent_parse(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    texts = items.select(
        "l_orderkey",
        "l_linenumber",
        clean.fmt("l_extendedprice", "currency", 2).alias("price_text"),
        F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("rate_text"),
    )
    return texts.select(
        "l_orderkey",
        "l_linenumber",
        "price_text",
        clean.parse_money("price_text").alias("price"),
        clean.parse_first_number("price_text").alias("first_number"),
        clean.parse_percent("rate_text").alias("rate"),
        clean.parse_money(F.concat("rate_text", F.lit("x"))).alias("unreadable"),
        clean.digits_only("price_text").alias("digits"),
    )


def date_functions(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").where(F.col("l_shipdate") > F.lit("1996-01-01").cast("timestamp_ntz"))
    name = F.concat(F.lit("/data 2019/listings_"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(".csv.gz"))
    dated = items.select("l_orderkey", "l_shipdate", clean.file_date(name).alias("filedate"))
    joined = dated.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(
        joined.groupBy(F.date_format("filedate", "yyyy-MM").alias("month"), F.month("o_orderdate").alias("order_month")).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.datediff(F.col("filedate"), F.to_date("o_orderdate"))).alias("avg_days"),
            F.max("filedate").cast("string").alias("last_file"),
        ),
        4,
    )


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    last = ranks.dedupe_last(events, ["user_id", "event_type"], ["ts", "event_id"])
    return last.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def set_explode_counts(spark: SparkSession, d: str) -> DataFrame:
    """Part names and types written as sets in each dialect, then counted per item."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")

    def written(quote: str, opening: str, closing: str):
        inner = F.concat_ws(f"{quote}, {quote}", F.replace("p_name", F.lit(" "), F.lit(f"{quote}, {quote}")), "p_type")
        return F.concat(F.lit(opening + quote), inner, F.lit(quote + closing))

    written_as = {"brackets": ('"', "[", "]"), "braces": ('"', "{", "}"), "quotes": ("'", "[", "]"), "json": ('"', "[", "]")}
    out = None
    for dialect, marks in written_as.items():
        sets = part.select("p_partkey", "p_retailprice", written(*marks).alias("set_text"))
        sets = sets.withColumn("commas", text.delimiter_count("set_text"))
        items = text.explode_items(sets, "set_text", dialect).withColumn("dialect", F.lit(dialect))
        out = items if out is None else out.unionByName(items)
    supported = reshape.support(out, ["p_partkey"], by=["dialect"]).where(F.col("n") > 20)
    means = out.groupBy("dialect", "item").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("commas").cast("long").alias("commas"), F.avg("p_retailprice").alias("avg_price")
    )
    return rounded(reshape.natural_join(means, supported), 4)


def indicator_pivot(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    wide = reshape.indicator_pivot(events, ["user_id"], "event_type", distinct_levels(events, "event_type"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    return wide.select("user_id", *kinds, clean.row_count(*[F.nullif(F.col(k), F.lit(0)) for k in kinds]).alias("kinds"))


def value_pivot_index(spark: SparkSession, d: str) -> DataFrame:
    """Mean balance per nation and segment relative to the mean of the segment, one column per segment."""
    customer = table(spark, d, "customer")
    segments = distinct_levels(customer, "c_mktsegment")
    base = customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("base"))
    cells = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    cells = cells.join(base, "c_mktsegment", "left").withColumn("index", clean.ratio("m", "base"))
    wide = reshape.pivot_by(cells, "c_nationkey", "c_mktsegment", "index", segments)
    wide = wide.withColumns({"average": clean.row_mean(*segments), "held": clean.row_count(*segments)})
    return rounded(wide.where(F.col("held") >= 4).orderBy(F.desc("average")), 4)


def presence_means(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    events = events.withColumn("note", F.when(F.col("props").rlike(r'"k": [0-4]\d?\}'), F.col("props")))
    means = groups.presence_means(events, clean.is_missing("note"), ["value"])
    shares = groups.share_of_rows(
        events.where(clean.contains_any("props", ["1", "7"])).withColumn("present", clean.is_missing("note")), ["present"], events
    ).withColumnRenamed("n", "n_digits")
    return rounded(means.join(shares, "present"))


def union_unpivot_share(spark: SparkSession, d: str) -> DataFrame:
    balances = (
        table(spark, d, "supplier").select(F.lit("supplier").alias("metric"), F.col("s_acctbal").alias("value"))
        .unionByName(table(spark, d, "customer").select(F.lit("customer").alias("metric"), F.col("c_acctbal").alias("value")))
    )
    long = table(spark, d, "lineitem").select(*MEASURES).unpivot([], MEASURES, "metric", "value")
    total = balances.unionByName(long).groupBy("metric").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return rounded(groups.share_of_total(total, "total"), 4, "total", "total_share")


def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_brand", "p_partkey", F.floor(F.col("p_retailprice") / 100).alias("price_band"))
    top = ranks.top_n_by(part, ["p_brand"], "price_band", 3)
    return ranks.avg_rank(part, ["p_brand"], "price_band", name="mean_rank").join(
        top.select("p_partkey", "rank"), "p_partkey"
    )


def category_places(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return ranks.order_rank(materialize(counts), "n")


def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return ranks.with_row_number(events, [F.col("value"), F.col("event_id")], ["event_type"])


def sample_and_split(spark: SparkSession, d: str) -> DataFrame:
    split = ranks.train_test(table(spark, d, "orders"), "o_orderkey")
    return ranks.sample_n(split, 1000, "o_orderkey").select("o_orderkey", "o_totalprice", "is_test")


def ols_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag", "l_linestatus"]), 4)


def month_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct().orderBy("month")


def semi_join_rows(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of the order lines whose part is a large one."""
    large = table(spark, d, "part").where("p_size >= 25").select(F.col("p_partkey").alias("l_partkey"))
    kept = reshape.semi_join(table(spark, d, "lineitem"), large, "l_partkey")
    return rounded(kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), 2)


def spread_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority, one column per status, zero where there are none."""
    counts = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return reshape.spread(counts, ["o_orderpriority"], "o_orderstatus", "n", ["F", "O", "P"], 0)


def ratings_and_infinities(spark: SparkSession, d: str) -> DataFrame:
    """Ratings on two scales brought to one, and ratios with zero divisors as double arithmetic gives them, cleaned."""
    lines = table(spark, d, "lineitem")
    rating = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 2).otherwise(F.col("l_quantity") / 10)
    by_zero = F.when(F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("l_tax") / F.col("l_discount"))
    rows = lines.select("l_orderkey", "l_linenumber", clean.rescale_rating(rating).alias("rating"), by_zero.alias("ratio"))
    return rounded(clean.inf_to_null(rows, ["ratio"]), 4)


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What holds for any repeatable sample and split: its size, no row twice, sides near their shares."""
    orders = table(spark, d, "orders")
    drawn = ranks.sample_n(orders, 1000, "o_orderkey")
    split = ranks.train_test(orders, "o_orderkey")
    share = split.agg((F.abs(F.avg(F.col("is_test").cast("double")) - 0.2) < 0.03).alias("near_share"))
    both = drawn.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_keys")).withColumn("k", F.lit(1))
    return both.join(share.withColumn("k", F.lit(1)), "k").drop("k")


QUERIES = {
    f.__name__: f
    for f in (
        semi_join_rows, spread_counts, ratings_and_infinities, split_sizes, area_stats, area_density, occupancy_by_month, occupancy_by_price_bin, occupancy_by_host_size, map_left_join,
        box_stats_by_group, quantile_std_profile, histogram, density_curve, recode_flag_band, null_rules,
        money_percent_parse, date_functions, dedupe_last, set_explode_counts, indicator_pivot, value_pivot_index,
        presence_means, union_unpivot_share, top_per_group, category_places, row_numbers, sample_and_split, ols_trend,
        month_labels,
    )
}

_AREA = """
SELECT year(o_orderdate)::INTEGER AS snapshot, c_nationkey AS area, count(o_orderkey) AS listing_count,
       round(avg(o_totalprice / (c_custkey % 8 + 1)), 4) AS price_per_accommodates_avg
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1, 2"""

_LONG = "SELECT * FROM (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR metric IN (l_quantity, l_extendedprice, l_discount, l_tax))"


def _sets_sql() -> str:
    parts = []
    for dialect, (q, a, b) in {"brackets": ('"', "[", "]"), "braces": ('"', "{", "}"), "quotes": ("''", "[", "]"), "json": ('"', "[", "]")}.items():
        parts.append(
            f"SELECT '{dialect}' AS dialect, p_partkey, p_retailprice, '{a}{q}' || replace(p_name, ' ', '{q}, {q}') || "
            f"'{q}, {q}' || p_type || '{q}{b}' AS set_text FROM part"
        )
    return f"""
WITH sets AS ({" UNION ALL ".join(parts)}),
items AS (SELECT dialect, p_partkey, p_retailprice, length(set_text) - length(replace(set_text, ',', '')) AS commas,
          trim(unnest(string_split(regexp_replace(set_text, '["\\[\\]{{}}'']', '', 'g'), ','))) AS item FROM sets),
sup AS (SELECT dialect, item, count(DISTINCT p_partkey) AS n FROM items GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) > 20)
SELECT i.dialect, i.item, count(*) AS "rows", sum(commas)::BIGINT AS commas, round(avg(p_retailprice), 4) AS avg_price, any_value(n) AS n
FROM items i JOIN sup USING (dialect, item) GROUP BY 1, 2"""


SQL = {
    "semi_join_rows": """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 25) GROUP BY 1""",
    "spread_counts": """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
    "ratings_and_infinities": """WITH r AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 2 ELSE l_quantity / 10 END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN v > 5 THEN v / 20 ELSE v END, 4) AS rating, round(l_tax / nullif(l_discount, 0), 4) AS ratio FROM r""",
    "split_sizes": """SELECT least(count(*), 1000) AS n, least(count(DISTINCT o_orderkey), 1000) AS n_keys, true AS near_share FROM orders""",
    "area_stats": _AREA,
    "area_density": f"""
WITH s AS ({_AREA})
SELECT s.area, s.snapshot, s.listing_count, s.price_per_accommodates_avg, n_name, r_name, n_nationkey * 10 + 50.0::DOUBLE AS sq_km,
       round(listing_count / (n_nationkey * 10 + 50.0::DOUBLE), 4) AS listings_per_sq_km
FROM s JOIN nation ON area = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "occupancy_by_month": """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END)::BIGINT AS high_occupancy,
       round(100.0::DOUBLE * sum(CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM orders GROUP BY 1""",
    "occupancy_by_price_bin": """
WITH bins AS (SELECT i::INTEGER AS bin, (i * 10)::DOUBLE AS lo, (i * 10 + 10)::DOUBLE AS hi FROM range(6) t(i)),
c AS (SELECT bin, count(l_orderkey) AS n, coalesce(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) FILTER (l_orderkey IS NOT NULL), 0)::BIGINT AS high_occupancy
      FROM bins LEFT JOIN lineitem ON l_quantity > lo AND l_quantity <= hi GROUP BY 1)
SELECT bin, lo, hi, n, high_occupancy, round(100.0::DOUBLE * high_occupancy / nullif(n, 0), 6) AS rate FROM bins JOIN c USING (bin)""",
    "occupancy_by_host_size": """
WITH s AS (SELECT o_custkey, count(*) AS listings FROM orders GROUP BY 1)
SELECT least(listings, 10)::INTEGER AS size, count(*) AS n, sum((c_acctbal > 5000)::INT)::BIGINT AS high_occupancy,
       round(100.0::DOUBLE * sum((c_acctbal > 5000)::INT) / count(*), 6) AS rate
FROM s JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "map_left_join": """
WITH c AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS avg_bal FROM customer GROUP BY 1
           HAVING count(*) > (SELECT count(*) / 25.0::DOUBLE FROM customer))
SELECT n_nationkey, n_name, n, round(avg_bal, 4) AS avg_bal FROM nation LEFT JOIN c ON n_nationkey = c_nationkey""",
    "box_stats_by_group": """
WITH q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1),
b AS (SELECT l_returnflag, n, q[1] AS q1, q[2] AS median, q[3] AS q3, 1.5 * (q[3] - q[1]) AS reach FROM q)
SELECT l_returnflag, any_value(n) AS n,
       round(min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - reach AND q3 + reach), 4) AS whisker_lo,
       round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
       round(max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - reach AND q3 + reach), 4) AS whisker_hi,
       count(*) FILTER (NOT l_extendedprice BETWEEN q1 - reach AND q3 + reach) AS outliers
FROM lineitem JOIN b USING (l_returnflag) GROUP BY 1""",
    "quantile_std_profile": f"""
SELECT metric AS "column", count(value) AS n, count(*) - count(value) AS missing, round(min(value), 4) AS min, round(avg(value), 4) AS mean,
       round(max(value), 4) AS max, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median,
       round(quantile_cont(value, 0.75), 4) AS q3, round(quantile_cont(value, 0.95), 4) AS q95, round(stddev_samp(value), 4) AS sd
FROM ({_LONG}) GROUP BY 1""",
    "histogram": """
WITH r AS (SELECT min(n_chars)::DOUBLE AS lo, (max(n_chars) - min(n_chars))::DOUBLE / 29 AS w FROM documents)
SELECT greatest(ceil((n_chars - (lo - w / 2)) / w) - 1, 0)::INTEGER AS bin,
       round(any_value(lo - w / 2 + greatest(ceil((n_chars - (lo - w / 2)) / w) - 1, 0) * w), 4) AS lo,
       round(any_value(lo - w / 2 + (greatest(ceil((n_chars - (lo - w / 2)) / w) - 1, 0) + 1) * w), 4) AS hi,
       count(*) AS n FROM documents, r GROUP BY 1""",
    "density_curve": """
WITH g AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
s AS (SELECT o_orderstatus, count(*) AS n,
      0.9 * least(stddev_samp(o_totalprice), (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / 1.34) * count(*) ^ (-0.2) AS h
      FROM orders GROUP BY 1),
pts AS (SELECT i, lo + i * (hi - lo) / 63 AS x FROM g, range(64) t(i))
SELECT o_orderstatus, round(any_value(x), 4) AS x, round(1e6 * sum(exp(-0.5 * ((x - o_totalprice) / h) ^ 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 4) AS density
FROM orders JOIN s USING (o_orderstatus), pts GROUP BY o_orderstatus, i""",
    "recode_flag_band": """
SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'strict' ELSE o_orderpriority END AS priority,
       (CASE WHEN 30 - day(o_orderdate) >= 20 THEN 2 WHEN 30 - day(o_orderdate) >= 10 THEN 1 ELSE 0 END)::INTEGER AS band,
       CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'not_low' END AS size,
       sum((o_totalprice > 400000 OR o_totalprice < 50000)::INT)::BIGINT AS extremes,
       round(avg(least(day(o_orderdate) * 8.0::DOUBLE / 365, 0.7::DOUBLE)), 4) AS occupancy,
       round(avg((exp(o_totalprice / 1e6) - 1) * 100), 4) AS odds, count(*) AS n
FROM orders GROUP BY 1, 2, 3, 4""",
    "null_rules": """
WITH i AS (SELECT l_suppkey, l_linenumber, nullif(l_discount, 0) AS disc, nullif(l_tax, 0) AS tax FROM lineitem)
SELECT l_suppkey, l_linenumber,
       round(CASE WHEN count(disc) = count(*) THEN avg(disc) END, 6) AS strict_disc,
       round(CASE WHEN count(tax) = count(*) THEN max(tax) END, 6) AS strict_tax,
       round(sum(CASE WHEN disc IS NOT NULL AND tax IS NOT NULL THEN greatest(disc, tax) END), 6) AS top,
       sum((disc IS NOT NULL)::INT + (tax IS NOT NULL)::INT)::BIGINT AS held,
       round(sum((coalesce(disc, 0) + coalesce(tax, 0)) / nullif((disc IS NOT NULL)::INT + (tax IS NOT NULL)::INT, 0)), 6) AS mean,
       round(sum(CASE WHEN disc < 0.03 THEN 0.03::DOUBLE ELSE disc END), 6) AS floored,
       round(sum(CASE WHEN disc > 0.07 THEN 0.07::DOUBLE ELSE disc END), 6) AS capped,
       count(*) FILTER ((tax IS NULL OR tax NOT IN (0.01, 0.02)) AND disc IS DISTINCT FROM 0.05) AS kept,
       count(*) FILTER (disc IS NULL AND tax IS NOT NULL) AS lacking
FROM i GROUP BY 1, 2""",
    "money_percent_parse": """
WITH t AS (SELECT l_orderkey, l_linenumber, format('${:,.2f}', l_extendedprice) AS price_text, round(l_discount * 100)::INT AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, price_text, regexp_replace(price_text, '[$,]', '', 'g')::DOUBLE AS price,
       regexp_extract(price_text, '(\\d+)', 1)::DOUBLE AS first_number, r::DOUBLE AS rate, NULL::DOUBLE AS unreadable,
       regexp_replace(price_text, '[^0-9]', '', 'g') AS digits FROM t""",
    "date_functions": """
SELECT strftime(l_shipdate, '%Y-%m') AS month, month(o_orderdate)::INTEGER AS order_month, count(*) AS n,
       round(avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), 4) AS avg_days, max(l_shipdate::DATE)::VARCHAR AS last_file
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > TIMESTAMP '1996-01-01' GROUP BY 1, 2""",
    "dedupe_last": """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "set_explode_counts": _sets_sql(),
    "indicator_pivot": """
SELECT user_id, max((event_type = 'click')::INT) AS click, max((event_type = 'error')::INT) AS error, max((event_type = 'purchase')::INT) AS purchase,
       max((event_type = 'signup')::INT) AS signup, max((event_type = 'view')::INT) AS view, count(DISTINCT event_type)::INTEGER AS kinds
FROM events GROUP BY 1""",
    "value_pivot_index": """
WITH b AS (SELECT c_mktsegment, avg(c_acctbal) AS base FROM customer GROUP BY 1),
m AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2),
x AS (SELECT c_nationkey, c_mktsegment, m / base AS i FROM m JOIN b USING (c_mktsegment))
SELECT c_nationkey, round(max(i) FILTER (c_mktsegment = 'AUTOMOBILE'), 4) AS "AUTOMOBILE", round(max(i) FILTER (c_mktsegment = 'BUILDING'), 4) AS "BUILDING",
       round(max(i) FILTER (c_mktsegment = 'FURNITURE'), 4) AS "FURNITURE", round(max(i) FILTER (c_mktsegment = 'HOUSEHOLD'), 4) AS "HOUSEHOLD",
       round(max(i) FILTER (c_mktsegment = 'MACHINERY'), 4) AS "MACHINERY", round(avg(i), 4) AS average, count(i)::INTEGER AS held
FROM x GROUP BY 1 HAVING count(i) >= 4""",
    "presence_means": """
WITH e AS (SELECT *, NOT regexp_matches(props, '"k": [0-4]\\d?\\}') AS present FROM events WHERE event_type IN ('click', 'view', 'purchase'))
SELECT present, count(*) AS n, round(avg(value), 6) AS avg_value, count(*) FILTER (props LIKE '%1%' OR props LIKE '%7%') AS n_digits,
       round(count(*) FILTER (props LIKE '%1%' OR props LIKE '%7%') / (SELECT count(*) FROM e)::DOUBLE, 6) AS share FROM e GROUP BY 1""",
    "union_unpivot_share": f"""
WITH t AS (SELECT metric, sum(value) AS total, count(*) AS n FROM (SELECT 'supplier' AS metric, s_acctbal AS value FROM supplier
  UNION ALL SELECT 'customer', c_acctbal FROM customer UNION ALL SELECT metric, value FROM ({_LONG})) GROUP BY 1)
SELECT metric, round(total, 4) AS total, n, round(total / (SELECT sum(total) FROM t), 4) AS total_share FROM t""",
    "top_per_group": """
WITH p AS (SELECT p_brand, p_partkey, floor(p_retailprice / 100)::BIGINT AS price_band FROM part),
r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY price_band DESC) AS rank,
      count(*) OVER (PARTITION BY p_brand, price_band) AS ties FROM p)
SELECT p_partkey, p_brand, price_band, rank + (ties - 1) / 2.0::DOUBLE AS mean_rank, rank::INTEGER AS rank FROM r WHERE rank <= 3""",
    "category_places": """
WITH c AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_type, p_size, n, rank() OVER (ORDER BY n DESC)::INTEGER AS place FROM c""",
    "row_numbers": """
SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS "row" FROM events""",
    "ols_trend": """
SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 4) AS r
FROM lineitem GROUP BY 1, 2""",
    "month_labels": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders",
}
