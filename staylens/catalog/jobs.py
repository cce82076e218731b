"""The ready jobs over the given tables seen as listings, quotes, descriptions and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.catalog import stand_ins as si
from staylens.catalog.base import rounded
from staylens.catalog.models import box_sql
from staylens.catalog.texts import _AFINN, _BING, _GRAM, _SCORE, _STOP, _TOK, _afinn, _bing, _lexicon, _sections_sql, _stop_words
from staylens.functions.text import ACCESS, LICENSE, NOTES, SPACE
from staylens.operators import language, terms
from staylens.operators.groups import cluster_profile
from staylens.operators.segments import override_segments
from staylens.plans import checkout, descriptions, hosts, occupancy, pricing, ratings, reviews, value_odds
from staylens.runtime import materialize


def _price(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return pricing.price_influence(materialize(si.listings(spark, d)), si.areas(spark, d), si.walkscore(spark, d), least_cities=2)


def price_influence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_price(spark, d)["index"], 4)


def price_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_price(spark, d)["r2"], 4)


def _price_rows(spark: SparkSession, d: str) -> DataFrame:
    return pricing.chart_rows(si.listings(spark, d), si.areas(spark, d), si.walkscore(spark, d))


def price_box_by_guests(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pricing.price_charts(_price_rows(spark, d))["box_by_guests"], 4)


def price_by_rating(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pricing.price_charts(_price_rows(spark, d))["price_by_rating"], 4)


def price_by_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pricing.price_charts(_price_rows(spark, d), left_out=["area_3", "area_7"])["price_by_area"], 4)


def _occupancy(spark: SparkSession, d: str) -> occupancy.OccupancyData:
    return occupancy.prepare(si.older_listings(spark, d), si.areas(spark, d), si.walkscore(spark, d))


def _rate_rows(spark: SparkSession, d: str) -> DataFrame:
    return occupancy.rate_rows(si.older_listings(spark, d), si.areas(spark, d), si.walkscore(spark, d))


def occupancy_rates_by_area(spark: SparkSession, d: str) -> DataFrame:
    rates = occupancy.occupancy_rates(_rate_rows(spark, d))["by_area"]
    return rounded(occupancy.area_map(si.areas(spark, d), rates).drop("geometry"), 4)


def occupancy_rates_by_price(spark: SparkSession, d: str) -> DataFrame:
    return rounded(occupancy.occupancy_rates(_rate_rows(spark, d))["by_price"], 4)


def occupancy_rates_by_fee(spark: SparkSession, d: str) -> DataFrame:
    return rounded(occupancy.occupancy_rates(_rate_rows(spark, d))["by_fee"], 4)


def occupancy_model(spark: SparkSession, d: str) -> DataFrame:
    return occupancy.occupancy_model(_occupancy(spark, d))["shapley_summary"]


def _chores(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return checkout.checkout_chores(si.quotes(spark, d))


def checkout_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_chores(spark, d)["means"], 4)


def checkout_chore_table(spark: SparkSession, d: str) -> DataFrame:
    out = _chores(spark, d)
    return rounded(out["chore_counts"].join(out["chore_means"], "chore"), 4)


def checkout_fees(spark: SparkSession, d: str) -> DataFrame:
    return _chores(spark, d)["fees"]


def checkout_dishes(spark: SparkSession, d: str) -> DataFrame:
    return _chores(spark, d)["dishes"]


def amenity_odds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(value_odds.amenity_odds(si.listings(spark, d), min_support=100)["odds"], 4)


def feature_odds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(value_odds.feature_odds(si.older_listings(spark, d), si.areas(spark, d))["odds"], 4)


def description_completion(spark: SparkSession, d: str) -> DataFrame:
    out = descriptions.description_report(si.described(spark, d))
    return rounded(out["completion"].drop("place").join(out["lengths"].drop("place"), "section"), 4)


def description_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(descriptions.description_report(si.described(spark, d))["length_histogram"], 4)


def description_network(spark: SparkSession, d: str) -> DataFrame:
    tokens = terms.tokenize(si.documents(spark, d), "doc_id", "text")
    stop, lexicon = materialize(_stop_words(tokens)), materialize(_lexicon(tokens))
    return descriptions.description_network(si.described(spark, d), lexicon, stop)["edges"]


def host_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hosts.host_segments(si.listings(spark, d))["summary"], 4)


def host_segments_profile(spark: SparkSession, d: str) -> DataFrame:
    """The cluster profile and value shares with a fixed rule in place of k-means."""
    table = materialize(hosts.host_table(si.listings(spark, d)))
    rule = F.when(
        (F.col("max_listings") < 30) & (F.col("avg_price_per_accommodates") < 200), F.pmod(F.col("max_listings"), F.lit(7)) + 1
    )
    ruled = table.withColumns(
        {
            "cluster": rule.cast("int"),
            "acceptance_imputed": F.when(rule.isNotNull(), F.col("avg_acceptance_rate").isNull()),
            "response_imputed": F.when(rule.isNotNull(), F.col("avg_response_rate").isNull()),
        }
    )
    profile = materialize(cluster_profile(override_segments(ruled)))
    names = profile.select("cluster", F.concat(F.lit("type "), F.col("cluster")).alias("cluster_name"))
    return rounded(hosts.name_segments(hosts.value_shares(profile), names), 4)


def rating_importance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ratings.rating_drivers(si.rated_parts(spark, d))["overall_importance"], 4)


def rating_ols(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ratings.rating_drivers(si.rated_parts(spark, d))["overall"], 4)


def _scored_reviews(spark: SparkSession, d: str) -> DataFrame:
    docs = si.reviews(spark, d)
    tokens = terms.tokenize(docs, "id", "comments")
    profiles = materialize(language.language_profiles(docs, "comments", "lang"))
    return reviews.score_reviews(docs.drop("lang"), profiles, materialize(_bing(tokens)), materialize(_afinn(tokens)))


def scored_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _scored_reviews(spark, d).drop("comments").withColumn("date", F.col("date").cast("string"))


def complaint_words(spark: SparkSession, d: str) -> DataFrame:
    scored = materialize(_scored_reviews(spark, d))
    stop = materialize(_stop_words(terms.tokenize(si.documents(spark, d), "doc_id", "text")))
    found = reviews.complaint_terms(reviews.complaint_tokens(scored, si.rated_listings(spark, d), stop))
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def complaint_impact(spark: SparkSession, d: str) -> DataFrame:
    scored = materialize(_scored_reviews(spark, d))
    stop = materialize(_stop_words(terms.tokenize(si.documents(spark, d), "doc_id", "text")))
    places = materialize(si.rated_listings(spark, d))
    found = reviews.complaint_topics(scored, places, stop)
    return rounded(reviews.complaint_impact(found["gamma"], found["names"], scored, places)["both"], 4)


QUERIES = {
    f.__name__: f
    for f in (
        price_influence, price_r2, price_box_by_guests, price_by_rating, price_by_area, occupancy_rates_by_area,
        occupancy_rates_by_price, occupancy_rates_by_fee, occupancy_model, checkout_means, checkout_chore_table,
        checkout_fees, checkout_dishes, amenity_odds, feature_odds, description_completion, description_length_histogram,
        description_network, host_segments, host_segments_profile, rating_importance, rating_ols, scored_reviews,
        complaint_words, complaint_impact,
    )
}

# --- SQL ------------------------------------------------------------------------------------

_LISTINGS = """base AS (SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS id, l_partkey % 3 AS snap, o_orderstatus AS city,
  'area_' || c_nationkey AS neighbourhood_cleansed, c_nationkey, o_custkey AS host_id, ceil(l_quantity / 7)::INTEGER AS accommodates, l_partkey, l_suppkey, l_orderkey,
  format('{:.2f}', 20 * ceil(l_quantity / 7) + l_extendedprice / 1000 + CASE WHEN p_name LIKE '%widget%' THEN 30 ELSE 0 END)::DOUBLE AS price,
  l_partkey % 40 AS reviews, l_partkey % 6 + 1 AS min_nights, day(l_shipdate) AS booked, 5 - l_discount * 10 AS rating,
  (c_nationkey * 37) % 101 + 0.0::DOUBLE AS walk_score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
_PRICED = f"{_LISTINGS}, rows AS (SELECT *, price / accommodates AS ppa FROM base WHERE reviews > 3 AND accommodates > 1 AND price < 1000 AND price > 0)"
_OCC = f"""{_LISTINGS}, homes AS (SELECT *, price / accommodates AS ppa FROM base WHERE l_suppkey % 5 <> 3),
dens AS (SELECT city, snap, neighbourhood_cleansed, count(*) / any_value({box_sql('(c_nationkey * 1.5::DOUBLE - 20)', '(0.05::DOUBLE + c_nationkey / 200.0::DOUBLE)')}) AS per_km
  FROM homes GROUP BY 1, 2, 3),
rows AS (SELECT h.*, per_km, (booked >= 20)::INT AS high FROM homes h JOIN dens USING (city, snap, neighbourhood_cleansed)
  WHERE l_orderkey % 3 < 2 AND min_nights <= 3 AND accommodates <= 4 AND booked > 0 AND booked < 30 AND reviews > 3)"""
_QUOTES = """q AS (SELECT l_orderkey AS id, l_extendedprice / nullif(date_diff('day', o_orderdate::DATE, l_shipdate::DATE), 0) AS nightly,
  CASE WHEN l_tax > 0 THEN format('{:.2f}', l_tax * 1000)::DOUBLE END AS fee, 5 - l_discount * 10 AS rv, 5 - l_tax * 10 AS rc, 5 - (l_suppkey % 10) / 10.0::DOUBLE AS ro,
  l_partkey AS k, (l_partkey % 2 = 0 OR l_partkey % 3 = 0 OR l_partkey % 5 = 0 OR l_partkey % 7 = 0 OR l_partkey % 11 = 0) AS has
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_MEANS = """round(avg(nightly), 4) AS avg_nightly_rate_quoted, round(avg(fee), 4) AS avg_cleaning_fee, round(avg(rv), 4) AS avg_rating_value,
  round(avg(rc), 4) AS avg_rating_cleanliness, round(avg(ro), 4) AS avg_rating_overall"""
_CHORE = f"""{_QUOTES}, ch AS (SELECT *, 'Turn things off' AS chore FROM q WHERE k % 2 = 0 UNION ALL SELECT *, 'Gather used towels' FROM q WHERE k % 3 = 0
  UNION ALL SELECT *, 'Lock up' FROM q WHERE k % 5 = 0 UNION ALL SELECT *, 'Additional requests' FROM q WHERE k % 7 = 0
  UNION ALL SELECT *, 'Additional requests' FROM q WHERE k % 11 = 0 UNION ALL SELECT *, 'Return keys' FROM q WHERE k % 4 = 0)"""
_HOSTS = """li AS (SELECT o_custkey AS host_id, greatest(o_custkey % 35, o_custkey % 33, o_custkey % 31) + 1 AS ml, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 101 END AS acc,
  CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 101 END AS resp, l_partkey % 6 + 1.0::DOUBLE AS mn, greatest(l_partkey % 6 + 1, 3)::DOUBLE AS stay, l_partkey % 25 AS ltm,
  ceil(l_quantity / 7) AS guests, format('{:.2f}', 20 * ceil(l_quantity / 7) + l_extendedprice / 1000 + CASE WHEN p_name LIKE '%widget%' THEN 30 ELSE 0 END)::DOUBLE AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE l_partkey % 40 > 0),
h AS (SELECT host_id, max(ml) AS ml, CASE WHEN count(acc) = count(*) THEN avg(acc) END AS acc, CASE WHEN count(resp) = count(*) THEN avg(resp) END AS resp, avg(mn) AS mn,
  avg(least(stay * ltm / 0.5::DOUBLE / 365, 0.7::DOUBLE)) AS occ, avg(price / guests) AS ppa, avg(guests) AS guests, avg(ltm) AS ltm
  FROM li WHERE ltm < 365 / stay AND price > 0 GROUP BY 1),
c AS (SELECT *, CASE WHEN ppa >= 200 THEN 9 WHEN ml >= 30 THEN 8 ELSE ml % 7 + 1 END AS cluster, (ml < 30 AND ppa < 200) AS ruled FROM h),
p AS (SELECT cluster::INTEGER AS cluster, count(*) AS "count", avg(ml) AS avg_max_listings, avg(acc) / 100 AS avg_acceptance_rate, avg(resp) / 100 AS avg_response_rate,
  avg(mn) AS avg_min_nights, avg(occ) AS avg_occupancy_estimate, avg(ppa) AS avg_price_per_accommodates, avg(guests) AS avg_accommodates, avg(ltm) AS avg_reviews_ltm,
  sum((ruled AND acc IS NULL)::INT)::BIGINT AS acceptance_imputed, sum((ruled AND resp IS NULL)::INT)::BIGINT AS response_imputed FROM c GROUP BY 1),
v AS (SELECT *, "count" * avg_max_listings * (365 * avg_occupancy_estimate) * (avg_accommodates * avg_price_per_accommodates) AS value,
  "count" * avg_max_listings AS estimated_listing_count FROM p)"""
_DESCRIBED = """SELECT doc_id, a || CASE WHEN doc_id % 3 <> 0 THEN ' The space ' ELSE ' ' END || b || CASE WHEN doc_id % 2 = 0 THEN ' Guest access ' ELSE ' ' END || c ||
  CASE WHEN doc_id % 5 <> 0 THEN ' Other things to note ' ELSE ' ' END || d AS D FROM (SELECT doc_id, coalesce(array_to_string(p[1:t], '. '), '') AS a,
  coalesce(array_to_string(p[t + 1:2 * t], '. '), '') AS b, coalesce(array_to_string(p[2 * t + 1:3 * t], '. '), '') AS c, coalesce(array_to_string(p[3 * t + 1:len(p)], '. '), '') AS d
  FROM (SELECT doc_id, string_split(text, '. ') AS p, len(string_split(text, '. ')) // 4 AS t FROM documents))"""
_SECTIONS = _sections_sql((SPACE, ACCESS, NOTES, LICENSE), _DESCRIBED)
_PLACES = """places AS (SELECT DISTINCT doc_id % 97 AS id, (['CA', 'NY', 'HI', 'TX'])[(doc_id % 97) % 4 + 1] AS state,
  CASE WHEN (doc_id % 97) % 5 = 0 THEN 'Private room' ELSE 'Entire home/apt' END AS room_type FROM labels),"""
_RECENT = f"""{_GRAM}, rec AS (SELECT d.doc_id AS id, d.doc_id % 97 AS listing_id, DATE '2019-01-01' + (d.doc_id % 365)::INT AS date, language
  FROM documents d JOIN lg USING (doc_id) WHERE d.doc_id % 365 > 57 AND (language = 'en' OR language IS NULL)),
{_TOK}, {_BING}, {_AFINN}, {_SCORE}"""

SQL = {
    "price_box_by_guests": f"""WITH {_PRICED}, r AS (SELECT * FROM rows WHERE accommodates IN (2, 4, 6, 8)),
q AS (SELECT city, accommodates, count(*) AS n, quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM r GROUP BY 1, 2)
SELECT city, accommodates, any_value(n) AS n, round(any_value(q[1]), 4) AS q1, round(any_value(q[2]), 4) AS median, round(any_value(q[3]), 4) AS q3,
  round(min(price) FILTER (price >= q[1] - 1.5 * (q[3] - q[1])), 4) AS whisker_lo, round(max(price) FILTER (price <= q[3] + 1.5 * (q[3] - q[1])), 4) AS whisker_hi,
  count(*) FILTER (price < q[1] - 1.5 * (q[3] - q[1]) OR price > q[3] + 1.5 * (q[3] - q[1])) AS outliers FROM r JOIN q USING (city, accommodates) GROUP BY 1, 2""",
    "price_by_rating": f"WITH {_PRICED} SELECT city, round(rating, 4) AS review_scores_rating, round(avg(ppa), 4) AS avg_price_per_accommodates FROM rows WHERE rating >= 4 AND ppa <= 150 GROUP BY city, rating",
    "price_by_area": f"WITH {_PRICED} SELECT city, neighbourhood_cleansed, round(avg(ppa), 4) AS avg_price_per_accommodates, round(avg(walk_score), 4) AS avg_walk_score FROM rows WHERE neighbourhood_cleansed NOT IN ('area_3', 'area_7') GROUP BY 1, 2",
    "occupancy_rates_by_area": f"""WITH {_OCC}, a AS (SELECT city, neighbourhood_cleansed, walk_score, count(*) AS n, sum(high)::BIGINT AS high_occupancy, avg(per_km) AS d FROM rows GROUP BY 1, 2, 3 HAVING count(*) > 100)
SELECT c.city, 'area_' || n_nationkey AS neighbourhood, walk_score, n, high_occupancy, round(d, 4) AS avg_listings_per_sq_km, round(high_occupancy / n::DOUBLE, 4) AS rate
FROM nation CROSS JOIN (VALUES ('F'), ('O'), ('P')) c(city) LEFT JOIN a ON neighbourhood_cleansed = 'area_' || n_nationkey AND a.city = c.city""",
    "occupancy_rates_by_price": f"""WITH {_OCC}, b AS (SELECT i::INTEGER AS bin, (i * 25)::DOUBLE AS lo, (i * 25 + 25)::DOUBLE AS hi FROM range(8) t(i))
SELECT bin, lo, hi, count(id) AS n, coalesce(sum(high), 0)::BIGINT AS high_occupancy, round(100.0::DOUBLE * sum(high) / nullif(count(id), 0), 4) AS rate
FROM b LEFT JOIN rows ON ppa > lo AND ppa <= hi GROUP BY 1, 2, 3""",
    "occupancy_rates_by_fee": f"""WITH {_OCC} SELECT (l_suppkey % 11) * 5.0::DOUBLE AS extra_people, count(*) AS n, sum(high)::BIGINT AS high_occupancy, round(100.0::DOUBLE * sum(high) / count(*), 4) AS rate FROM rows GROUP BY 1""",
    "checkout_means": f"WITH {_QUOTES} SELECT has AS present, count(*) AS n, {_MEANS} FROM q GROUP BY 1",
    "checkout_chore_table": f"WITH {_CHORE} SELECT chore, count(*) AS n, round(count(*) / (SELECT count(*) FROM q)::DOUBLE, 4) AS share, {_MEANS} FROM ch GROUP BY 1",
    "checkout_fees": f"WITH {_QUOTES} SELECT has AS has_instructions, fee IS NOT NULL AS has_cleaning_fee, count(*) AS n FROM q GROUP BY 1, 2",
    "checkout_dishes": f"WITH {_QUOTES} SELECT k % 7 = 0 AS dishes, count(*) AS n FROM q WHERE has GROUP BY 1",
    "description_completion": f"""{_SECTIONS}, long AS (SELECT unnest(['Description', 'Space', 'Guest_access', 'Other_things_to_note']) AS section,
  unnest([length(Description), length(Space), length(Guest_access), length(Other_things_to_note)]) AS len FROM sec)
SELECT section, round(count(len) / count(*)::DOUBLE, 4) AS "percent", round(avg(len), 4) AS avg_length FROM long GROUP BY 1""",
    "description_length_histogram": f"""{_SECTIONS}, x AS (SELECT length(Description) AS v FROM sec WHERE length(Description) <= 500),
r AS (SELECT min(v)::DOUBLE AS lo, (max(v) - min(v))::DOUBLE / 29 AS w FROM x),
b AS (SELECT greatest(ceil((v - (lo - w / 2)) / w) - 1, 0)::INTEGER AS bin, lo, w FROM x, r)
SELECT bin, round(any_value(lo - w / 2 + bin * w), 4) AS lo, round(any_value(lo - w / 2 + (bin + 1) * w), 4) AS hi, count(*) AS n FROM b GROUP BY 1""",
    "host_segments_profile": f"""WITH {_HOSTS} SELECT cluster, "count", round(avg_max_listings, 4) AS avg_max_listings, round(avg_acceptance_rate, 4) AS avg_acceptance_rate,
  round(avg_response_rate, 4) AS avg_response_rate, round(avg_min_nights, 4) AS avg_min_nights, round(avg_occupancy_estimate, 4) AS avg_occupancy_estimate,
  round(avg_price_per_accommodates, 4) AS avg_price_per_accommodates, round(avg_accommodates, 4) AS avg_accommodates, round(avg_reviews_ltm, 4) AS avg_reviews_ltm,
  acceptance_imputed, response_imputed, round(value, 4) AS value, round(value / sum(value) OVER (), 4) AS value_percent, round(estimated_listing_count, 4) AS estimated_listing_count,
  round(estimated_listing_count / sum(estimated_listing_count) OVER (), 4) AS estimated_listing_count_percent, round("count" / sum("count") OVER ()::DOUBLE, 4) AS host_percent,
  'type ' || cluster AS cluster_name FROM v""",
    "scored_reviews": f"WITH {_RECENT} SELECT id, listing_id, date::DATE::VARCHAR AS date, language, bing_sentiment, afinn_sentiment FROM rec JOIN sc ON sc.doc_id = rec.id",
    "complaint_words": f"""WITH {_RECENT}, {_STOP}, {_PLACES}
neg AS (SELECT rec.id FROM rec JOIN sc ON sc.doc_id = rec.id JOIN places p ON p.id = rec.listing_id WHERE afinn_sentiment < -3 AND state <> 'HI' AND room_type = 'Entire home/apt'),
w AS (SELECT id, regexp_replace(word, 'beds', 'bed') AS word FROM neg JOIN tok ON tok.doc_id = neg.id WHERE NOT regexp_matches(word, '[0-9]'))
SELECT word, count(*) AS n, count(DISTINCT id) AS docs FROM w WHERE word NOT IN (SELECT word FROM stop) AND word NOT IN ({", ".join(repr(x) for x in reviews.EMPTY_WORDS)}) GROUP BY 1""",
}
