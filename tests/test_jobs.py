"""Each job from end to end on generated rows with planted effects."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staylens.plans import checkout, descriptions, hosts, occupancy, pricing, ratings, reviews, value_odds


def box(x, y, s=0.1):
    return [[[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]]


@pytest.fixture(scope="module")
def areas(spark):
    rows = [(c, f"n{i}", box(i * 1.0, 10.0)) for c in ("denver", "chicago") for i in range(3)]
    return spark.createDataFrame(rows, "city string, neighbourhood string, geometry array<array<array<array<double>>>>")


@pytest.fixture(scope="module")
def walkscore(spark):
    return spark.createDataFrame([(f"n{i}", 50.0 + i * 10, 1000 * (i + 1)) for i in range(3)], "neighbourhood string, walk_score double, population long")


@pytest.fixture(scope="module")
def listings(spark):
    rng = np.random.default_rng(11)
    n = 900
    pool = rng.random(n) < 0.4
    guests = rng.integers(1, 9, n)
    price = 30 + 20 * guests + 60 * pool + rng.normal(0, 5, n)
    booked = np.where(pool, rng.integers(18, 30, n), rng.integers(1, 20, n))
    score = lambda: np.round(rng.uniform(4, 5, n), 2)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n), "city": np.where(np.arange(n) % 2, "denver", "chicago"), "filedate": dt.date(2022, 3, 1),
            "neighbourhood_cleansed": [f"n{i}" for i in rng.integers(0, 3, n)], "host_id": rng.integers(0, 300, n),
            "host_is_superhost": rng.choice(["t", "f"], n), "room_type": rng.choice(["Entire home/apt", "Private room", "Hotel room"], n),
            "instant_bookable": rng.choice(["t", "f"], n), "accommodates": guests, "bedrooms": (guests + 1) // 2 * 1.0, "beds": guests * 1.0,
            "price": [f"${p:,.2f}" for p in price], "minimum_nights_avg_ntm": 2.0, "maximum_nights_avg_ntm": 60.0, "number_of_reviews": 9,
            "number_of_reviews_ltm": rng.integers(0, 30, n), "last_review": dt.date(2022, 2, 1), "calendar_last_scraped": dt.date(2022, 3, 1),
            "review_scores_rating": rng.uniform(80, 100, n).round(0), "review_scores_accuracy": score(), "review_scores_cleanliness": score(),
            "review_scores_checkin": score(), "review_scores_communication": score(), "review_scores_location": score(),
            "review_scores_value": np.where(pool, 4.9, np.where(rng.random(n) < 0.3, 4.85, 4.5)),
            "amenities": ['["Wifi", "Pool"]' if p else '["Wifi", "First aid kit"]' for p in pool],
            "host_response_rate": [None if r < 0.2 else f"{int(100 * r)}%" for r in rng.random(n)],
            "host_acceptance_rate": [None if r < 0.2 else f"{int(100 * r)}%" for r in rng.random(n)],
            "host_total_listings_count": rng.integers(1, 12, n), "host_listings_count": 1, "calculated_host_listings_count": 1,
            "property_type": rng.choice(["Apartment", "House", "Loft", "Hostel"], n), "cancellation_policy": rng.choice(["flexible", "super_strict_60"], n),
            "calendar_updated": rng.choice(["today", "3 months ago"], n, p=[0.9, 0.1]), "minimum_nights": 2, "availability_30": 30 - booked,
            "cleaning_fee": "$20.00", "security_deposit": None, "extra_people": rng.choice(["$0.00", "$10.00"], n),
        }
    )
    pdf["security_deposit"] = pdf["security_deposit"].astype(object)
    return spark.createDataFrame(pdf.drop(columns="security_deposit")).withColumn("security_deposit", F.lit(None).cast("string")).cache()


def test_price_influence(listings, areas, walkscore):
    out = pricing.price_influence(listings, areas, walkscore, min_support=20, least_cities=2)
    coef = {r.variable: r for r in out["index"].collect()}
    assert coef["Pool"].average > 0.05 and coef["accommodates"].average > 0.1
    assert "First aid kit" not in coef and abs(coef["Wifi"].average) < 1e-9
    assert out["r2"].where("city = 'average'").first().r2 > 0.9
    assert {r.variable for r in pricing.strong_features(out["index"]).collect()} <= set(coef)
    charts = pricing.price_charts(out["rows"])
    assert charts["box_by_guests"].count() == 8 and charts["price_by_area"].count() == 6


def test_occupancy(listings, areas, walkscore):
    data = occupancy.prepare(listings.withColumn("amenities", F.translate("amenities", "[]", "{}")), areas, walkscore, min_support=20)
    got = data.rows.agg(F.min("days_booked_n30"), F.max("days_booked_n30")).first()
    assert 0 < got[0] and got[1] < 30 and "property_type_Other" in data.features and "cancellation_policy_strict" in data.features
    rates = occupancy.occupancy_rates(data.rows, least=1)
    assert rates["by_price"].count() == 8 and rates["by_host_size"].agg(F.max("num_listings_bin")).first()[0] == 10
    assert rates["by_month"].first().month == "2022-03" and rates["by_fee"].count() == 2
    assert occupancy.area_map(areas, rates["by_area"]).count() == 6
    out = occupancy.occupancy_model(data, max_iter=2)
    assert out["confusion"].count() == 3 and 0 <= out["accuracy"].first()[0] <= 1
    assert out["shapley_summary"].count() == 3 * len(data.features)


def test_value_odds(listings, areas):
    out = value_odds.amenity_odds(listings.withColumn("review_scores_rating", F.lit(4.5)), min_support=100)
    odds = {r.variable: r.odds_change_pct for r in out["odds"].collect()}
    assert odds["Pool"] > 0 > odds["First aid kit"]
    assert out["roc"].agg(F.sum("auc_part")).first()[0] > 0.7
    older = listings.withColumns(
        {"review_scores_value": F.when(F.col("accommodates") > 4, 10.0).otherwise(9.0), "security_deposit": F.lit("$100.00"), "amenities": F.lit("{Wifi,\"Pets allowed\"}")}
    )
    small = areas.withColumn("geometry", F.col("geometry"))
    got = value_odds.feature_odds(older, small)
    assert got["accuracy"].first()[0] > 0.4 and got["quantiles"].count() == 6 and got["std"].count() == 6
    assert {r.variable for r in got["odds"].collect()} >= {"bedrooms_per_accommodates", "pets_allowed", "property_type_Apartment/Condo"}


def test_checkout(spark):
    day = dt.date
    rows = [
        (1, day(2023, 1, 1), day(2023, 1, 3), "$1,200.00", "$50.00", 4.0, 4.0, 4.5, "['Lock up', 'Additional requests\nDo the dishes']"),
        (2, day(2023, 1, 30), day(2023, 2, 1), "$100.00", None, 5.0, 5.0, 5.0, None),
        (3, day(2023, 1, 1), day(2023, 1, 1), "$100.00", "$20.00", 3.0, 4.0, 4.0, "['Lock up']"),
    ]
    quotes = spark.createDataFrame(rows, "id long, checkin date, checkout date, total_rate string, cleaning_fee string, rating_value double, rating_cleanliness double, rating_overall double, before_you_leave string")
    out = checkout.checkout_chores(quotes)
    assert tuple(out["presence"].first()) == (3, 2)
    assert {r.chore: (r.n, round(r.share, 3)) for r in out["chore_counts"].collect()} == {"Lock up": (2, 0.667), "Additional requests": (1, 0.333)}
    assert {r.present: r.avg_nightly_rate_quoted for r in out["means"].collect()} == {True: 600.0, False: 50.0}
    assert {r.dishes: r.n for r in out["dishes"].collect()} == {True: 1, False: 1}
    assert checkout.prepare_quotes(quotes, first_digits=True).where("id = 1").first().nightly_rate_quoted == 0.5


def test_descriptions(spark):
    text = "Bright quiet flat.The spaceTwo big rooms.Guest accessWhole flat.Other things to noteNo smoking."
    listing = spark.createDataFrame([(f"https://r/rooms/{i}", text if i % 2 else "Bright quiet flat.") for i in range(10)], "url string, description string")
    out = descriptions.description_report(listing)
    assert {r.section: r.percent for r in out["completion"].collect()} == {"Description": 1.0, "Space": 0.5, "Guest_access": 0.5, "Other_things_to_note": 0.5}
    assert {r.section: r.avg_length for r in out["lengths"].collect()}["Description"] == 18
    assert out["length_histogram"].agg(F.sum("n")).first()[0] == 10
    words = "bright quiet flat big rooms whole smoking two no".split()
    lexicon = spark.createDataFrame([(w, w, "ADJ") for w in words], "token string, lemma string, upos string")
    net = descriptions.description_network(listing, lexicon, spark.createDataFrame([("no",)], "word string"), min_bigram=50, n=5)
    edges = {(r.section, r.src, r.dst): r.n for r in net["edges"].collect()}
    assert edges[("Description", "bright", "quiet")] == 10 and edges[("Space", "big", "rooms")] == 5


def test_hosts(spark, listings):
    names = spark.createDataFrame([(i, f"type {i}") for i in range(1, 10)], "cluster int, cluster_name string")
    out = hosts.host_segments(listings, names, k=3, nstart=2, maxit=1)
    summary = out["summary"].collect()
    assert sum(r.value_percent for r in summary) == pytest.approx(1) and sum(r.host_percent for r in summary) == pytest.approx(1)
    assert out["hosts"].count() == listings.select("host_id").where("number_of_reviews_ltm < 365 / 3").distinct().count()
    assert hosts.summary_text(out["summary"]).first().value.startswith("$")


def test_rating_drivers(spark):
    rng = np.random.default_rng(12)
    x = rng.uniform(3, 5, (500, 6))
    pdf = pd.DataFrame(x, columns=ratings.PARTS)
    pdf["star_rating"] = 0.7 * pdf.rating_accuracy + 0.2 * pdf.rating_value + rng.normal(0, 0.05, 500)
    out = ratings.rating_drivers(spark.createDataFrame(pdf))
    first = out["overall_importance"].first()
    assert first.category == "Accuracy" and first.share > 0.8
    assert out["value_importance"].count() == 5 and out["overall"].count() == 7


def test_reviews(spark):
    bad = ["dirty stain awful awful", "noise loud awful awful"]
    rows = [(i, i % 8, dt.date(2019, 6, 1), f"the {bad[i % 2]} and the room" if i < 40 else "the lovely lovely room and the view") for i in range(60)]
    rows.append((99, 1, dt.date(2018, 1, 1), "the awful awful room"))
    df = spark.createDataFrame(rows, "id long, listing_id long, date date, comments string")
    profiles = spark.createDataFrame([("en", "the", 5.0), ("fr", "les", 5.0)], "lang string, gram string, weight double")
    bing = spark.createDataFrame([("awful", "negative"), ("lovely", "positive")], "word string, sentiment string")
    afinn = spark.createDataFrame([("awful", -3), ("lovely", 3)], "word string, value int")
    scored = reviews.score_reviews(df, profiles, bing, afinn)
    assert scored.count() == 60 and scored.where("afinn_sentiment = -6").count() == 40
    places = spark.createDataFrame([(i, 80.0 + i, "HI" if i == 7 else "CA", "Entire home/apt") for i in range(8)], "id long, review_scores_rating double, state string, room_type string")
    stop = spark.createDataFrame([("the",), ("and",), ("awful",)], "word string")
    out = reviews.complaint_topics(scored, places, stop, k=2, max_iter=10, n_terms=3)
    assert out["counts"].select("id").distinct().count() == 35 and out["names"].count() == 2
    impact = reviews.complaint_impact(out["gamma"], out["names"], scored, places)
    assert {r.avg_sentiment for r in impact["severity"].collect()} == {6.0}
    assert impact["both"].count() == 2 and impact["frequency"].agg(F.sum("n")).first()[0] >= 35
    charts = reviews.review_charts(scored, places, n=1000, points=32)
    assert charts["by_rating"].count() == 8 and charts["sentiment_density"].count() == 32


def test_feature_rows_do_not_multiply(spark, listings, areas):
    from staylens.plans import value_odds

    one = listings.withColumns({"review_scores_value": F.lit(10.0), "security_deposit": F.lit("$100.00"), "amenities": F.lit("{Wifi}"), "number_of_reviews": F.lit(9)})
    late = one.withColumns({"filedate": F.date_add("filedate", 31), "id": F.col("id") + 10_000_000})
    rows = value_odds.feature_rows(one.unionByName(late), areas)
    assert rows.count() == rows.select("id").distinct().count() == 2 * value_odds.feature_rows(one, areas).count() > 0


def test_charts_read_narrow_rows(spark):
    """Charts read the rows of the model without the columns of levels and amenities."""
    from staylens.catalog import stand_ins as si

    d = "/root/testdata/sf0.001"
    given = si.listings(spark, d), si.areas(spark, d), si.walkscore(spark, d)
    narrow, wide = pricing.chart_rows(*given), pricing.prepare_city_data(*given, 5)
    assert wide.optional and not set(narrow.columns) & (set(wide.features) - set(pricing.NUMERIC))
    rows = sorted(map(str, narrow.collect()))
    assert len(rows) > 100 and rows == sorted(map(str, wide.rows.select(narrow.columns).collect()))


def test_rates_read_narrow_rows(spark):
    """Rates read the rows of the model without the columns of levels and amenities."""
    from staylens.catalog import stand_ins as si

    d = "/root/testdata/sf0.001"
    given = si.older_listings(spark, d), si.areas(spark, d), si.walkscore(spark, d)
    narrow, wide = occupancy.rate_rows(*given), occupancy.prepare(*given, 5)
    assert not set(narrow.columns) & (set(wide.features) - {*occupancy.SCALED, "amenities_count"}) and len(wide.features) > len(narrow.columns)
    rows = sorted(map(str, narrow.collect()))
    assert len(rows) > 100 and rows == sorted(map(str, wide.rows.select(narrow.columns).collect()))


def test_snapshots_of_features_meet_once_and_narrow(spark, listings, areas, monkeypatch):
    """No text of a listing is shuffled: what is compared by id is the typed columns that are read, and it is stored."""
    met, stored = [], []
    whole, keep = value_odds.dedupe_last, value_odds.materialize
    monkeypatch.setattr(value_odds, "dedupe_last", lambda df, *a: met.append(df.columns) or whole(df, *a))
    monkeypatch.setattr(value_odds, "materialize", lambda df: stored.append(df.columns) or keep(df))
    rows = value_odds.feature_rows(listings, areas)
    own = {*value_odds.SCALED, *value_odds.CATEGORIES, "id", "filedate", "city", "neighbourhood_cleansed", "has_value", "pets_allowed"} - {"listings_per_sq_km"}
    assert len(met) == 1 and set(met[0]) == own | {"__row"} and any(set(c) == own for c in stored)
    assert rows.count() > 0 and not any("Aggregate" in line and "max_by" in line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines())
