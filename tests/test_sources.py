import gzip
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.clean import parse_money
from staylens.functions.geo import area_sq_km
from staylens.runtime import broadcast_if_small, column_names, materialize, spread
from staylens.sources import files, links, sinks
from staylens.streaming import stream_snapshots


def write_gz(path, text):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(text)


def test_snapshots_of_two_layouts(spark, tmp_path):
    write_gz(tmp_path / "listings denver 2022-03-01.csv.gz", 'id,price,note\n1,"$1,200.00","two\nlines, ""quoted"""\n2,$50.00,x\n')
    write_gz(tmp_path / "listings denver 2022-06-01.csv.gz", "price,id,beds\n$70.00,1,3\n")
    write_gz(tmp_path / "listings chicago 2022-06-01.csv.gz", "id,price,note\n9,$1.00,y\n")
    write_gz(tmp_path / "reviews denver 2022-06-01.csv.gz", "id\n7\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("beds", T.IntegerType())])
    df = files.read_snapshots(spark, str(tmp_path), "listings", city="denver", period="2022", schema=schema, city_pattern=r"listings (\w+)")
    got = {(r.id, str(r.filedate)): (r.money, r.beds, r.note, r.filecity) for r in df.withColumn("money", parse_money("price")).collect()}
    assert got == {
        (1, "2022-03-01"): (1200.0, None, 'two\nlines, "quoted"', "denver"),
        (2, "2022-03-01"): (50.0, None, "x", "denver"),
        (1, "2022-06-01"): (70.0, 3, None, "denver"),
    }
    assert files.read_snapshots(spark, str(tmp_path), period="2022-06").count() == 2


def test_folder_links_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, None)], "id int, t string")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = files.read_folder(spark, str(tmp_path / "out"))
    assert sorted((r.id, r.t) for r in back.collect()) == [("1", 'a,"b"\nc'), ("2", None)]
    sinks.write_tsv(df.select("id"), str(tmp_path / "tsv"))
    assert spark.read.options(header=True, sep="\t").csv(str(tmp_path / "tsv")).count() == 2
    sinks.write_snapshots(df.withColumn("filedate", F.lit("2022-01-01")), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).where("filedate = '2022-01-01'").count() == 2

    (tmp_path / "us").mkdir()
    write_gz(tmp_path / "us" / "listings.csv.gz", "id\n5\n")
    html = '<a href="http://x.org/us/listings.csv.gz">l</a><a class="z" href="http://x.org/us/visual/listings.csv">v</a><a href="/other">o</a>'
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    found = links.extract_links(pages, include=["us", "listings"], exclude=["visual"])
    assert [r.link for r in found.collect()] == ["http://x.org/us/listings.csv.gz"]
    assert [r.id for r in links.read_links(spark, found, str(tmp_path)).collect()] == ["5"]


def test_links_of_odd_pages(spark):
    pages = {
        1: "<A HREF='/a?x=1&amp;y=2'>x</A><a class=c href=/b/>y</a><a href = \"/c\" href=/no>z</a>",
        2: "<!-- <a href=/no> --><!--><a href=/d><script>'<a href=/no>'</script><STYLE><a href=/no></style ><title><a href=/no></title><a href=/e>",
        3: "<a title='<a href=/no>' data-href=/no href=/f><a name=here><area href=/no><abbr href=/no><a/href=/g>",
        4: "<a href='&#47;h&#x2F;&lt;&nope;&amp;lt;&#0;&#xD800;&#9999999999;&'><a href><a href=''>",
        5: "1 < 2 <b <a href=/no><a href=/i",
        6: None,
        7: "",
        8: "<p title=\"" + "x" * 200_000 + "\">" + "<a href=\"/" + "y" * 100_000 + "\">" + "<b class='q'>" * 20_000,
        9: "<script><a href=/no>",
    }
    df = spark.createDataFrame(list(pages.items()), "id int, html string")
    got = {r.id: r.links for r in df.select("id", links.hrefs("html").alias("links")).collect()}
    assert got[1] == ["/a?x=1&y=2", "/b/", "/c"]
    assert got[2] == ["/d", "/e"] and got[3] == ["/f", "/g"]
    assert got[4] == ["/h/<&nope;&lt;\ufffd\ufffd\ufffd&", "", ""]
    assert got[5] == [] and got[6] is None and got[7] == [] and got[9] == []
    assert [len(x) for x in got[8]] == [100_001]


def test_geojson(spark, tmp_path):
    box = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    shapes = [("one", {"type": "Polygon", "coordinates": [box]}), ("two", {"type": "MultiPolygon", "coordinates": [[box], [box]]})]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"neighbourhood": n}, "geometry": g} for n, g in shapes]}
    (tmp_path / "denver.geojson").write_text(json.dumps(doc, indent=1))
    got = {r.neighbourhood: r.a for r in files.read_geojson(spark, str(tmp_path / "denver.geojson")).withColumn("a", area_sq_km("geometry")).collect()}
    assert round(got["one"], 2) == 12308.46 and round(got["two"] / got["one"], 9) == 2


def test_stream_applies_row_steps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_gz(tmp_path / "in" / "listings 2022-03-01.csv.gz", "id,price\n1,$5.00\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.StringType())])
    stream = stream_snapshots(spark, str(tmp_path / "in"), schema).withColumn("money", parse_money("price"))
    query = stream.writeStream.format("memory").queryName("snapshots").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.id, r.money, str(r.filedate)) for r in spark.sql("select * from snapshots").collect()] == [(1, 5.0, "2022-03-01")]


def test_runtime(spark, tmp_path):
    df = spark.range(10)
    stored = materialize(df, str(tmp_path / "t"))
    assert stored.count() == 10 and "t" in stored.inputFiles()[0]
    small = broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString()
    large = broadcast_if_small(df, 9)._jdf.queryExecution().logical().toString()
    assert "broadcast" in small.lower() and "broadcast" not in large.lower()
    assert spread(spark.range(0, 4, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert column_names(["a.b", "A_B", "", "c"], ["c"]) == ["a_b", "A_B (2)", "blank", "c (2)"]


def test_files_to_job(spark, tmp_path):
    """Typed columns and the city come with the files."""
    write_gz(tmp_path / "listings denver 2022-06-03.csv.gz", 'id,price,review_scores_rating,accommodates\n1,"$1,000.00",4.5,2\n2,$50.00,oops,4\n')
    from staylens.plans.common import clean_listings

    df = clean_listings(files.read_snapshots(spark, str(tmp_path), "listings", city_pattern=r"listings (\w+)"))
    rows = {r.id: (r.city, r.price, r.review_scores_rating, r.price_per_accommodates) for r in df.collect()}
    assert rows == {1: ("denver", 1000.0, 4.5, 500.0), 2: ("denver", 50.0, None, 12.5)}
    (tmp_path / "denver shapes.geojson").write_text(
        json.dumps({"type": "FeatureCollection", "features": [{"properties": {"neighbourhood": "n", "group": "g"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]})
    )
    got = files.read_geojson(spark, str(tmp_path / "denver shapes.geojson"), properties=["neighbourhood", "group"]).first()
    assert (got.neighbourhood, got.group, got.city) == ("n", "g", "denver")
