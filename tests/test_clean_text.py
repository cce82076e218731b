import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.functions import clean
from staylens.functions import text as tx
from staylens.functions.geo import area_sq_km


def one(spark, value, *exprs, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return tuple(df.select(*[e.alias(f"x{i}") for i, e in enumerate(exprs)]).first())


@pytest.mark.parametrize(
    "text, money, percent, first",
    [("$1,234.00", 1234.0, None, 1.0), ("98%", None, 98.0, 98.0), ("", None, None, None), (None, None, None, None), ("abc", None, None, None)],
)
def test_numbers_from_text(spark, text, money, percent, first):
    assert one(spark, text, clean.parse_money("c"), clean.parse_percent("c"), clean.parse_first_number("c")) == (money, percent, first)


@pytest.mark.parametrize("given, wanted", [(4.8, 4.8), (96.0, 4.8), (5.0, 5.0), (5.01, 5.01 / 20), (None, None)])
def test_rescale(spark, given, wanted):
    assert one(spark, given, clean.rescale_rating("c"), kind="double")[0] == pytest.approx(wanted)


@pytest.mark.parametrize("nights, wanted", [(0, 0), (9, 0), (10, 1), (19, 1), (20, 2), (30, 2), (None, 0)])
def test_band(spark, nights, wanted):
    assert one(spark, nights, clean.band("c", [10, 20]), kind="int")[0] == wanted


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, None, 5.0), (2, 4.0, 1.0)], "k int, a double, b double")
    rows = df.select(clean.row_max("a", "b"), clean.row_mean("a", "b"), clean.row_count("a", "b"), clean.cap("a", 3.0), clean.floor_at("a", 3.0)).collect()
    assert [tuple(r) for r in rows] == [(3.0, 2.5, 2, 2.0, 3.0), (None, 5.0, 1, None, None), (4.0, 2.5, 2, 3.0, 4.0)]
    strict = dict(df.groupBy("k").agg(clean.strict_avg("a")).collect())
    assert strict == {1: None, 2: 4.0}
    assert df.where(clean.not_in("a", [2.0])).count() == 2
    assert df.where(clean.ne_keep_null("a", 2.0)).count() == 2
    assert one(spark, None, clean.label_if(F.col("c") > 1, "y", "n"), kind="int")[0] is None
    assert one(spark, 0, clean.ratio(F.lit(1), "c"), kind="int")[0] is None
    back = clean.inf_to_null(spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,)], "v double"))
    assert [r.v for r in back.collect()] == [None, None, 1.0]
    assert clean.blank_to_null(spark.createDataFrame([("",), ("x",)], "v string")).where("v is null").count() == 1


def test_file_names(spark):
    name = "file:/data%202019/listings%20austin%202020-04-17.csv.gz"
    got = one(spark, name, clean.file_date("c").cast("string"), clean.file_city("c", r"listings (\w+)"), clean.file_city("c", offset=9), clean.base_name("c"))
    assert got == ("2020-04-17", "austin", "austin", "listings austin 2020-04-17.csv.gz")


def test_formats(spark):
    assert one(spark, 1234567.0, clean.fmt("c", "number"), clean.fmt("c", "currency", 2), clean.fmt("c", "millions", 1), kind="double") == ("1,234,567", "$1,234,567.00", "$1.2M")
    assert one(spark, 0.256, clean.fmt("c", "percent"), kind="double") == ("26%",)


def test_recode(spark):
    assert one(spark, "a", clean.recode("c", {"a": "b"}), clean.recode("c", {"x": "y"}, "Other"), clean.recode("c", {"x": "y"}, keep_unmapped=True)) == ("b", "Other", "a")
    assert one(spark, None, clean.recode("c", {"a": "b"}, "Other")) == ("Other",)


@pytest.mark.parametrize(
    "text, dialect, wanted",
    [
        ('["Wifi", "Long, wide", "Wifi"]', "brackets", ["Wifi", "Long", "wide", "Wifi"]),
        ('{Wifi,"Air conditioning"}', "braces", ["Wifi", "Air conditioning"]),
        ("['Lock up', 'Return keys']", "quotes", ["Lock up", "Return keys"]),
        ('["Wifi", "Long, wide"]', "json", ["Wifi", "Long, wide"]),
        ("[]", "brackets", [""]),
        (None, "brackets", None),
    ],
)
def test_sets(spark, text, dialect, wanted):
    assert one(spark, text, tx.set_items("c", dialect))[0] == wanted


def test_replacements(spark):
    assert one(spark, "a.b.a.b", tx.replace_first("c", "a.b", "$x"), tx.remove_phrases("c", ["a.", "."]), tx.delimiter_count("c", ".")) == ("$x.a.b", "bb", 3)
    got = [one(spark, s, tx.normalise_terms("c"))[0] for s in ("check - in", "checkin", "check in", "check - out", "checkout", "check out")]
    assert got == ["check-in"] * 3 + ["check-out"] * 3


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(tx.ngrams("t", 2)).collect()] == [["a b", "b c"], [], []]
    assert [r[0] for r in df.select(tx.ngrams("t", 3)).collect()] == [["a b c"], [], []]
    assert [tuple(x) for x in df.select(tx.neighbours("t")).first()[0]] == [("a", "b"), ("b", "c")]


@pytest.mark.parametrize(
    "words, phrases, wanted",
    [
        ("check in please", ["check in"], ["check in", None, "please"]),
        ("please check in", ["check in"], ["please", "check in", None]),
        ("a a a a a", ["a a"], ["a a", None, "a a", None, "a"]),
        ("check - in x", ["check - in", "check - out"], ["check - in", None, None, "x"]),
        ("x", ["check in"], ["x"]),
        ("", ["check in"], []),
    ],
)
def test_recode_phrases(spark, words, phrases, wanted):
    df = spark.createDataFrame([(words.split(),)], "t array<string>")
    assert df.select(tx.recode_phrases("t", phrases)).first()[0] == wanted


def test_sections(spark):
    rows = [
        ("1", "Nice.The spaceBig.Guest accessAll.Other things to noteNone.License number12"),
        ("2", "Guest accessDoor.Other things to noteQuiet"),
        ("3", "Plain"),
        ("4", None),
        ("5", "A.Other things to noteN.The spaceB.Guest accessC"),
        ("6", "A.The spaceB.The spaceC"),
    ]
    got = {r.id: r for r in tx.description_sections(spark.createDataFrame(rows, "id string, description string")).collect()}
    assert tuple(got["1"][s] for s in tx.SECTIONS) == ("Nice.", "Big.", "All.", "None.", "12")
    assert tuple(got["2"][s] for s in tx.SECTIONS) == (None, None, "Door.", "Quiet", None)
    assert (got["3"].Description, got["3"].has_Space) == ("Plain", 0)
    assert got["4"].Description is None and got["4"].has_Description == 0
    assert (got["5"].Description, got["5"].Other_things_to_note, got["5"].Space, got["5"].Guest_access) == ("A.", "N.", "B.", "C")
    assert got["6"].Space == "B."


def test_trigrams_cover_the_whole_text(spark):
    assert one(spark, "Ab, c!", tx.trigrams("c"))[0] == [" ab", "ab ", "b c", " c "]
    assert len(one(spark, "x" * 5000, tx.trigrams("c"))[0]) == 5000


def test_area(spark):
    def box(x, y, s):
        return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]

    shapes = [(1, [[box(0.0, 0.0, 1.0)]]), (2, [[box(0.0, 0.0, 1.0), box(0.25, 0.25, 0.5)]]), (3, [[box(0.0, 0.0, 1.0)], [box(2.0, 0.0, 1.0)]])]
    df = spark.createDataFrame(shapes, "k int, g array<array<array<array<double>>>>")
    got = dict(df.select("k", area_sq_km("g")).collect())
    assert got[1] == pytest.approx(12308.464, abs=0.01)
    assert got[2] == pytest.approx(got[1] * 0.75, rel=1e-3)
    assert got[3] == pytest.approx(2 * got[1])
    assert np.isfinite(list(got.values())).all()
