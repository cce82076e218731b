import collections
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staylens.operators import evaluate, groups, language, phrases, ranks, reshape, sentiment, terms


@pytest.fixture(scope="module")
def hot(spark):
    """One key with most of the rows and many equal values."""
    rng = np.random.default_rng(1)
    n = 4000
    key = np.where(rng.random(n) < 0.8, "hot", rng.choice(list("abc"), n))
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "v": np.round(rng.gamma(2, 10, n), 1)})
    pdf.loc[rng.random(n) < 0.3, "v"] = 7.0
    return pdf, spark.createDataFrame(pdf).repartition(7)


@pytest.mark.parametrize("cells, rows", [(4096, 200_000), (3, 2), (2, 1)])
def test_quantiles_by_selection(spark, monkeypatch, cells, rows):
    monkeypatch.setattr(ranks, "CELLS", cells)
    monkeypatch.setattr(ranks, "CELL_ROWS", rows)
    monkeypatch.setattr(ranks, "ROUNDS", 4)
    rng = np.random.default_rng(8)
    groups = {
        "normal": rng.normal(size=101), "tail": np.exp(rng.normal(size=60) * 30), "ties": rng.integers(0, 3, 90).astype(float), "one": np.array([5.0]),
        "signs": np.array([-1e308, -2.0, -1e-300, 0.0, -0.0, 1e-300, 3.0, 1e308]), "same": np.full(40, -7.25), "two": np.array([1.0, 2.0]),
    }
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None), (None, 1.0), ("empty", None)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    got = {r.k: r for r in ranks.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        want = np.sort(vs)
        for q, x in zip(probs, got[k].q):
            at = q * (len(vs) - 1)
            lo, hi = want[int(np.floor(at))], want[int(np.ceil(at))]
            assert lo <= x <= hi and x == pytest.approx(lo + (at - np.floor(at)) * (hi - lo), rel=1e-12) if np.isfinite(hi - lo) else True
    alone = ranks.exact_quantiles(df.where("k = 'normal'"), [], "v", [0.5]).collect()
    assert alone[0].q[0] == pytest.approx(np.median(groups["normal"]))
    assert ranks.exact_quantiles(df.where("false"), ["k"], "v", [0.5]).count() == 0


def test_exact_quantiles(hot):
    pdf, df = hot
    got = {r.k: r for r in ranks.exact_quantiles(df, ["k"], "v", [0, 0.25, 0.5, 0.95, 1]).collect()}
    for k, part in pdf.groupby("k"):
        assert got[k].n == len(part)
        assert got[k].q == pytest.approx(list(np.quantile(part.v, [0, 0.25, 0.5, 0.95, 1])))


def test_ranks_with_ties(hot):
    pdf, df = hot
    want = pdf.groupby("k").v.rank(method="average", ascending=False)
    got = ranks.avg_rank(df, ["k"], "v").toPandas().set_index("id")["rank"].sort_index()
    assert np.allclose(got, want)
    top = ranks.top_n_by(df, ["k"], "v", 5).toPandas()
    low = pdf.groupby("k").v.rank(method="min", ascending=False)
    assert set(top.id) == set(pdf.id[low <= 5])
    number = ranks.with_row_number(df, [F.col("v"), F.col("id")], ["k"]).toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("k").cumcount() + 1
    assert (number.set_index("id")["row"].sort_index() == want.sort_index()).all()


def test_results_do_not_depend_on_partitions(hot):
    _, df = hot
    one, many = df.coalesce(1), df.repartition(8)
    a = groups.box_stats(one, ["k"], "v").orderBy("k").collect()
    assert a == groups.box_stats(many, ["k"], "v").orderBy("k").collect()
    assert {r.id for r in ranks.sample_n(one, 50, "id").collect()} == {r.id for r in ranks.sample_n(many, 50, "id").collect()}


def test_sample_is_the_smallest_hashes(hot):
    _, df = hot
    u = F.xxhash64(F.col("id"), F.lit(123)).cast("double") / F.lit(2.0**64) + 0.5
    want = {r.id for r in df.orderBy(u, "id").limit(100).collect()}
    assert {r.id for r in ranks.sample_n(df, 100, "id").collect()} == want
    assert ranks.sample_n(df, 10**6, "id").count() == df.count()
    share = ranks.train_test(df, "id").agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.15 < share < 0.25


def test_dedupe_last(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 1, "a"), (1, "2020-02-01", 2, "b"), (1, "2020-02-01", 3, "c"), (2, "2020-01-01", 4, None)], "id int, d string, o int, x string")
    assert sorted(tuple(r) for r in ranks.dedupe_last(df, ["id"], ["d", "o"]).collect()) == [(1, "2020-02-01", 3, "c"), (2, "2020-01-01", 4, None)]


def test_cut_counts_keeps_empty_bins(spark):
    df = spark.createDataFrame([(v, 1) for v in (0.0, 25.0, 25.01, 200.0, 200.01)], "v double, f int")
    got = {r.lo: (r.n, r.rate) for r in groups.cut_counts(df, "v", [0, 25, 50, 100, 200], "f").collect()}
    assert got == {0.0: (1, 100.0), 25.0: (1, 100.0), 50.0: (0, None), 100.0: (1, 100.0)}


def test_density_integrates_to_one(hot):
    _, df = hot
    curve = groups.density_curve(df, "v", ["k"], points=256).toPandas()
    for _, part in curve.groupby("k"):
        part = part.sort_values("x")
        assert np.trapezoid(part.density, part.x) == pytest.approx(1, abs=0.12)


def test_density_matches_direct_sum(spark):
    x = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    curve = groups.density_curve(df, "v", points=50).toPandas().sort_values("x")
    iqr = np.subtract(*np.quantile(x, [0.75, 0.25]))
    h = 0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2
    want = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for g in curve.x]
    assert np.allclose(curve.density, want, rtol=1e-9, atol=1e-12)


def test_density_of_far_values_single_values_and_nothing(spark):
    x = np.concatenate([np.random.default_rng(3).normal(size=300), [1e6]])
    rows = [("a", float(v)) for v in x] + [("b", 5.0), ("b", None), ("b", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    curve = groups.density_curve(df, "v", ["k"], points=40).toPandas().sort_values(["k", "x"])
    assert curve.groupby("k").size().to_dict() == {"a": 40, "b": 40}
    iqr = np.subtract(*np.quantile(x, [0.75, 0.25]))
    h = 0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2
    part = curve[curve.k == "a"]
    want = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for g in part.x]
    assert np.allclose(part.density, want, rtol=1e-8, atol=1e-12)
    assert groups.density_curve(df.where("v > 1e9 and not isnan(v)"), "v", ["k"]).count() == 0
    one = groups.density_curve(df.where("k = 'b'"), "v", points=1).collect()
    assert [(r.x, round(r.density, 6)) for r in one] == [(5.0, round(1 / (0.9 * np.sqrt(2 * np.pi)), 6))]


def test_adjacent_pairs_and_pivots(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "c")], "d int, p int, t string")
    assert sorted(tuple(r) for r in reshape.adjacent_pairs(df, "d", "p", "t").collect()) == [(1, "a", "b"), (1, "b", "a")]
    wide = reshape.indicator_pivot(df.unionByName(df), ["d"], "t", ["a", "b", "c"]).orderBy("d").collect()
    assert [tuple(r) for r in wide] == [(1, 1, 1, 0), (2, 0, 0, 1)]
    assert reshape.spread(df.groupBy("d", "t").count(), ["d"], "t", "count", ["a", "c"], 0).orderBy("d").collect()[0].a == 2
    assert reshape.semi_join(df, df.where("t = 'c'"), "t").count() == 1
    assert {r.item: r.n for r in reshape.support(df.unionByName(df).withColumnRenamed("t", "item"), ["d"]).collect()} == {"a": 1, "b": 1, "c": 1}


def brute_recode(words, phrases, n=2):
    out, i = [], 0
    while i < len(words):
        gram = " ".join(words[i : i + n])
        if len(words) - i >= n and gram in phrases:
            out += [gram] + [None] * (n - 1)
            i += n
        else:
            out.append(words[i])
            i += 1
    return out


def test_recode_ngrams_against_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(i, list(rng.choice(list("abc"), rng.integers(0, 30)))) for i in range(60)]
    phrases = ["a b", "b a", "a a"]
    df = spark.createDataFrame(docs, "id int, t array<string>")
    got = {r.id: r.t for r in terms.recode_ngrams(df, ["id"], "t", spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    assert got == {i: brute_recode([str(w) for w in ws], phrases) for i, ws in docs}


def test_term_stream(spark):
    docs = spark.createDataFrame([(i, "Easy check in with a Big room . Check-out at noon; check - in late") for i in range(3)], "id int, text string")
    lex = spark.createDataFrame(
        [("easy", "easy", "ADJ"), ("check", "check", "VERB"), ("in", "in", "ADP"), ("big", "big", "ADJ"), ("room", "room", "NOUN"), ("out", "out", "ADP"), ("noon", "noon", "NOUN"), ("late", "late", "ADV"), ("with", "with", "ADP")],
        "token string, lemma string, upos string",
    )
    stop = spark.createDataFrame([("in",), ("out",), ("with",), ("room",)], "word string")
    annotated = terms.annotate(docs, "id", "text", lex)
    rare = terms.prepare_terms(annotated, "id", stop, min_bigram=5)
    assert rare.first().terms == ["easy", "check-in", "big", "check", "noon", "check-in", "late"]
    # pairs that are frequent among the content words are joined where they touch in the text
    joined = terms.prepare_terms(annotated, "id", stop, min_bigram=2)
    assert joined.first().terms == ["easy check", "big room", "check", "noon", "check-in", "late"]
    for least, want in ((5, rare), (2, joined)):
        assert [tuple(r) for r in terms.term_stream(docs, "id", "text", lex, stop, least).orderBy("id").collect()] == [tuple(r) for r in want.orderBy("id").collect()]
    edges, vertices = terms.bigram_network(joined)
    assert {(r.src, r.dst, r.n) for r in edges.collect()} >= {("easy check", "big room", 3), ("check-in", "late", 3)}
    assert {r.word: r.n for r in vertices.collect()}["check-in"] == 6


@pytest.mark.parametrize("by", [[], ["section"]])
def test_term_stream_in_rows_equals_joins(spark, monkeypatch, by):
    from staylens.operators.tagger import train_tagger

    rng = np.random.default_rng(5)
    vocabulary = ["check", "in", "out", "-", "Room", "rooms", "beds", "View", "views", "sea", ",", "1", "checkin"]
    docs = [(i, "st"[i % 2], " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(80)] + [(80, "s", None), (81, "t", "")]
    df = spark.createDataFrame(docs, "id int, section string, text string")
    lex = spark.createDataFrame(
        [("check", "check", "VERB"), ("in", "in", "ADP"), ("out", "out", "ADP"), ("room", "room", "NOUN"), ("rooms", "room", "NOUN"), ("view", None, "NOUN"),
         ("views", "view", "NOUN"), ("views", "vue", "X"), ("sea", "sea", "PROPN"), ("beds", "bed", None), ("checkin", "checkin", "NOUN")],
        "token string, lemma string, upos string",
    )
    stop = spark.createDataFrame([("in",), ("ROOM",), (None,)], "word string")

    def rows(out):
        return sorted(tuple(r) for r in out.select("id", *by, "terms").collect())

    inside = rows(terms.term_stream(df, "id", "text", lex, stop, 12, by))
    assert any(" " in t for r in inside for t in r[-1])
    assert inside == rows(terms.prepare_terms(terms.annotate(df, "id", "text", lex, by), "id", stop, 12, by))
    # words without a class in the lexicon get one from a tagger, on both ways alike
    kind = "tokens array<struct<token: string, upos: string>>"
    model = train_tagger(spark.createDataFrame([([("big", "ADJ"), ("beds", "NOUN"), ("1", "NUM"), ("in", "ADP"), (",", "PUNCT"), (".", "PUNCT")],)] * 3, kind))
    tagged = rows(terms.term_stream(df, "id", "text", lex, stop, 12, by, model))
    assert tagged != inside and any("beds" in t or "bed" in t for r in tagged for t in r[-1])
    assert tagged == rows(terms.prepare_terms(terms.annotate(df, "id", "text", lex, by, model), "id", stop, 12, by))
    monkeypatch.setattr(terms.ph, "shipped", lambda *a: None)
    assert inside == rows(terms.term_stream(df, "id", "text", lex, stop, 12, by))


@pytest.mark.parametrize("by", [[], ["section"]])
@pytest.mark.parametrize("most", [0, 3])
def test_term_stream_with_rare_words_joined(spark, monkeypatch, by, most):
    """A word table beyond the bound: frequent words in the tasks, the others by a join, never all tokens."""
    rng = np.random.default_rng(6)
    vocabulary = ["check", "in", "out", "-", "Room", "rooms", "View", "view", "sea", ",", "1"]
    docs = [(i % 50, "st"[i % 2], " ".join([*rng.choice(vocabulary, rng.integers(0, 40)), *["Odd", "odder", "Plain"][i % 4 :]])) for i in range(60)]
    df = spark.createDataFrame([*docs, (80, "s", None), (81, "t", "")], "id int, section string, text string")
    entries = [("check", "check", "VERB"), ("room", "room", "NOUN"), ("rooms", "room", "NOUN"), ("view", None, "NOUN"), ("sea", "sea", "PROPN"), ("odd", "odds", "ADJ"), ("odder", None, "ADJ"), ("plain", "plain", None)]
    lex = spark.createDataFrame([*entries, ("never", "met", "NOUN")], "token string, lemma string, upos string")
    stop = spark.createDataFrame([("in",), ("ROOM",), ("plain",)], "word string")

    def rows():
        return sorted(tuple(r) for r in terms.term_stream(df, "id", "text", lex, stop, 8, by).select("id", *by, "terms").collect())

    want = rows()
    shipped = terms.ph.shipped
    monkeypatch.setattr(terms.ph, "SHIPPED_ROWS", most)
    monkeypatch.setattr(terms.ph, "shipped", lambda t, n=None: shipped(t, most if n is None else n))
    monkeypatch.setattr(terms, "annotate", None)
    assert rows() == want and any("odds" in t for r in want for t in r[-1])


def test_phrase_automaton_takes_longest_from_the_left(spark):
    from staylens.operators.phrases import PhraseAutomaton, cuts, leftmost

    a = PhraseAutomaton([("s", ("a", "b")), ("s", ("a", "b", "c")), ("t", ("b", "a")), ("s", ("c", "a"))])
    tokens = ["a", "b", "c", "a", "b", "x", "a", "b", "a"]
    row_end = np.array([5, 5, 5, 5, 5, 9, 9, 9, 9])
    length = a.walk(a.codes(tokens), row_end, a.start(["s"] * 9))
    assert length.tolist() == [3, 0, 2, 2, 0, 0, 2, 0, 0]
    assert [x.tolist() for x in leftmost(length)] == [[0, 3, 6], [False, True, True, False, True, False, False, True, False]]
    assert a.walk(a.codes(tokens), row_end, a.start(["t"] * 9)).tolist() == [0, 0, 0, 0, 0, 0, 0, 2, 0]
    assert not a.walk(a.codes(tokens), row_end, a.start(["none"] * 9)).any()
    assert set(cuts("a b c", 2)) == {("a", "b c"), ("a b", "c")}


def test_word_table_tells_equal_hashes_apart(monkeypatch):
    import pyarrow as pa

    from staylens.operators.phrases import TextIndex, WordTable

    monkeypatch.setattr(TextIndex, "_hash", staticmethod(lambda tokens: np.array([len(t) for t in tokens], np.uint64)))
    rows = {"low": ["aa", "bb", "c", "dd"], "lemma": ["x", None, "z", "w"], "content": [True, True, False, None], "stop": [False, False, True, True]}
    low, lemma, content, stop, classed = WordTable(pa.table(rows)).of(["AA", "bb", "C", "dd", "ee", None])
    assert low == ["aa", "bb", "c", "dd", "ee", None] and lemma == ["x", "bb", "z", "w", "ee", None]
    assert classed.tolist() == [True, True, True, False, False, False]
    assert content.tolist() == [True, True, False, False, False, False] and stop.tolist() == [False, False, True, True, False, False]


def test_recode_ngrams_by_section_and_odd_tokens(spark, monkeypatch):
    df = spark.createDataFrame(
        [(1, "s", ["a", "b", "a b", "c"]), (2, "t", ["a", "b"]), (3, "s", None), (4, "s", []), (5, "s", ["a", None, "b"])], "id int, section string, t array<string>"
    )
    phrases = spark.createDataFrame([("s", "a b"), ("s", "a b c"), ("t", "b a"), ("t", None)], "section string, phrase string")
    want = {1: ["a b", None, "a b c", None], 2: ["a", "b"], 3: [], 4: [], 5: ["a", None, "b"]}
    assert {r.id: r.t for r in terms.recode_ngrams(df, ["id"], "t", phrases, 2, ["section"]).collect()} == want
    monkeypatch.setattr(terms.ph, "shipped", lambda *a: None)
    assert {r.id: r.t for r in terms.recode_ngrams(df, ["id"], "t", phrases, 2, ["section"]).collect()} == want


def test_sentiment_in_rows_equals_joins(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i % 50, " ".join(rng.choice(["good", "bad", "Awful", "odd", "big", "x"], rng.integers(0, 9)))) for i in range(80)] + [(60, None), (61, "")]
    reviews = spark.createDataFrame(rows, "id int, text string")
    unique = reviews.groupBy("id").agg(F.min("text").alias("text"))
    bing = spark.createDataFrame([("good", "positive"), ("good", "negative"), ("bad", "negative"), ("odd", None), (None, "positive")], "word string, sentiment string")
    afinn = spark.createDataFrame([("good", 3), ("awful", -3), ("odd", None), ("big", 0)], "word string, value int")

    def scores():
        both = sorted(map(str, sentiment.add_sentiment(unique, "id", "text", bing, afinn).drop("text").collect()))
        single = [sorted(tuple(r) for r in f(reviews, "id", "text", t).collect()) for f, t in ((sentiment.bing_sentiment, bing), (sentiment.afinn_sentiment, afinn))]
        return both, single, sentiment.afinn_sentiment(reviews, "id", "text", afinn.limit(0)).count()

    inside = scores()
    assert any(r[1] == 0 for r in inside[1][1]) and any(r[1] for r in inside[1][0])
    monkeypatch.setattr(sentiment, "shipped", lambda *a: None)
    assert inside == scores()


def test_slices_of_batches(spark, monkeypatch):
    """Batches are worked through in runs of rows with few tokens; no row is lost or cut, and sums are as before."""
    lists = [["a"] * n if n is not None else None for n in (2, 0, None, 9, 1, 1, 1, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], names=["id", "t"])
    monkeypatch.setattr(phrases, "SLICE_TOKENS", 4)
    parts = list(phrases.slices([batch, batch.slice(0, 0), batch.slice(3, 2)], 1))
    assert [len(p) for p in parts] == [3, 1, 3, 1, 0, 1, 1]
    assert [r for p in parts[:4] for r in p.to_pylist()] == batch.to_pylist() and parts[5].to_pylist() + parts[6].to_pylist() == batch.slice(3, 2).to_pylist()
    table = phrases.WeightTable(pa.table({"word": ["a"], "w": [2]}), ["w"])
    shared = type("Shared", (), {"value": table})
    got = [r for b in phrases.sum_batches(shared, 1, ["id", "w"])([batch]) for r in b.to_pylist()]
    assert got == [{"id": i, "w": 2 * len(t) if t else None} for i, t in enumerate(lists)]


def test_texts_stay_out_of_python(spark):
    df = spark.createDataFrame([(1, "good bad")], "id int, text string")
    weights = spark.createDataFrame([("good", 3)], "word string, afinn long")
    assert sentiment._in_rows(df, "id", "text", weights, {"afinn": "s"}).columns == ["id", "s"]


def test_sentiment_and_language(spark):
    reviews = spark.createDataFrame([(1, "Good good bad"), (2, "awful awful"), (3, "nothing here"), (4, None)], "id int, text string")
    bing = spark.createDataFrame([("good", "positive"), ("bad", "negative"), ("awful", "negative")], "word string, sentiment string")
    afinn = spark.createDataFrame([("good", 3), ("awful", -3)], "word string, value int")
    got = {r.id: (r.bing_sentiment, r.afinn_sentiment) for r in sentiment.add_sentiment(reviews, "id", "text", bing, afinn).collect()}
    assert got == {1: (1, 6), 2: (-2, -6), 3: (None, None), 4: (None, None)}
    train = spark.createDataFrame([("en", "the house with the view of the sea and the town"), ("fr", "la maison avec la vue de la mer et de la ville")], "lang string, text string")
    profiles = language.language_profiles(train, "text", "lang")
    docs = spark.createDataFrame([(1, "the town and the house"), (2, "la ville et la maison"), (3, "12345"), (4, None)], "id int, text string")
    found = language.detect_language(docs, "id", "text", profiles)
    assert {r.id: r.language for r in found.collect()} == {1: "en", 2: "fr", 3: None, 4: None}
    assert {r.id for r in language.filter_language(found).collect()} == {1, 3, 4}


def test_trigrams_are_weighed_in_their_row(spark, monkeypatch):
    texts = [("en", "The house, with 2 views"), ("fr", "l'été à la mer"), ("xx", "\U00010400\U00010401\U00010402 a"), ("en", ""), ("fr", None), (None, "lost"), ("en", "a" * 3000)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, lang string, text string")
    monkeypatch.setattr(language, "RUN_POINTS", 20)
    profiles = language.language_profiles(docs, "text", "lang").persist()
    counts, padded = {}, [(lang, t and " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " ") for lang, t in texts]
    for lang, t in padded:
        for i in range(len(t or "") - 2 if lang else 0):
            counts.setdefault(lang, collections.Counter())[t[i : i + 3]] += 1
    want = {(g, x): math.log(n * 1e6 / c.total()) for g, c in counts.items() for x, n in c.items()}
    assert {(r.lang, r.gram): r.weight for r in profiles.collect()} == pytest.approx(want)
    found = language.detect_language(docs, "id", "text", profiles)
    assert "Exchange" not in found._jdf.queryExecution().sparkPlan().toString() and "Generate" not in found._jdf.queryExecution().sparkPlan().toString()
    got = {r.id: (r.language, r.score) for r in found.collect()}
    for i, (_, t) in enumerate(padded):
        grams = [t[j : j + 3] for j in range(len(t or "") - 2)]
        sums = {g: sum(want.get((g, x), 0.0) for x in grams) for g in counts if any((h, x) in want for h in counts for x in grams)}
        assert got[i] == ((None, None) if not sums else (max(sums, key=sums.get), pytest.approx(max(sums.values()), abs=1e-6)))
    monkeypatch.setattr(language._scores, "__defaults__", (1,))
    plain = docs.where("lang is null or lang != 'xx'")
    joined = {r.id: (r.language, r.score) for r in language.detect_language(plain, "id", "text", profiles).collect()}
    assert {i: (g, pytest.approx(x, abs=2e-6) if x else x) for i, (g, x) in joined.items()} == {i: got[i] for i in joined}


def test_negative_split(spark):
    reviews = spark.createDataFrame([(1, 10, -3), (2, 10, 5), (3, 11, -4), (4, 12, None)], "id int, listing_id int, afinn_sentiment int")
    listings = spark.createDataFrame([(10, 90.0), (11, 80.0), (12, 100.0)], "id int, review_scores_rating double")
    got = {r.listing_id: r.has_negative_review for r in sentiment.negative_review_split(reviews, listings).collect()}
    assert got == {10: "No Negative Reviews", 11: "Has Negative Review(s)", 12: "No Negative Reviews"}
    by = {r.review_scores_rating: (r.avg_sentiment, r["count"]) for r in sentiment.sentiment_by_rating(reviews, listings).collect()}
    assert by == {4.5: (1.0, 1), 4.0: (-4.0, 1), 5.0: (0.0, 1)}


@pytest.mark.parametrize("kind", ["perfect", "reversed", "random", "tied"])
def test_auc_is_mann_whitney(spark, kind):
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.4).astype(int)
    s = {"perfect": y + 0.0, "reversed": -y + 0.0, "random": np.round(rng.random(300), 2), "tied": np.zeros(300)}[kind]
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    diff = s[y == 1][:, None] - s[y == 0][None, :]
    assert evaluate.auc(df).first()[0] == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())


def test_one_class_scores(spark):
    df = spark.createDataFrame([(0.5, 1, 1), (0.7, 1, 1)], "score double, label int, prediction int")
    assert evaluate.auc(df).first()[0] is None
    assert [tuple(r) for r in evaluate.confusion_matrix(df, [0, 1]).orderBy("label").collect()] == [(0, 0, 0), (1, 0, 2)]
    rep = {r["class"]: r for r in evaluate.classification_report(df, [0, 1]).collect()}
    assert rep["1"].f1 == 1.0 and rep["0"].f1 == 0.0 and rep["accuracy"].precision == 1.0
