"""Sections, tokens, bigrams, term streams, sentiment and language on the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.catalog.base import rounded, table
from staylens.functions import clean
from staylens.functions import text as tx
from staylens.operators import groups, language, ranks, sentiment, tagger, terms
from staylens.runtime import materialize, spread
from staylens.sources import links

MARKERS = ("the", "re", "on", "la")
MAIN = list(tx.SECTIONS)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", "text")
    return tx.description_sections(docs, "text", MARKERS)


def sections_split(spark: SparkSession, d: str) -> DataFrame:
    out = _sections(spark, d)
    return out.select("doc_id", *[F.md5(s).alias(s) for s in MAIN], *[f"has_{s}" for s in MAIN[:4]])


def section_lengths(spark: SparkSession, d: str) -> DataFrame:
    out = _sections(spark, d).select("doc_id", *[F.length(s).alias(s) for s in MAIN[:4]])
    long = out.unpivot(["doc_id"], MAIN[:4], "section", "length")
    stats = groups.mean_by(long, ["section"], ["length"])
    done = long.groupBy("section").agg((F.count("length") / F.count(F.lit(1))).alias("completion"))
    both = materialize(stats.join(done, "section"))
    return rounded(ranks.order_rank(both, "avg_length"), 4)


def _stop_words(tokens: DataFrame, n: int = 20) -> DataFrame:
    return ranks.top_k(terms.term_counts(tokens), "n", n, ["word"]).select("word")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return terms.tokenize(_documents(spark, d), "doc_id", "text")


def tokens_and_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = _tokens(spark, d)
    kept = terms.drop_stop_words(tokens, materialize(_stop_words(tokens)))
    return terms.term_counts(kept.where(~F.col("word").rlike(r"\d")))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", tx.words("text").alias("terms"))


def bigram_edges(spark: SparkSession, d: str) -> DataFrame:
    return terms.bigram_edges(terms.pair_counts(_words(spark, d), "terms"), 150)


def bigram_vertices(spark: SparkSession, d: str) -> DataFrame:
    return terms.bigram_network(_words(spark, d))[1]


def bigram_edges_by_language(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("lang", "doc_id", tx.words("text").alias("terms"))
    return terms.bigram_network(docs, ["lang"], 50)[0]


def _digest(terms_col: str) -> list:
    return [
        F.size(terms_col).cast("long").alias("n_terms"),
        F.size(F.filter(terms_col, lambda x: x.contains(" "))).cast("long").alias("n_joined"),
        F.md5(F.array_join(terms_col, "|")).alias("digest"),
    ]


def ngram_recode(spark: SparkSession, d: str) -> DataFrame:
    docs = _words(spark, d)
    phrases = ranks.top_k(terms.pair_counts(docs, "terms"), "n", 5, ["src", "dst"]).select(
        F.concat_ws(" ", "src", "dst").alias("phrase")
    )
    joined = terms.recode_ngrams(docs, ["doc_id"], "terms", materialize(phrases))
    joined = joined.withColumn("terms", F.filter("terms", lambda x: x.isNotNull()))
    return joined.select("doc_id", *_digest("terms"))


def _lexicon(words: DataFrame) -> DataFrame:
    """Word classes by length and lemmas without a final s, for every word of the documents."""
    word_class = F.element_at(F.array(*[F.lit(x) for x in ("NOUN", "VERB", "ADJ", "PROPN")]), F.length("word") % 4 + 1)
    return words.select(F.col("word").alias("token"), F.regexp_replace("word", "s$", "").alias("lemma"), word_class.alias("upos"))


def term_stream(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(terms.term_counts(_tokens(spark, d)))
    stop_words = ranks.top_k(counts, "n", 20, ["word"]).select("word")
    return terms.term_stream(_documents(spark, d), "doc_id", "text", _lexicon(counts), stop_words, min_bigram=50).select("doc_id", *_digest("terms"))


def word_tagger(spark: SparkSession, d: str) -> DataFrame:
    """Words whose class follows from their last letter: the tagger learns four fifths of the documents and tags the rest."""
    names = F.array(*[F.lit(x) for x in ("NOUN", "VERB", "ADJ", "PROPN")])

    def annotated(token):
        word_class = F.element_at(names, F.ascii(F.right(F.lower(token), F.lit(1))) % 4 + 1)
        return F.struct(token.alias("token"), F.when(token.rlike(r"^[\p{L}\p{N}']"), word_class).otherwise("PUNCT").alias("upos"))

    found = F.regexp_extract_all("text", F.lit(terms.TOKEN_PATTERN), F.lit(0))
    rows = materialize(_documents(spark, d).select("doc_id", F.transform(found, annotated).alias("tokens")))
    model = tagger.train_tagger(rows.where(F.col("doc_id") % 5 != 0))
    held = rows.where(F.col("doc_id") % 5 == 0).select("doc_id", F.col("tokens.upos").alias("truth"), F.col("tokens.token").alias("t"))
    found = tagger.accuracy_by_class(tagger.tag(held, model, "t", ["truth"]), "truth")
    return found.select("upos", "n", (F.col("right") >= 0.95 * F.col("n")).alias("nearly_all_right"))


def _bing(tokens: DataFrame) -> DataFrame:
    side = F.when(F.col("word").endswith("on"), "positive").when(F.col("word").endswith("re"), "negative")
    return tokens.select("word").distinct().select("word", side.alias("sentiment")).where(F.col("sentiment").isNotNull())


def _afinn(tokens: DataFrame) -> DataFrame:
    value = (F.length("word") % 7 - 3).cast("int")
    return tokens.select("word").distinct().where(F.col("word").rlike("^[aet]")).select("word", value.alias("value"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs, tokens = _documents(spark, d), _tokens(spark, d)
    return sentiment.add_sentiment(
        docs.select("doc_id", "text"), "doc_id", "text", materialize(_bing(tokens)), materialize(_afinn(tokens))
    ).drop("text")


def bing_score(spark: SparkSession, d: str) -> DataFrame:
    tokens = _tokens(spark, d)
    return sentiment.bing_sentiment(_documents(spark, d), "doc_id", "text", materialize(_bing(tokens)))


def afinn_score(spark: SparkSession, d: str) -> DataFrame:
    tokens = _tokens(spark, d)
    return sentiment.afinn_sentiment(_documents(spark, d), "doc_id", "text", materialize(_afinn(tokens)))


def review_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as reviews of labelled listings: listing n has the reviews whose id is n modulo 97."""
    reviews = _scored(spark, d).withColumn("listing_id", F.col("doc_id") % 97)
    labels = table(spark, d, "labels")
    listings = labels.groupBy((F.col("doc_id") % 97).alias("id")).agg(
        (70 + 30 * F.round(F.avg("quality"), 1)).alias("review_scores_rating")
    )
    return reviews, listings


def sentiment_by_level(spark: SparkSession, d: str) -> DataFrame:
    reviews, listings = _reviews(spark, d)
    return rounded(sentiment.sentiment_by_rating(reviews, materialize(listings)), 4)


def negative_split(spark: SparkSession, d: str) -> DataFrame:
    reviews, listings = _reviews(spark, d)
    split = sentiment.negative_review_split(reviews, listings)
    return rounded(
        split.groupBy("has_negative_review").agg(
            F.count(F.lit(1)).alias("n"), F.avg("review_scores_rating").alias("avg_rating"), F.sum("listing_id").alias("ids")
        ),
        4,
    )


def negative_split_density(spark: SparkSession, d: str) -> DataFrame:
    reviews, listings = _reviews(spark, d)
    split = sentiment.negative_review_split(reviews, materialize(listings))
    return rounded(sentiment.rating_distributions(materialize(split), points=64), 4)


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", "lang", "text")
    found = language.detect_language(docs, "doc_id", "text", materialize(language.language_profiles(docs, "text", "lang")))
    return found.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "language", F.round("score", 2).alias("score"))


def language_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = language.filter_language(language_detect(spark, d))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("language").alias("known"))


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    found = links.extract_links(pages, include=["/"], exclude=["#", "mailto"])
    return found.select(
        "page_id", "link", F.substring("link", 1, 7).alias("head"), clean.digits_only("link").alias("digits"),
        clean.file_city("link").alias("name"),
    )


def link_forms(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages whose anchors are written in four other ways by page, after links that a comment and a script only name."""
    pages = table(spark, d, "pages").select("page_id", "html")
    forms = [
        "<A  CLASS=x HREF = '$1&amp;p=1'",
        "<a title=\"1 > 0\" href=$1&#38;p=1",
        "<a\nhref='$1&#x26;p=1' href=\"/second\"",
        "<a data-href=\"/no\" title='href=\"/no\"' href=\"$1&p=1\"",
    ]
    written = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        other = F.regexp_replace("html", r'<a href="([^"]*)"', form)
        written = F.when(F.col("page_id") % 4 == i, other).otherwise(written)
    html = F.concat(F.lit('<!-- <a href="/hidden"> --><script>var x = "<a href=/hidden>";</script>'), written)
    return links.extract_links(pages.withColumn("html", html))


QUERIES = {
    f.__name__: f
    for f in (
        sections_split, section_lengths, tokens_and_counts, bigram_edges, bigram_vertices, bigram_edges_by_language,
        ngram_recode, term_stream, word_tagger, bing_score, afinn_score, review_scores, sentiment_by_level, negative_split,
        negative_split_density, language_detect, language_kept, link_extract, link_forms,
    )
}


# --- SQL ------------------------------------------------------------------------------------


def _sections_sql(markers=MARKERS, source: str = "SELECT doc_id, text AS D FROM documents") -> str:
    space, access, notes, lic = markers
    steps = [
        ("D", space, "S"), ("S", access, "g1"), ("g1", notes, "o1"), ("o1", lic, "l1"), ("D", access, "g2"),
        ("g2", notes, "o2"), ("o2", lic, "l2"), ("S", notes, "o3"), ("o3", lic, "l3"), ("D", notes, "o4"),
        ("o4", lic, "l4"), ("D", lic, "l5"), ("S", lic, "l6"), ("g1", lic, "l7"), ("g2", lic, "l8"),
    ]
    ctes = [f"s0 AS ({source})"]
    for i, (left, marker, right) in enumerate(steps):
        ctes.append(
            f"s{i + 1} AS (SELECT * REPLACE (string_split({left}, '{marker}')[1] AS {left}), string_split({left}, '{marker}')[2] AS {right} FROM s{i})"
        )
    ctes.append(
        f"""sec AS (SELECT doc_id, nullif(D, '') AS Description, nullif(S, '') AS Space, nullif(concat_ws('_', g1, g2), '') AS Guest_access,
        nullif(concat_ws('_', o1, o2, o3, o4), '') AS Other_things_to_note,
        nullif(concat_ws('_', l1, l2, l3, l4, l5, l6, l7, l8), '') AS License FROM s{len(steps)})"""
    )
    return "WITH " + ",\n".join(ctes)


_TOK = r"""tok AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}'']+') AS w FROM documents))"""
_STOP = "stop AS (SELECT word FROM tok GROUP BY word ORDER BY count(*) DESC, word LIMIT 20)"
_PAIR = "pair AS (SELECT doc_id, pos, word AS src, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS dst FROM tok)"
_EDGE = """edge AS (SELECT src, dst, count(*) AS n FROM pair WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2
  ORDER BY n DESC, src, dst LIMIT 150)"""
_BING = """bing AS (SELECT DISTINCT word, CASE WHEN word LIKE '%on' THEN 1 ELSE -1 END AS v FROM tok WHERE word LIKE '%on' OR word LIKE '%re')"""
_AFINN = """afinn AS (SELECT DISTINCT word, length(word) % 7 - 3 AS v FROM tok WHERE regexp_matches(word, '^[aet]'))"""
_SCORE = """bs AS (SELECT doc_id, sum(v)::BIGINT AS bing_sentiment FROM tok JOIN bing USING (word) GROUP BY 1),
afs AS (SELECT doc_id, sum(v)::BIGINT AS afinn_sentiment FROM tok JOIN afinn USING (word) GROUP BY 1),
sc AS (SELECT doc_id, bing_sentiment, afinn_sentiment FROM documents LEFT JOIN bs USING (doc_id) LEFT JOIN afs USING (doc_id)),
ls AS (SELECT doc_id % 97 AS id, 70 + 30 * round(avg(quality), 1) AS r FROM labels GROUP BY 1)"""
_GRAM = r"""ch AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS s FROM documents),
gr AS (SELECT doc_id, lang, c[i] || c[i + 1] || c[i + 2] AS gram FROM
  (SELECT doc_id, lang, c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT doc_id, lang, string_split(s, '') AS c FROM ch))),
cn AS (SELECT lang, gram, count(*) AS n FROM gr GROUP BY 1, 2),
tt AS (SELECT lang, sum(n) AS total FROM cn GROUP BY 1),
pr AS (SELECT lang AS pl, gram, ln(n * 1e6 / total) AS weight FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS k FROM cn) JOIN tt USING (lang)),
sm AS (SELECT doc_id, pl, round(sum(weight), 6) AS score FROM gr JOIN pr USING (gram) GROUP BY 1, 2),
lg AS (SELECT d.doc_id, d.lang, b.language, round(b.score, 2) AS score FROM documents d LEFT JOIN
  (SELECT doc_id, pl AS language, score FROM sm QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pl DESC) = 1) b USING (doc_id))"""


def _recode_ctes(source: str, phrases: str) -> str:
    """Greedy left-to-right joining of two-word phrases: in a run of matches every other one is taken."""
    return f"""
m AS (SELECT s.doc_id, s.pos, s.word, s.dst, p.phrase IS NOT NULL AS hit FROM
  (SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS dst FROM {source}) s
  LEFT JOIN {phrases} p ON p.phrase = s.word || ' ' || s.dst),
r AS (SELECT *, max(CASE WHEN NOT hit THEN pos ELSE NULL END) OVER (PARTITION BY doc_id ORDER BY pos) AS brk,
      min(pos) OVER (PARTITION BY doc_id) AS p0 FROM m),
taken AS (SELECT *, hit AND (pos - coalesce(brk + 1, p0)) % 2 = 0 AS start FROM r),
rec AS (SELECT doc_id, pos, CASE WHEN start THEN word || ' ' || dst
  WHEN lag(start, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) THEN NULL ELSE word END AS term FROM taken)"""


SQL = {
    "sections_split": _sections_sql() + """
SELECT doc_id, md5(Description) AS Description, md5(Space) AS Space, md5(Guest_access) AS Guest_access, md5(Other_things_to_note) AS Other_things_to_note,
  md5(License) AS License, (Description IS NOT NULL)::INT AS "has_Description", (Space IS NOT NULL)::INT AS "has_Space",
  (Guest_access IS NOT NULL)::INT AS "has_Guest_access", (Other_things_to_note IS NOT NULL)::INT AS "has_Other_things_to_note" FROM sec""",
    "section_lengths": _sections_sql() + """
, long AS (SELECT doc_id, unnest(['Description', 'Space', 'Guest_access', 'Other_things_to_note']) AS section,
  unnest([length(Description), length(Space), length(Guest_access), length(Other_things_to_note)]) AS len FROM sec),
a AS (SELECT section, avg(len) AS avg_length, count(len) / count(*)::DOUBLE AS completion FROM long GROUP BY 1)
SELECT section, round(avg_length, 4) AS avg_length, round(completion, 4) AS completion, rank() OVER (ORDER BY avg_length DESC)::INTEGER AS place FROM a""",
    "tokens_and_counts": rf"WITH {_TOK}, {_STOP} SELECT word, count(*) AS n FROM tok WHERE word NOT IN (SELECT word FROM stop) AND NOT regexp_matches(word, '\d') GROUP BY 1",
    "bigram_edges": f"WITH {_TOK}, {_PAIR}, {_EDGE} SELECT * FROM edge",
    "bigram_vertices": f"WITH {_TOK}, {_PAIR}, {_EDGE} SELECT word, sum(n)::BIGINT AS n FROM (SELECT src AS word, n FROM edge UNION ALL SELECT dst, n FROM edge) GROUP BY 1",
    "bigram_edges_by_language": f"""WITH {_TOK}, {_PAIR}, c AS (SELECT lang, src, dst, count(*) AS n FROM pair JOIN documents USING (doc_id)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2, 3)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, src, dst) <= 50""",
    "ngram_recode": f"""WITH {_TOK}, {_PAIR},
ph AS (SELECT src || ' ' || dst AS phrase FROM pair WHERE dst IS NOT NULL GROUP BY src, dst ORDER BY count(*) DESC, src, dst LIMIT 5),
{_recode_ctes('tok', 'ph')}
SELECT d.doc_id, count(term) AS n_terms, count(*) FILTER (term LIKE '% %') AS n_joined, md5(coalesce(string_agg(term, '|' ORDER BY pos), '')) AS digest
FROM documents d LEFT JOIN rec USING (doc_id) GROUP BY 1""",
    "term_stream": r"""WITH """ + _TOK + ", " + _STOP + r""",
raw AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS token FROM
  (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}'']+|[^\s\p{L}\p{N}'']') AS w FROM documents)),
lex AS (SELECT DISTINCT word AS token, regexp_replace(word, 's$', '') AS lemma, (['NOUN', 'VERB', 'ADJ', 'PROPN'])[length(word) % 4 + 1] AS upos FROM tok),
ann AS (SELECT r.doc_id, r.pos, r.token, coalesce(l.lemma, r.token) AS word, coalesce(l.upos, 'PUNCT') IN ('NOUN', 'VERB', 'ADJ') AS content,
  lower(r.token) IN (SELECT word FROM stop) AS stp FROM raw r LEFT JOIN lex l ON l.token = lower(r.token)),
nx AS (SELECT word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS dst FROM ann WHERE content AND (NOT stp OR lower(token) = 'room')),
ph AS (SELECT word || ' ' || dst AS phrase FROM nx WHERE dst IS NOT NULL GROUP BY 1 HAVING count(*) > 50 UNION SELECT 'check in' UNION SELECT 'check out'),
""" + _recode_ctes("ann", "ph") + r""",
kept AS (SELECT rec.doc_id, rec.pos, lower(term) AS term FROM rec JOIN ann USING (doc_id, pos) WHERE content AND NOT stp AND term IS NOT NULL)
SELECT d.doc_id, count(term) AS n_terms, count(*) FILTER (term LIKE '% %') AS n_joined, md5(coalesce(string_agg(term, '|' ORDER BY pos), '')) AS digest
FROM (SELECT DISTINCT doc_id FROM ann) d LEFT JOIN kept USING (doc_id) GROUP BY 1""",
    "word_tagger": r"""WITH raw AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}'']+|[^\s\p{L}\p{N}'']')) AS token FROM documents WHERE doc_id % 5 = 0)
SELECT CASE WHEN regexp_matches(token, '^[\p{L}\p{N}'']') THEN (['NOUN', 'VERB', 'ADJ', 'PROPN'])[unicode(right(lower(token), 1)) % 4 + 1] ELSE 'PUNCT' END AS upos,
  count(*) AS n, true AS nearly_all_right FROM raw GROUP BY 1""",
    "bing_score": f"WITH {_TOK}, {_BING} SELECT doc_id, sum(v)::BIGINT AS bing_sentiment FROM tok JOIN bing USING (word) GROUP BY 1",
    "afinn_score": f"WITH {_TOK}, {_AFINN} SELECT doc_id, sum(v)::BIGINT AS afinn_sentiment FROM tok JOIN afinn USING (word) GROUP BY 1",
    "review_scores": f"WITH {_TOK}, {_BING}, {_AFINN}, {_SCORE} SELECT doc_id, bing_sentiment, afinn_sentiment FROM sc",
    "sentiment_by_level": f"""WITH {_TOK}, {_BING}, {_AFINN}, {_SCORE},
pl AS (SELECT doc_id % 97 AS id, avg(coalesce(afinn_sentiment, 0)) AS a FROM sc GROUP BY 1)
SELECT round(r / 20, 4) AS review_scores_rating, round(avg(a), 4) AS avg_sentiment, count(*) AS "count" FROM pl JOIN ls USING (id) WHERE r / 20 >= 3.5 GROUP BY r""",
    "negative_split": f"""WITH {_TOK}, {_BING}, {_AFINN}, {_SCORE},
pl AS (SELECT doc_id % 97 AS id, count(*) FILTER (coalesce(afinn_sentiment, 0) < -3) AS neg FROM sc GROUP BY 1)
SELECT CASE WHEN neg > 0 THEN 'Has Negative Review(s)' ELSE 'No Negative Reviews' END AS has_negative_review, count(*) AS n,
  round(avg(r / 20), 4) AS avg_rating, sum(id)::BIGINT AS ids FROM pl JOIN ls USING (id) GROUP BY 1""",
    "language_detect": f"WITH {_GRAM} SELECT * FROM lg",
    "language_kept": f"WITH {_GRAM} SELECT lang, count(*) AS n, count(language) AS known FROM lg WHERE language = 'en' OR language IS NULL GROUP BY 1",
    "link_extract": r"""WITH t AS (SELECT page_id, string_split(unnest(string_split(html, '<a ')[2:]), '>')[1] AS tag FROM pages),
l AS (SELECT page_id, string_split(string_split(tag, 'href="')[2], '"')[1] AS link FROM t WHERE contains(tag, 'href="'))
SELECT page_id, link, substring(link, 1, 7) AS head, regexp_replace(link, '[^0-9]', '', 'g') AS digits,
  string_split(regexp_replace(regexp_extract(link, '([^/]*)$', 1), '%20', ' ', 'g'), ' ')[1] AS name
FROM l WHERE link LIKE '%/%' AND link NOT LIKE '%#%' AND link NOT LIKE '%mailto%'""",
    "link_forms": """SELECT page_id, string_split(unnest(string_split(html, '<a href="')[2:]), '"')[1] || '&p=1' AS link FROM pages""",
}
