"""Tokens, term streams and bigram networks.

One row holds one document, so the order of its tokens is handled inside the row. Only counts cross the
network, as long as word table and phrases are small enough for the tasks; beyond that tokens are joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions import text as tx
from staylens.operators import phrases as ph
from staylens.operators.phrases import FUNCTION_CLASSES
from staylens.operators.reshape import anti_join
from staylens.operators.tagger import Tagger, WideTagger, tag
from staylens.runtime import BROADCAST_ROWS, broadcast_if_small, materialize

# Word kept as content while bigrams are looked for, though it is a stop word.
BIGRAM_KEEPS = ["room"]
# Phrases that are always joined.
ALWAYS_JOINED = ["check in", "check out"]
ALWAYS_JOINED_DASHED = ["check - in", "check - out"]

TOKEN_PATTERN = r"[\p{L}\p{N}']+|[^\s\p{L}\p{N}']"


def tokenize(df: DataFrame, id_col: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per word: lower case, punctuation dropped, with its position in the text."""
    return df.select(id_col, *keep, F.posexplode(tx.words(text)).alias("pos", "word"))


def term_counts(tokens: DataFrame, keys: Sequence[str] = (), word: str = "word") -> DataFrame:
    return tokens.groupBy(*keys, word).agg(F.count(F.lit(1)).alias("n"))


def row_term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, word, n) for each text, counted inside its row; rows that share an id are not summed up."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ph.slices(batches, 1):
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            words = lists.flatten().dictionary_encode()
            wide = max(len(words.dictionary), 1)
            both, n = np.unique(row * wide + words.indices.to_numpy(), return_counts=True)
            row, word = np.divmod(both, wide)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words.dictionary.take(pa.array(word)), pa.array(n, pa.int64())], names=[id_col, "word", "n"])

    source = df.select(id_col, tx.words(text).alias("word"))
    return source.mapInArrow(over, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, word string, n long")


def drop_stop_words(tokens: DataFrame, stop_words: DataFrame, word: str = "word") -> DataFrame:
    return anti_join(tokens, stop_words, word)


def recode_ngrams(df: DataFrame, keys: Sequence[str], tokens: str, phrases: DataFrame, n: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Join known n-grams in a token array: the first token becomes the compound, the others null.

    ``phrases`` is a table (by..., phrase) of any size; ``keys`` name one row of ``df``. Overlaps are
    settled from left to right. Few phrases become an automaton that every row is walked with, without a shuffle.
    """
    by = list(by)
    listed = ph.shipped(phrases.select(*by, "phrase").where("phrase is not null").distinct(), BROADCAST_ROWS)
    if listed is not None:
        rows = zip(zip(*[listed.column(c).to_pylist() for c in by]) if by else [()] * listed.num_rows, listed.column("phrase").to_pylist())
        automaton = ph.PhraseAutomaton((section, parts) for section, phrase in rows for parts in ph.cuts(phrase, n))
        automaton = df.sparkSession.sparkContext.broadcast(automaton)
        source = df.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *keys, F.col(tokens).cast("array<string>").alias(tokens))
        return source.mapInArrow(ph.recode_batches(automaton, len(by), len(keys)), source.drop(*[f"__by{i}" for i in range(len(by))]).schema)
    grams = F.transform(
        tx.token_windows(tokens, n),
        lambda w: F.struct(
            w["x0"].alias("token"),
            F.when(w[f"x{n - 1}"].isNotNull(), F.concat_ws(" ", *[w[f"x{i}"] for i in range(n)])).alias("phrase"),
        ),
    )
    each = df.select(*keys, *[c for c in by if c not in keys], F.posexplode_outer(grams).alias("__pos", "__g"))
    known = phrases.select(*by, F.col("phrase").alias("__phrase")).distinct().withColumn("__hit", F.lit(True))
    each = each.withColumn("__phrase", F.col("__g.phrase")).join(broadcast_if_small(known), [*by, "__phrase"], "left")
    row = F.struct("__pos", F.col("__g.token").alias("token"), F.coalesce("__hit", F.lit(False)).alias("hit"))
    back = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("__pos").isNotNull(), row))).alias("__rows"))
    back = back.select(*keys, F.col("__rows.token").alias("__t"), F.col("__rows.hit").alias("__m"))
    marked = back.withColumn("__m", tx.greedy_starts("__m", n))
    return marked.select(*keys, tx.apply_recode("__t", "__m", n).alias(tokens))


def annotate(df: DataFrame, id_col: str, text: str, lexicon: DataFrame, keep: Sequence[str] = (), tagger: Tagger | WideTagger | None = None) -> DataFrame:
    """One row per token with lemma and word class from a lexicon (token, lemma, upos).

    A token the lexicon lacks is its own lemma, of class ``PUNCT`` if it is a sign; a word that it has no class for has
    the class that ``tagger`` finds for its place, and ``X`` without a tagger.
    """
    texts = df.select(id_col, *keep, F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)).alias("__tokens"))
    if tagger is None:
        tokens = texts.select(id_col, *keep, F.posexplode("__tokens").alias("pos", "token"))
    else:
        texts = tag(texts, tagger, "__tokens", [id_col, *keep])
        tokens = texts.select(id_col, *keep, F.posexplode(F.arrays_zip(F.col("__tokens").alias("t"), F.col("upos").alias("c"))).alias("pos", "__p"))
        tokens = tokens.select(id_col, *keep, "pos", F.col("__p.t").alias("token"), F.col("__p.c").alias("__class"))
    entries = (
        lexicon.groupBy(F.lower("token").alias("__low")).agg(F.min(F.struct("lemma", "upos")).alias("__e"))
    )
    tokens = tokens.withColumn("__low", F.lower("token")).join(broadcast_if_small(entries), "__low", "left")
    unknown = F.when(F.col("token").rlike(r"^[\p{L}\p{N}']"), "X" if tagger is None else F.col("__class")).otherwise("PUNCT")
    return tokens.select(
        id_col, *keep, "pos", "token",
        F.coalesce("__e.lemma", "token").alias("lemma"),
        F.coalesce("__e.upos", unknown).alias("upos"),
    )


def _documents(annotated: DataFrame, keys: Sequence[str], stop_words: DataFrame) -> DataFrame:
    """Back to one row per document: array ``tokens`` of (pos, token, lemma, content, stop) in order."""
    listed = stop_words.select(F.lower("word").alias("__low")).distinct().withColumn("__stop", F.lit(True))
    flagged = annotated.withColumn("__low", F.lower("token")).join(broadcast_if_small(listed), "__low", "left")
    token = F.struct(
        "pos", "token", "lemma", F.col("__low").alias("low"),
        (~F.col("upos").isin(FUNCTION_CLASSES)).alias("content"),
        F.coalesce("__stop", F.lit(False)).alias("stop"),
    )
    return flagged.groupBy(*keys).agg(F.sort_array(F.collect_list(token)).alias("tokens"))


def frequent_bigrams(docs: DataFrame, by: Sequence[str], min_bigram: int) -> DataFrame:
    """Lemma pairs that follow each other more than ``min_bigram`` times among the content words."""
    content = F.filter("tokens", lambda t: t["content"] & (~t["stop"] | t["low"].isin(BIGRAM_KEEPS)))
    pairs = docs.select(*by, F.explode(tx.ngrams(F.transform(content, lambda t: t["lemma"]), 2)).alias("phrase"))
    return pairs.groupBy(*by, "phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_bigram).drop("n")


def prepare_terms(
    annotated: DataFrame,
    id_col: str,
    stop_words: DataFrame,
    min_bigram: int = 50,
    by: Sequence[str] = (),
) -> DataFrame:
    """Content terms of each document as an ordered array: rows (by..., id, terms).

    Frequent lemma pairs are found on the content words, but joined where they follow each other in the
    whole text. Stop words, function words and the tail of a joined pair then drop out.
    """
    keys = [*by, id_col]
    docs = materialize(_documents(annotated, keys, stop_words))
    found = frequent_bigrams(docs, by, min_bigram)
    spark = annotated.sparkSession
    fixed = spark.createDataFrame([(p,) for p in ALWAYS_JOINED], "phrase string")
    if by:
        found = found.unionByName(docs.select(*by).distinct().withColumn("phrase", F.explode(F.array(*[F.lit(p) for p in ALWAYS_JOINED]))))
    else:
        found = found.unionByName(fixed)

    lemmas = docs.select(*keys, F.col("tokens.lemma").alias("terms"))
    joined = recode_ngrams(lemmas, keys, "terms", materialize(found), 2, by)
    both = docs.join(joined, keys).withColumn("dashed", tx.recode_phrases(F.col("tokens.token"), ALWAYS_JOINED_DASHED))

    def choose(term: Column, dashed: Column) -> Column:
        return F.when(dashed.isNull(), None).when(dashed.isin(ALWAYS_JOINED_DASHED), dashed).otherwise(term)

    both = both.withColumn("terms", F.zip_with("terms", "dashed", choose))
    both = both.withColumn("kept", F.zip_with("tokens", "terms", lambda t, x: F.when(t["content"] & ~t["stop"], F.lower(x))))
    terms = F.transform(F.filter("kept", lambda x: x.isNotNull()), lambda x: tx.normalise_terms(x))
    return both.select(*keys, terms.alias("terms"))


def _with_rare_words(rows: DataFrame, words: DataFrame) -> tuple[pa.Table | None, DataFrame]:
    """The words that tasks can be given, the most frequent ones of the rows, and the rows with the entries of the others.

    Words are told apart by the power of two of their count, so that no order over all of them is needed.
    """
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
    counts = rows.select(F.explode("__tokens").alias("low")).groupBy(F.lower("low").alias("low")).agg(F.count(F.lit(1)).alias("__n"))
    power = F.length(F.bin(F.coalesce("__n", F.lit(0))))
    words = materialize(words.join(counts, "low", "left").withColumn("__power", power).drop("__n"))
    size = F.sum(F.octet_length("low") + F.coalesce(F.octet_length("lemma"), F.lit(0)))
    held, text, least = 0, 0, None
    for r in words.groupBy("__power").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).orderBy(F.desc("__power")).collect():
        held, text = held + r["n"], text + r["bytes"]
        if held > ph.SHIPPED_ROWS or text > ph.SHIPPED_BYTES:
            break
        least = r["__power"]
    few = F.lit(False) if least is None else F.col("__power") >= least
    head = ph.shipped(words.where(few).drop("__power"), ph.SHIPPED_ROWS)
    if head is None:
        return None, rows
    table = rows.sparkSession.sparkContext.broadcast(ph.WordTable(head))
    cells = rows.select("__row", "__tokens").mapInArrow(ph.missing_batches(table), "__row long, low string")
    entry = F.struct("low", "lemma", "content", "stop")
    rare = cells.join(words.where(~few).drop("__power"), "low").groupBy("__row").agg(F.collect_list(entry).alias("__rare"))
    return head, materialize(rows.join(rare, "__row", "left").drop("__row"))


def term_stream(
    df: DataFrame,
    id_col: str,
    text: str,
    lexicon: DataFrame,
    stop_words: DataFrame,
    min_bigram: int = 50,
    by: Sequence[str] = (),
    tagger: Tagger | WideTagger | None = None,
) -> DataFrame:
    """Content terms of each text as an ordered array, straight from the texts: rows (by..., id, terms).

    The same as ``prepare_terms`` over ``annotate``, one row for each row of ``df`` whose text holds a token, but tokens
    never leave their row: a first pass counts pairs of content lemmas, summed in the tasks, a second one walks each text
    with one automaton over the frequent pairs of all sections. Of a word table beyond the bound of a broadcast the
    frequent words go to the tasks, and rows get the entries of their rare words by a join. Phrases beyond the bound go
    the way of joins, as does a tagger whose words are a table.
    """
    by = list(by)
    spark = df.sparkSession
    low = F.lower("token").alias("low")
    entries = lexicon.groupBy(low).agg(F.min(F.struct("lemma", "upos")).alias("__e"))
    entries = entries.select("low", "__e.lemma", (~F.col("__e.upos").isin(FUNCTION_CLASSES)).alias("content"))
    stops = stop_words.select(F.lower("word").alias("low")).distinct().withColumn("stop", F.lit(True))
    words = entries.join(stops, "low", "full").where("low is not null")
    rows = df.select(*by, id_col, F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)).alias("__tokens"))
    found, rare = None, []
    if isinstance(tagger, WideTagger):
        words = None
    else:
        whole = materialize(words)
        words = ph.shipped(whole)
        if words is None:
            words, rows = _with_rare_words(rows, whole)
            rare = ["__rare"]
    if words is not None:
        table = spark.sparkContext.broadcast(ph.WordTable(words))
        model = tagger and spark.sparkContext.broadcast(tagger)
        kinds = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], "src string", "dst string", "n long"])
        pairs = rows.select(*by, "__tokens", *rare).mapInArrow(ph.pair_batches(table, BIGRAM_KEEPS, len(by), by, model), kinds)
        pairs = pairs.groupBy(*by, "src", "dst").agg(F.sum("n").alias("n")).where(F.col("n") > min_bigram)
        found = ph.shipped(materialize(pairs.drop("n")), BROADCAST_ROWS)
    if found is None:
        return prepare_terms(annotate(df, id_col, text, lexicon, by, tagger), id_col, stop_words, min_bigram, by)
    of = list(zip(*[found.column(c).to_pylist() for c in by])) if by else [()] * found.num_rows
    frequent = zip(of, zip(found.column("src").to_pylist(), found.column("dst").to_pylist()))
    automaton = spark.sparkContext.broadcast(ph.PhraseAutomaton(frequent, [p.split(" ") for p in ALWAYS_JOINED]))
    dashed = ph.PhraseAutomaton([], [p.split(" ") for p in ALWAYS_JOINED_DASHED])
    schema = rows.select(*by, id_col, F.col("__tokens").alias("terms")).schema
    return rows.select(*by, id_col, "__tokens", *rare).mapInArrow(ph.term_batches(table, automaton, dashed, len(by), model), schema)


def pair_counts(docs: DataFrame, tokens: str, by: Sequence[str] = ()) -> DataFrame:
    """How often one token follows another, over all documents."""
    pairs = docs.select(*by, F.inline(tx.neighbours(tokens)))
    return pairs.groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def bigram_edges(counts: DataFrame, n: int = 150, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most frequent pairs of unlike terms, ties in alphabetical order.

    The row limit inside the window is applied before the shuffle, so no task sees a whole section.
    """
    unlike = counts.where(F.col("src") != F.col("dst"))
    order = [F.desc("n"), F.asc("src"), F.asc("dst")]
    if not by:
        return unlike.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return unlike.withColumn("__k", place).where(F.col("__k") <= n).drop("__k")


def bigram_vertices(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Terms of the edges with the sum of the counts of their edges."""
    ends = edges.select(*by, "n", F.explode(F.array("src", "dst")).alias("word"))
    return ends.groupBy(*by, "word").agg(F.sum("n").alias("n"))


def bigram_network(terms: DataFrame, by: Sequence[str] = (), n: int = 150) -> tuple[DataFrame, DataFrame]:
    """Edge and vertex tables of the strongest term pairs, per section if asked."""
    edges = materialize(bigram_edges(pair_counts(terms, "terms", by), n, by))
    return edges, bigram_vertices(edges, by)
