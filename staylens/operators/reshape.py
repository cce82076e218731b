"""Reshaping, joins on names, and set-valued columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.operators.ranks import with_row_number
from staylens.runtime import BROADCAST_ROWS, broadcast_if_small, materialize


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all column names the two sides share."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("the two sides share no column")
    return a.join(b, shared, how)


def anti_join(df: DataFrame, words: DataFrame, col: str, word: str = "word") -> DataFrame:
    """Rows whose ``col`` is not in the word list."""
    listed = broadcast_if_small(words.select(F.col(word).alias(col)).distinct())
    return df.join(listed, col, "left_anti").select(*df.columns)


def semi_join(df: DataFrame, values: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` is among the values."""
    return df.join(broadcast_if_small(values.select(col).distinct()), col, "left_semi").select(*df.columns)


def adjacent_pairs(df: DataFrame, doc: str, pos: str, term: str) -> DataFrame:
    """(doc, src, dst) for terms at consecutive positions of a document.

    An equi-join on the shifted position, so that a document with very many rows is spread too.
    """
    here = df.select(doc, pos, F.col(term).alias("src"))
    after = df.select(doc, (F.col(pos) - 1).alias(pos), F.col(term).alias("dst"))
    return here.join(after, [doc, pos]).select(doc, "src", "dst")


def support(df: DataFrame, keys: Sequence[str], item: str = "item", by: Sequence[str] = ()) -> DataFrame:
    """Number of distinct records that hold each item, optionally per group."""
    distinct = df.select(*by, *[k for k in keys if k not in by], item).distinct()
    return distinct.groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"))


def indicator_pivot(df: DataFrame, keys: Sequence[str], col: str, values: Sequence) -> DataFrame:
    """0/1 column per value, one row per key; repeats count once."""
    return df.groupBy(*keys).pivot(col, list(values)).agg(F.max(F.lit(1))).fillna(0)


def indicators(items: Column | str, values: Sequence[str]) -> list[Column]:
    """0/1 column per value from an array of items. Needs no shuffle, unlike the pivot."""
    return [F.coalesce(F.array_contains(items, v).cast("int"), F.lit(0)) for v in values]


def pivot_by(df: DataFrame, row: str, col: str, value: str, values: Sequence) -> DataFrame:
    """Mean of ``value`` with one column per listed value of ``col``."""
    return df.groupBy(row).pivot(col, list(values)).avg(value)


def spread(df: DataFrame, keys: Sequence[str], key: str, value: str, values: Sequence, fill=None) -> DataFrame:
    """Long to wide with a fixed list of columns."""
    wide = df.groupBy(*keys).pivot(key, list(values)).agg(F.first(value))
    return wide if fill is None else wide.fillna(fill, [str(v) for v in values])


def to_dtm(counts: DataFrame, doc: str, term: str, n: str) -> tuple[DataFrame, DataFrame]:
    """Document-term matrix of all terms from long counts, and its dictionary, both tables.

    The dictionary (term, term_id) numbers the terms from 0 in their order. The matrix has one row per document: the ids of
    its terms, ascending, and how often each stands in it.
    """
    counts = counts.dropna(subset=[doc, term]).select(F.col(doc).alias(doc), F.col(term).alias("term"), F.col(n).cast("long").alias("n")).where("n > 0")
    counts = materialize(counts)
    numbered = with_row_number(counts.select("term").distinct(), [F.asc("term")], name="term_id")
    dictionary = materialize(numbered.select("term", (F.col("term_id") - 1).alias("term_id")))
    cells = _with_entries(counts, dictionary).repartition(doc).groupBy(doc, "term_id").agg(F.sum("n").alias("n"))
    cells = cells.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("term_id", "n"))).alias("cells"))
    return cells.select(doc, F.col("cells.term_id").alias("term_ids"), F.col("cells.n").alias("counts")), dictionary


def _with_entries(counts: DataFrame, dictionary: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``counts`` with the term_id of their term. Of a large dictionary the frequent terms go to the tasks, and only the
    rows of other terms are dealt out by term."""
    if dictionary.limit(max_rows + 1).count() <= max_rows:
        return counts.join(F.broadcast(dictionary), "term").select(*[c for c in counts.columns if c != "term"], "term_id")
    rows = counts.groupBy("term").agg(F.count(F.lit(1)).alias("rows")).join(dictionary, "term")
    frequent = materialize(rows.orderBy(F.desc("rows"), "term_id").limit(max_rows).select("term", "term_id"))
    near = counts.join(F.broadcast(frequent), "term")
    far = counts.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(dictionary, "term")
    return near.unionByName(far).select(*[c for c in counts.columns if c != "term"], "term_id")


def dtm_from_terms(docs: DataFrame, doc: str, terms: str) -> tuple[DataFrame, DataFrame]:
    """``to_dtm`` of token arrays."""
    return to_dtm(docs.select(doc, F.explode(terms).alias("term"), F.lit(1).alias("n")), doc, "term", "n")
