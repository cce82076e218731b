"""Language of a text from character trigram profiles (after Cavnar and Trenkle, 1994).

Trigrams are counted and weighed inside the row, as numbers: a batch of texts is one array of code points. Only counts
cross the network, as long as the profiles are small enough for the tasks; beyond that trigrams are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.text import letters, trigrams
from staylens.runtime import BROADCAST_ROWS, broadcast_if_small, distinct_levels

# Code points that are looked at together; bounds the memory of a task (a longer text stands alone).
RUN_POINTS = 1 << 18


def _coded(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last one, trigrams as numbers, row of each counted from the first) for runs of texts."""
    texts, at = [t or "" for t in column.to_pylist()], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= RUN_POINTS):
            size += len(texts[to])
            to += 1
        points = np.frombuffer("".join(texts[at:to]).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(to - at), [len(t) for t in texts[at:to]])
        inside = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
        yield at, to, points[inside] << 42 | points[inside + 1] << 21 | points[inside + 2], row[inside]
        at = to


def _code(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def _gram(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each run of texts."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        of_row = langs.indices.to_numpy(zero_copy_only=False)
        for at, to, codes, row in _coded(batch.column(1)):
            grams, place = np.unique(codes, return_inverse=True)
            both, n = np.unique(of_row[at:to][row].astype(np.int64) * max(len(grams), 1) + place, return_counts=True)
            names = [_gram(g) for g in grams.tolist()]
            lang, gram = np.divmod(both, max(len(grams), 1))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang)), pa.array([names[g] for g in gram.tolist()], pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"]
            )


def language_profiles(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, weight) for all trigrams of each language; weight is the log of parts per million."""
    texts = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters(text).alias("letters"))
    kinds = f"lang {texts.schema['lang'].dataType.simpleString()}, gram string, n long"
    counts = texts.mapInArrow(_count_batches, kinds).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select("lang", "gram", F.log(F.col("n") * 1e6 / F.col("total")).alias("weight"))


def _score_batches(shared, names: list[str]):
    """Summed weights of each text by language; null for texts without a known trigram."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        for batch in batches:
            for at, to, codes, row in _coded(batch.column(1)):
                place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = known[place] == codes
                place, row = place[hit], row[hit]
                none = np.bincount(row, minlength=to - at) == 0
                sums = [pa.array(np.bincount(row, weights[place, i], minlength=to - at), mask=none) for i in range(weights.shape[1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *sums], names=names)

    return over


def _scores(df: DataFrame, id_col: str, source, wide: DataFrame, langs: list, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, a column of summed weights for each language)."""
    rows = wide.limit(max_rows + 1).toArrow()
    if not 0 < rows.num_rows <= max_rows:
        grams = df.select(id_col, F.explode(trigrams(source)).alias("gram"))
        scores = grams.join(broadcast_if_small(wide), "gram").groupBy(id_col).agg(*[F.sum(F.col(f"`{x}`")).alias(x) for x in langs])
        return df.select(id_col).join(scores, id_col, "left")
    codes = np.array([_code(g) for g in rows.column("gram").to_pylist()], np.int64)
    order = np.argsort(codes)
    weights = np.stack([rows.column(x).to_numpy() for x in langs], axis=1)[order]
    shared = df.sparkSession.sparkContext.broadcast((codes[order], weights))
    texts = df.select(id_col, letters(source).alias("letters"))
    kinds = ", ".join([f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}", *[f"`{x}` double" for x in langs]])
    return texts.mapInArrow(_score_batches(shared, [id_col, *langs]), kinds)


def detect_language(df: DataFrame, id_col: str, text: str, profiles: DataFrame, chars: int | None = None) -> DataFrame:
    """(id, language, score): the language with the largest summed weight; no known trigram gives no language.

    Reads whole texts; ``chars`` limits it to the first characters where that is wanted. The profiles are
    laid out with one column per language, so each trigram meets one row and each text stays in its row.
    """
    langs = distinct_levels(profiles, "lang")
    if not langs:
        return df.select(id_col, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("score"))
    wide = profiles.groupBy("gram").pivot("lang", langs).agg(F.max("weight")).fillna(0.0)
    scores = _scores(df, id_col, F.col(text) if chars is None else F.substring(text, 1, chars), wide, langs)
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"`{x}`"), 6).alias("score"), F.lit(x).alias("language")) for x in langs]))
    return scores.select(id_col, F.when(F.col(f"`{langs[0]}`").isNotNull(), best).alias("best")).select(id_col, "best.language", "best.score")


def filter_language(df: DataFrame, language: str = "en", col: str = "language") -> DataFrame:
    """Rows in the language, and rows whose language is not known."""
    return df.where((F.col(col) == language) | F.col(col).isNull())
