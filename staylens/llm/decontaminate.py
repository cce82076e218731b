"""Benchmark passages in documents by pigeonhole edit matching.

Texts are normalised: lower case, every run of characters that are no letters or digits becomes one space. An item of m
characters may be found with up to ``k = floor(rate * m)`` edits (insertions, deletions, substitutions). Cut into k + 1
pieces, at least one of them has to stand in the document unchanged. One automaton finds all pieces in one pass over
each whole document; where a piece stands, the window in which the item could lie is verified with Myers' bit-parallel
distance, so nothing within the budget is missed and nothing beyond it is reported.

Items of fewer than ``exact_chars`` normalised characters would be met by chance with edits: they have to stand in a
document word for word, from the start of a word to the end of one.

The items are normalised and grouped by Spark and travel to the tasks by broadcasts of bounded size: a larger benchmark
takes more passes over the documents, and the driver holds one block of it at a time.

Cases: null and empty texts of documents or items match nothing, nor do items without a letter or digit; repeated rows and items are searched each; rows without doc_id are
searched like others. A tie of places goes to the first. Empty tables give an empty result. Further columns of the
documents are not looked at here, and kept by ``decontaminate``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.scan import map_batches
from staylens.llm.stored import Scratch

RATE = 0.08
EXACT_CHARS = 40
# Characters of benchmark text in one pass; bounds the automaton in each task.
BLOCK_CHARS = 4_000_000

_GAP = regex.compile(r"[^\p{L}\p{N}]+")


def normalise(text: str) -> str:
    return _GAP.sub(" ", text.replace("Σ", "σ").lower()).strip(" ")


def _places(text: str) -> list[int]:
    """Index in ``text`` of each character of ``normalise(text)``."""
    out, gap = [], False
    for i, c in enumerate(text.replace("Σ", "σ")):
        for low in c.lower():
            if _GAP.match(low):
                gap = bool(out)
            else:
                if gap:
                    out.append(i - 1)
                    gap = False
                out.append(i)
    return out


def pieces(length: int, rate: float) -> tuple[int, list[tuple[int, int]]]:
    """Error budget of an item and the bounds of its budget + 1 pieces."""
    k = int(rate * length)
    edges = [length * i // (k + 1) for i in range(k + 2)]
    return k, list(zip(edges[:-1], edges[1:]))


@functools.lru_cache(maxsize=4096)
def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any part of ``text`` and the first end of such a part, if within limit."""
    m, masks = len(pattern), _masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = limit + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        plus = down | (full & ~(d0 | up))
        minus = up & d0
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1
        minus = minus << 1
        up = (minus | ~(d0 | plus)) & full
        down = plus & d0 & full
        if score < best:
            best, end = score, j + 1
    return (best, end) if end >= 0 else None


@dataclass
class _Searcher:
    items: list[tuple[int, str]]
    rate: float
    exact_chars: int = EXACT_CHARS

    def __post_init__(self):
        self.budget = []
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            k, cuts = pieces(len(text), self.rate if len(text) >= self.exact_chars else 0)
            self.budget.append(k)
            for a, b in cuts:
                found.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best place of each item in a normalised text."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            at = last + 1 - size
            for n, offset in where:
                k, m = self.budget[n], len(self.items[n][1])
                if m < self.exact_chars and (text[at - 1 : at] not in ("", " ") or text[last + 1 : last + 2] not in ("", " ")):
                    continue
                lo, hi = at - offset - k, at - offset + m + k
                own = windows.setdefault(n, [])
                if own and own[-1][0] <= lo <= own[-1][1]:
                    own[-1] = (own[-1][0], max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
        out = []
        for n, spans in windows.items():
            item, best = self.items[n][1], None
            for lo, hi in _merged(spans):
                lo = max(lo, 0)
                got = myers(item, text[lo:hi], self.budget[n] if best is None else best[0] - 1)
                if got:
                    best = (got[0], lo + got[1])
            if best:
                distance, end = best
                # The same search backwards from the end gives the start.
                back = myers(item[::-1], text[max(0, end - len(item) - distance) : end][::-1], distance)
                out.append((self.items[n][0], distance, end - back[1], end))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of bounded size, each normalised text once with its smallest id."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = pa.array([normalise(t.as_py()) for t in batch.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["item_id", "text"])

    given = benchmark.select("item_id", "text").where("text is not null and item_id is not null")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    least = map_batches(given, over, f"item_id {kind}, text string").where("text != ''").groupBy("text").agg(F.min("item_id").alias("item_id"))
    block, size = [], 0
    for row in least.orderBy("item_id").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """doc_id, item_id, distance, and start and end of the passage in characters of the document's own text.

    One row for each document and item that occurs in it, at the place with the fewest edits. Equal item texts go by
    the smallest item_id.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, start int, end int"
    out, blocks = None, _blocks(benchmark)
    block = next(blocks, None)
    while block is not None:
        sent = spark.sparkContext.broadcast(block)

        def over(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(sent.value, rate, exact_chars)
            rows = []
            for d, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                hits = searcher.search(normalise(text)) if text else []
                if hits:
                    place = _places(text)
                    rows += [(d, item, distance, place[a], place[b - 1] + 1) for item, distance, a, b in hits]
            if rows:
                at, *rest = zip(*rows)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                columns = [pa.array(c, k) for c, k in zip(rest, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=["doc_id", "item_id", "distance", "start", "end"])

        found = map_batches(docs.select("doc_id", "text"), over, schema)
        block = next(blocks, None)
        if block is not None or out is not None:
            found = scratch.put(found)  # one pass per block, and its items need not stay
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


_BUILT: dict[tuple[int, float, int], _Searcher] = {}


def _searcher(block: list[tuple[int, str]], rate: float, exact_chars: int) -> _Searcher:
    """The automaton of a block, built once in each worker (a broadcast value stays the same object there)."""
    key = (id(block), rate, exact_chars)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = _Searcher(block, rate, exact_chars)
    return _BUILT[key]


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """The rows of ``docs``, as they are, in which no item stands."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def over(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(sent.value, rate, exact_chars)
            clean = [not searcher.search(normalise(t.as_py() or "")) for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

        docs = map_batches(docs, over, docs.schema)
    return docs
