"""Phrases found inside a row: one automaton over all phrases of all sections, walked over whole batches of tokens.

The tables that a task needs (word table, phrases) are shipped only after they were counted to be small; the operators in
``terms`` go by joins beyond that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.text import ARRIVAL_TERMS


# Word classes that carry no content.
FUNCTION_CLASSES = ["PUNCT", "PROPN", "PART", "SYM", "CCONJ", "AUX", "X", "NUM"]
_WORD = regex.compile(r"[\p{L}\p{N}']")


class PhraseAutomaton:
    """A trie over tokens with one root per section.

    Built from (section, parts) rows, where parts are the tokens of a phrase in order; phrases of ``everywhere`` hold in
    all sections, named ones and others. ``walk`` goes from every place of a token stream at once, a step per token of the
    longest phrase.
    """

    def __init__(self, phrases: Iterable[tuple[object, Sequence[str]]], everywhere: Sequence[Sequence[str]] = ()):
        self.vocabulary: dict[str, int] = {}
        self.roots: dict[object, int] = {}
        steps: dict[tuple[int, int], int] = {}
        final: list[bool] = []
        self.depth = 0

        def fresh() -> int:
            final.append(False)
            return len(final) - 1

        def add(state: int, parts: Sequence[str]) -> None:
            for p in parts:
                edge = (state, self.vocabulary.setdefault(p, len(self.vocabulary)))
                if edge not in steps:
                    steps[edge] = fresh()
                state = steps[edge]
            final[state] = True
            self.depth = max(self.depth, len(parts))

        def root() -> int:
            state = fresh()
            for parts in everywhere:
                add(state, parts)
            return state

        self.other = root() if everywhere else -1
        for section, parts in phrases:
            if section not in self.roots:
                self.roots[section] = root()
            add(self.roots[section], parts)
        self.width = max(len(self.vocabulary), 1)
        keys = np.array([s * self.width + t for s, t in steps], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.final = np.array(final, bool)

    def codes(self, tokens: Sequence[str | None]) -> np.ndarray:
        return np.array([self.vocabulary.get(t, -1) for t in tokens], np.int64)

    def start(self, sections: Sequence[object]) -> np.ndarray:
        """Root of each section; -1 where it has no phrase."""
        return np.array([self.roots.get(s, self.other) for s in sections], np.int64)

    def walk(self, codes: np.ndarray, ends: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Tokens of the longest phrase that starts at each place, 0 if none; ``ends`` is the end of the row of a place."""
        length = np.zeros(len(codes), np.int64)
        if not len(self.keys):
            return length
        here, state = np.flatnonzero(roots >= 0), roots[roots >= 0]
        for step in range(self.depth):
            inside = here + step < ends[here]
            here, state = here[inside], state[inside]
            token = codes[here + step]
            key = state * self.width + token
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (token >= 0) & (self.keys[at] == key)
            here, state = here[found], self.next[at[found]]
            hit = self.final[state]
            length[here[hit]] = step + 1
        return length


def leftmost(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the phrases that are taken when overlaps are settled from left to right, and the swallowed places."""
    starts, free = [], 0
    for p, n in zip(np.flatnonzero(length).tolist(), length[length > 0].tolist()):
        if p >= free:
            starts.append(p)
            free = p + n
    starts = np.array(starts, np.int64)
    swallowed = np.zeros(len(length), bool)
    for k in range(1, int(length.max(initial=0))):
        swallowed[starts[length[starts] > k] + k] = True
    return starts, swallowed


def cuts(phrase: str, n: int) -> Iterator[tuple[str, ...]]:
    """All ways to read a phrase as ``n`` tokens; a token may itself be a compound with blanks."""
    words = phrase.split(" ")
    for at in combinations(range(1, len(words)), n - 1):
        edges = [0, *at, len(words)]
        yield tuple(" ".join(words[a:b]) for a, b in zip(edges[:-1], edges[1:]))


# Most rows and most bytes of text of a table that tasks are given; each worker holds one copy.
SHIPPED_ROWS, SHIPPED_BYTES = 2_000_000, 64 << 20


def shipped(df: DataFrame, max_rows: int = SHIPPED_ROWS) -> pa.Table | None:
    """A table for the tasks, if it was counted to be within the bounds; else None."""
    text = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    size = sum((F.coalesce(t, F.lit(0)) for t in text), F.lit(0)).cast("long")
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return df.toArrow() if rows <= max_rows and held <= SHIPPED_BYTES else None


# Tokens of a batch that are worked through at once; a row is never cut.
SLICE_TOKENS = 100_000


def slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows, so that what a task holds beside a batch follows the tokens of a run, not of all its rows."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(ends) or not len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
            yield batch.slice(first, last - first)
            if last >= len(ends):
                break
            first = last


class Stream:
    """The tokens of a batch, end to end: distinct tokens, the code of each place, bounds and ends of rows."""

    def __init__(self, column: pa.Array):
        offsets = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.offsets = np.concatenate(([0], np.cumsum(offsets))).astype(np.int64)
        coded = column.flatten().cast(pa.string()).dictionary_encode()
        self.distinct: list[str | None] = [*coded.dictionary.to_pylist(), None]
        self.code = coded.indices.fill_null(len(self.distinct) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(offsets)), np.diff(self.offsets))
        self.ends = self.offsets[1:][self.row]


class Strings:
    """Distinct output strings of a batch; -1 is null."""

    def __init__(self, first: Iterable[str | None] = ()):
        self.of: dict[str, int] = {}
        self.start = np.array([-1 if s is None else self.code(s) for s in first], np.int64)

    def code(self, s: str) -> int:
        return self.of.setdefault(s, len(self.of))

    def lists(self, codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
        taken = pa.array(np.where(codes < 0, 0, codes), mask=codes < 0)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(list(self.of), pa.string()).take(taken))


def _joined(out: Strings, codes: np.ndarray, length: np.ndarray, text: Sequence[str | None], of: np.ndarray) -> np.ndarray:
    """``codes`` with the first token of a taken phrase as the compound and the others null."""
    starts, swallowed = leftmost(length)
    codes = np.where(swallowed, -1, codes)
    known: dict[tuple[int, ...], int] = {}
    new = np.empty(len(starts), np.int64)
    for i, (p, n) in enumerate(zip(starts.tolist(), length[starts].tolist())):
        parts = tuple(of[p : p + n].tolist())
        if parts not in known:
            known[parts] = out.code(" ".join(text[c] for c in parts))
        new[i] = known[parts]
    codes[starts] = new
    return codes


def _sections(batch: pa.RecordBatch, by: int) -> list[tuple]:
    return list(zip(*[batch.column(i).to_pylist() for i in range(by)])) if by else [()] * batch.num_rows


def _over_rows(sections: list[tuple], root_of) -> np.ndarray:
    """``root_of`` by row, asked once for each distinct section."""
    seen = dict.fromkeys(sections)
    root = dict(zip(seen, root_of(list(seen)).tolist()))
    return np.array([root[s] for s in sections], np.int64)


def recode_batches(phrases, by: int, keys: int):
    """Over batches (by..., keys..., tokens): the same with the phrases of the section joined; a null array becomes empty."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = phrases.value
        for batch in slices(batches, by + keys):
            s = Stream(batch.column(by + keys))
            root = _over_rows(_sections(batch, by), automaton.start)
            length = automaton.walk(automaton.codes(s.distinct)[s.code], s.ends, root[s.row])
            out = Strings(s.distinct)
            codes = _joined(out, out.start[s.code], length, s.distinct, s.code)
            yield pa.RecordBatch.from_arrays([*batch.columns[by : by + keys], out.lists(codes, s.offsets)], names=batch.schema.names[by:])

    return over


class TextIndex:
    """Places of texts in a table sorted by a hash, so that a copy takes little more than its text; a hit is compared as text."""

    def __init__(self, texts: pa.ChunkedArray):
        hashes = self._hash(texts.to_pylist())
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.texts = texts.take(pa.array(self.order)).combine_chunks()
        again = np.flatnonzero(self.hashes[1:] == self.hashes[:-1]) + 1
        self.twins = {self.texts[int(i)].as_py(): int(i) for i in again}

    @staticmethod
    def _hash(tokens: Sequence[str]) -> np.ndarray:
        return pd.util.hash_array(np.array(tokens, object), categorize=False) if len(tokens) else np.empty(0, np.uint64)

    def find(self, tokens: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Place in the sorted table of each token, and whether it is there at all; the table is not empty."""
        at = np.minimum(np.searchsorted(self.hashes, self._hash(["" if t is None else t for t in tokens])), len(self.hashes) - 1)
        if self.twins:
            at = np.array([self.twins.get(t, i) for t, i in zip(tokens, at.tolist())], np.int64)
        return at, np.array([a == b for a, b in zip(self.texts.take(pa.array(at)).to_pylist(), tokens)], bool)


class WeightTable:
    """Whole-number weights by word, from a table of words and weight columns; a weight may be null."""

    def __init__(self, table: pa.Table, weights: Sequence[str]):
        table = table.filter(pc.is_valid(table.column(0)))
        self.index = TextIndex(table.column(0))
        table = table.take(pa.array(self.index.order))
        self.there = [table.column(c).combine_chunks().is_valid().to_numpy(zero_copy_only=False) for c in weights]
        self.weights = [pc.fill_null(table.column(c), 0).to_numpy().astype(np.int64) for c in weights]

    def sums(self, s: Stream) -> list[pa.Array]:
        """By row and weight column, the sum over its tokens; null without a token that has the weight."""
        rows = len(s.offsets) - 1
        if not len(self.index.hashes):
            return [pa.nulls(rows, pa.int64()) for _ in self.weights]
        at, known = self.index.find(s.distinct)

        def by_row(of_token: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(of_token[s.code], dtype=np.int64)))[s.offsets]
            return np.diff(total)

        return [
            pa.array(by_row(np.where(known, w[at], 0)), mask=by_row(known & there[at]) == 0) for w, there in zip(self.weights, self.there)
        ]


def sum_batches(table, kept: int, names: Sequence[str]):
    """Over batches (kept columns..., tokens): the kept columns and the sum of each weight over the tokens."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = table.value
        for batch in slices(batches, kept):
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *weights.sums(Stream(batch.column(kept)))], names=list(names))

    return over


class WordTable:
    """Lemma, content and stop flags by lower-case token, from a table (low, lemma, content, stop)."""

    def __init__(self, table: pa.Table):
        self.index = TextIndex(table.column("low"))
        table = table.take(pa.array(self.index.order)).combine_chunks()
        self.lemma = table.column("lemma").combine_chunks()
        self.classed = table.column("content").is_valid().to_numpy()
        self.content, self.stop = (pc.fill_null(table.column(c), False).to_numpy().astype(bool) for c in ("content", "stop"))

    def of(self, tokens: Sequence[str | None]) -> tuple[list[str | None], list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """Lower case, lemma, content and stop flag of distinct tokens, and whether the table has a class for them.

        An unknown token is its own lemma, without content.
        """
        low = [None if t is None else t.lower() for t in tokens]
        if not len(self.index.hashes):
            return low, list(tokens), *np.zeros((3, len(low)), bool)
        at, known = self.index.find(low)
        lemma = [x if k and x is not None else t for t, k, x in zip(tokens, known.tolist(), self.lemma.take(pa.array(at)).to_pylist())]
        return low, lemma, self.content[at] & known, self.stop[at] & known, self.classed[at] & known

    def of_batch(self, s: Stream, rare: pa.Array | None) -> tuple[list[str | None], list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """``of`` the tokens of a batch; words outside this table have their entries in ``rare``, lists by row."""
        low, lemma, content, stop, classed = self.of(s.distinct)
        entries = {} if rare is None else {e["low"]: e for e in rare.flatten().to_pylist()}
        for i, e in enumerate(entries.get(t) for t in low) if entries else ():
            if e is not None:
                lemma[i] = s.distinct[i] if e["lemma"] is None else e["lemma"]
                content[i], stop[i], classed[i] = bool(e["content"]), bool(e["stop"]), e["content"] is not None
        return low, lemma, content, stop, classed

    def content_places(self, s: Stream, content: np.ndarray, classed: np.ndarray, tagger) -> np.ndarray:
        """Content flag of each place: of its token, or by the class that a tagger finds for a word without one."""
        if tagger is None:
            return content[s.code]
        open_words = ~classed & np.array([t is not None and bool(_WORD.match(t)) for t in s.distinct], bool)
        if not open_words.any():
            return content[s.code]
        meant = np.array([c not in FUNCTION_CLASSES for c in tagger.classes], bool)[tagger.stream(s)]
        return np.where(open_words[s.code], meant, content[s.code])


def missing_batches(words):
    """Over batches (row, tokens): (row, low) for the distinct lower-case tokens of each row that the table lacks."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.value
        for batch in slices(batches, 1):
            s = Stream(batch.column(1))
            low = Strings(None if t is None else t.lower() for t in s.distinct)
            texts = list(low.of)
            known = table.index.find(texts)[1] if texts and len(table.index.hashes) else np.zeros(len(texts), bool)
            code = low.start[s.code]
            open_ = code >= 0
            open_[open_] = ~known[code[open_]]
            cells = np.unique(s.row[open_] * max(len(texts), 1) + code[open_])
            row, code = np.divmod(cells, max(len(texts), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(texts, pa.string()).take(pa.array(code))], names=["__row", "low"])

    return over


def pair_batches(words, keeps: Sequence[str], by: int, names: Sequence[str], tagger=None):
    """Over batches (by..., tokens, entries of rare words if any): how often one content lemma follows another, summed within the batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.value
        for batch in slices(batches, by):
            s = Stream(batch.column(by))
            low, lemma, content, stop, classed = table.of_batch(s, batch.column(by + 1) if batch.num_columns > by + 1 else None)
            kept = ~stop | np.array([t in keeps for t in low], bool)
            out = Strings(lemma)
            place = np.flatnonzero(table.content_places(s, content, classed, tagger and tagger.value) & kept[s.code])
            code, row = out.start[s.code[place]], s.row[place]
            same = row[1:] == row[:-1]
            sections = _sections(batch, by)
            number = {x: i for i, x in enumerate(dict.fromkeys(sections))}
            section = np.array([number[x] for x in sections], np.int64)[row[1:][same]]
            n_words = max(len(out.of), 1)
            pairs, n = np.unique((section * n_words + code[:-1][same]) * n_words + code[1:][same], return_counts=True)
            text, groups = list(out.of), list(number)
            where, src, dst = pairs // n_words // n_words, pairs // n_words % n_words, pairs % n_words
            columns = [pa.array([groups[g][i] for g in where.tolist()], batch.column(i).type) for i in range(by)]
            parts = [[text[c] for c in side.tolist()] for side in (src, dst)]
            arrays = [*columns, *[pa.array(p, pa.string()) for p in parts], pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "src", "dst", "n"])

    return over


def term_batches(words, phrases, dashed: PhraseAutomaton, by: int, tagger=None):
    """Over batches (by..., id, tokens, entries of rare words if any): the content terms in order, phrases of lemmas and dashed phrases of tokens joined.

    Rows without a token are left out here, since a filter before would have the texts cut twice.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, automaton = words.value, phrases.value
        for batch in slices(batches, by + 1):
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(by + 1)), 0))
            s = Stream(batch.column(by + 1))
            _, lemma, content, stop, classed = table.of_batch(s, batch.column(by + 2) if batch.num_columns > by + 2 else None)
            out = Strings(lemma)
            root = _over_rows(_sections(batch, by), automaton.start)
            length = automaton.walk(automaton.codes(lemma)[s.code], s.ends, root[s.row])
            codes = _joined(out, out.start[s.code], length, lemma, s.code)
            length = dashed.walk(dashed.codes(s.distinct)[s.code], s.ends, np.full(len(s.code), dashed.other))
            starts, swallowed = leftmost(length)
            codes[swallowed] = -1
            for p in starts.tolist():
                codes[p] = out.code(" ".join(s.distinct[c] for c in s.code[p : p + length[p]].tolist()))
            kept = table.content_places(s, content, classed, tagger and tagger.value) & ~stop[s.code] & (codes >= 0)
            bounds = np.concatenate(([0], np.cumsum(kept)))[s.offsets]
            spelt = Strings(_one_spelling(t) for t in out.of)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: by + 1], spelt.lists(spelt.start[codes[kept]], bounds)], names=[*batch.schema.names[: by + 1], "terms"]
            )

    return over


def _one_spelling(term: str) -> str:
    term = term.lower()
    for found, wanted in ARRIVAL_TERMS.items():
        term = term.replace(found, wanted, 1)
    return term
