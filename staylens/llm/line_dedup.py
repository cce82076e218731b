"""Fuzzy line deduplication by MinHash.

Lines are what stands between line feeds, trimmed and with A-Z in lower case. Equal lines, told by 128 bits, are one item,
which stands for its first place by doc_id; what follows looks at each distinct item once, however often it stands in the
table. An item is the set of its distinct runs of ``k`` characters. One hash per run, dealt to bins with a minimum each,
gives a signature (empty bins borrow from filled ones by a fixed order); bands of the signature are the keys that
candidates share: twenty of five bins miss 4 in 10,000 pairs at a similarity of 0.8, and fewer above it. Long lines of one
language have many runs in common, so lines of LONG runs or more have 44 bands of eight bins: 3 in 10,000 missed at 0.8,
and far fewer keys in common with what is not alike. Lines that may be linked with both kinds have the keys of both. Candidates whose
sizes or parity sketches rule a link out are left out, the others are verified by their exact Jaccard similarity. Links
become components by distributed union-find, and of each component the first line, by doc_id and place, is kept.

Keys travel in blocks, a row for each batch and part of the key space, and meet in groups of bounded size. Keys that a
large part of all items has are found on a fixed share of the documents beforehand; their items meet the smallest item of
the key by a broadcast of those few keys. Which way a key takes does not change a result. Among the keys a line goes by the first 64 bits of its hash; of two
lines that share these, the one with the smaller rest is compared, the other only with its equals.

Cases: a line without characters other than white space is never dropped; a line shorter than ``k`` is one run. Rows
without doc_id or text are kept as they are and take no part. Rows that share a doc_id are told apart by their texts: a
line is dropped from the row it stands in and from no other, and the first of such rows is the one with the smallest
hash. Rows equal in both are treated alike: the same line at the same place counts once. A document of which every line
was dropped has an empty text and ``emptied`` is true. Further columns are handed on. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.links import HOT_KEYS, HOT_ROWS, HOT_SHARE, linked_components
from staylens.llm.scan import CHUNK_BYTES, list_array, map_batches, mix, packed_texts, parity_sketches, runs, segment_sums, signed, stream, text_bytes, wide_jaccard_possible, wide_sketches
from staylens.llm.stored import Scratch

K = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 20, 5
# Lines of this many runs have the bands that follow, shorter ones those above.
LONG, LONG_BANDS, LONG_ROWS = 256, 44, 8
# Lines whose signatures are made at once; bounds the memory of a task. And marks of one part of the key space.
LINES, PART = 1 << 11, 1 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = [9, 10, 11, 12, 13, 32]


class Lines:
    """Non-blank lines of a run of documents as ranges of code points: document, place in it, start and end."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = _LOWER[raw]
        lead = (low & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(lead)))
        self.points = np.frombuffer(low.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = before[offsets]
        feeds = np.flatnonzero(self.points == 10)
        own, within = np.arange(len(first) - 1), np.searchsorted(first[1:], feeds, "right")
        # A line starts at a document or after a feed and ends at the next feed or document.
        starts, doc = _in_order(np.concatenate((first[:-1], feeds + 1)), np.concatenate((own, within)))
        ends, _ = _in_order(np.concatenate((first[1:], feeds)), np.concatenate((own, within)))
        place = np.arange(len(starts)) - np.searchsorted(doc, doc)
        solid = ~np.isin(self.points, _BLANK)
        at = np.flatnonzero(solid)
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
        keep = hi > lo
        self.doc, self.place = doc[keep], place[keep]
        self.start, self.end = at[lo[keep]], at[hi[keep] - 1] + 1

    def only(self, which: np.ndarray) -> Lines:
        """Some of the lines, by ascending number, with no characters before and after them."""
        some = copy(self)
        some.doc, some.place, some.start, some.end = (x[which] for x in (self.doc, self.place, self.start, self.end))
        first = some.start[0]
        some.points, some.start, some.end = self.points[first : some.end[-1]], some.start - first, some.end - first
        return some


def _in_order(at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((at, doc))
    return at[order], doc[order]


def char_runs(lines: Lines, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` characters (repeats included) line by line, and the bounds of each line."""
    weight = stream(11, k) | _U(1)
    points = np.concatenate((lines.points, np.zeros(k, np.uint32))).astype(_U)
    n = len(lines.points)
    rolled = points[:n] * weight[0]
    for j in range(1, k):
        rolled += points[j : n + j] * weight[j]
    count = np.maximum(lines.end - lines.start - k + 1, 1)
    bounds = np.concatenate(([0], np.cumsum(count)))
    value = rolled[np.arange(bounds[-1]) + np.repeat(lines.start - bounds[:-1], count)]
    # A line shorter than k must not see what comes after it.
    for i in np.flatnonzero(lines.end - lines.start < k).tolist():
        own = lines.points[lines.start[i] : lines.end[i]]
        value[bounds[i]] = (own * weight[: len(own)]).sum(dtype=_U) + _U(len(own))
    return mix(value), bounds


def distinct_runs(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes line by line, by their upper 44 bits, and the bounds of each line (at most 2^20 lines)."""
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=_U), np.diff(bounds))
    both = np.sort((owner << _U(44)) | (values >> _U(20)))
    both = both[np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1]))]
    return both & _U((1 << 44) - 1), np.searchsorted(both >> _U(44), np.arange(len(bounds), dtype=_U))


@lru_cache
def _orders(bins: int) -> np.ndarray:
    """For each bin the order in which it borrows from others."""
    return np.stack([np.argsort(stream(20 + b, bins)) for b in range(bins)])


def signatures(values: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash: lines x bins, empty bins filled from others by a fixed order for each bin."""
    lines = len(bounds) - 1
    none = _U(0xFFFFFFFFFFFFFFFF)
    flat = np.full(lines * bins, none, _U)
    owner = np.repeat(np.arange(lines), np.diff(bounds))
    place = owner * bins + (((values >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
    ranks = mix(values ^ _U(0xA0761D6478BD642F))
    if len(place) and (place[1:] >= place[:-1]).all():  # sorted runs fill bin after bin
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        flat[place[first]] = np.minimum.reduceat(ranks, first)
    else:
        np.minimum.at(flat, place, ranks)
    out = flat.reshape(lines, bins)
    orders = _orders(bins)
    empty = out == none
    row, col = np.nonzero(empty)
    source = out.copy()
    for turn in range(bins):
        if not len(row):
            break
        lent = source[row, orders[col, turn]]
        good = lent != none
        out[row[good], col[good]] = mix(lent[good] + _U(turn + 1))
        row, col = row[~good], col[~good]
    return out


def _row() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text")


def line_hashes(lines: Lines, salts: tuple[int, ...]) -> list[np.ndarray]:
    """A 64-bit hash of each line for each salt."""
    size = lines.end - lines.start
    bounds = np.concatenate(([0], np.cumsum(size)))
    position = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    points = lines.points[position + np.repeat(lines.start, size)].astype(_U) + _U(1)
    # Order matters for equality: characters enter with their place in the line.
    placed = position.astype(_U) * _U(0x9E3779B97F4A7C15)
    return [mix(segment_sums(mix(points * _U(odd) + placed), bounds) + size.astype(_U)) for odd in salts]


_SALTS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id and row with, line by line, place and item (two 64-bit hashes of the line)."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, lines in _lines_of(batch.column(2)):
            edges = np.searchsorted(lines.doc, np.arange(b - a + 1))
            arrays = [lines.place.astype(np.int32), *map(signed, line_hashes(lines, _SALTS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[list_array(pa.array(x), edges) for x in arrays]],
                names=["doc_id", "row", "place", "h1", "h2"],
            )

    return map_batches(docs.select("doc_id", "row", "text"), over, "doc_id long, row long, place array<int>, h1 array<long>, h2 array<long>")


def fetch_lines(docs: DataFrame, wanted: DataFrame, make: Callable[[pa.Array, pa.Array], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``make`` makes of items and their lines, for ``wanted`` (doc_id, row, place, item)."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        items, lines, size = [], [], 0
        for blob, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = open_up(blob).decode().split("\n")
            for w in pairs:
                items.append(w["item"])
                lines.append(own[w["place"]])
                size += len(lines[-1])
            if size > CHUNK_BYTES:
                yield from make(pa.array(items, pa.int64()), pa.array(lines, pa.string()))
                items, lines, size = [], [], 0
        if items:
            yield from make(pa.array(items, pa.int64()), pa.array(lines, pa.string()))

    by_row = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("item", "place")).alias("wanted"))
    # Rows equal in doc_id and text all meet the same line.
    texts = packed_texts(docs, ["doc_id", "row"])
    joined = texts.join(by_row, ["doc_id", "row"]).select("blob", "wanted")
    return map_batches(joined, cut, schema)


def _lines_of(column: pa.Array) -> Iterator[tuple[int, int, Lines]]:
    data, offsets = text_bytes(column)
    for a, b in runs(offsets, CHUNK_BYTES // 2):
        yield a, b, Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def band_keys(flat: np.ndarray, bounds: np.ndarray, threshold: Fraction, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines from their distinct runs, and the line of each key.

    A pair of which both lines have at most LONG runs shares keys of the first kind; if one has more, the other has at
    least LONG times the threshold, and both have the keys of the second kind.
    """
    size = np.diff(bounds)
    up, down = threshold.numerator, threshold.denominator
    kinds = [(np.flatnonzero(size <= LONG), bands, rows, 12), (np.flatnonzero(size * down >= LONG * up), LONG_BANDS, LONG_ROWS, 13)]
    keys, owner = [], []
    for which, b, r, seed in kinds:
        of_line = np.repeat(np.arange(len(size)), size)
        chosen = np.zeros(len(size), bool)
        chosen[which] = True
        for at in range(0, len(which), LINES):
            part = which[at : at + LINES]
            lo, hi = bounds[part[0]], bounds[part[-1] + 1]
            values = flat[lo:hi][chosen[of_line[lo:hi]]]
            # Runs are told by 44 bits, bins by the upper ones.
            sign = signatures(values << _U(20), np.concatenate(([0], np.cumsum(size[part]))), b * r).reshape(len(part), b, r)
            key = mix((sign * (stream(seed, r) | _U(1))).sum(axis=2, dtype=_U) + np.arange(1, b + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
            keys.append(key.reshape(-1))
            owner.append(np.repeat(part, b))
    return np.concatenate([np.zeros(0, _U), *keys]), np.concatenate([np.zeros(0, np.int64), *owner])


def _marks(column: pa.Array, k: int, threshold: Fraction, bands: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and items (the first hash of a line) of the distinct lines of a run of documents."""
    for _, _, lines in _lines_of(column):
        item = line_hashes(lines, _SALTS[:1])[0]
        once = np.sort(np.unique(item, return_index=True)[1])
        for at in range(0, len(once), LINES):
            part = once[at : at + LINES]
            keys, owner = band_keys(*distinct_runs(*char_runs(lines.only(part), k)), threshold, bands, rows)
            yield keys, item[part][owner]


def key_blocks(docs: DataFrame, parts: int, hot: np.ndarray, k: int, threshold: Fraction, bands: int, rows: int) -> DataFrame:
    """Marks in blocks: part of the key space, the upper 32 bits of the keys and the items; without the (sorted) hot keys."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def blocks() -> pa.RecordBatch:
            keys, items = (np.concatenate(x) for x in zip(*held))
            part = (keys % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(edges))
            keys, items = (keys[order] >> _U(32)).astype(np.uint32), items[order]
            cut = [pa.array([x[edges[p] : edges[p + 1]].tobytes() for p in full], pa.binary()) for x in (keys, items)]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *cut], names=["part", "keys", "items"])

        for keys, items in _marks(batch.column(0), k, threshold, bands, rows):
            cold = ~np.isin(keys, hot)
            held.append((keys[cold], items[cold]))
            size += len(keys)
            if size > PART:
                yield blocks()
                held, size = [], 0
        if size:
            yield blocks()

    return map_batches(docs.select("text"), over, "part int, keys binary, items binary")


def _stars_of_part(table: pa.Table) -> pa.Table:
    """Each item of a key but the smallest, with the smallest; the marks of one part of the key space."""
    part = table.column("part")[0].as_py()
    read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    key, item = read("keys", np.uint32), read("items", _U).view(np.int64)
    order = np.lexsort((item, key))
    key, item = key[order], item[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    again = np.concatenate(([False], (item[1:] == item[:-1]) & ~fresh[1:]))
    lo = item[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
    keep = (item != lo) & ~again
    return pa.table({"key": key[keep].astype(np.int64) << 31 | part, "lo": lo[keep], "item": item[keep]})


def marked_items(docs: DataFrame, lines: int, k: int, threshold: Fraction, bands: int, rows: int, scratch: Scratch) -> DataFrame:
    """(key, lo, item): every item of a key but the smallest, with the smallest; keys of one item are left out."""

    def plain(batch: pa.RecordBatch, only: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for keys, items in _marks(batch.column(0), k, threshold, bands, rows):
            some = slice(None) if only is None else np.isin(keys, only)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[some])), pa.array(signed(items[some]))], names=["key", "item"])

    sample = map_batches(docs.where(F.pmod(F.xxhash64("doc_id", "row"), F.lit(HOT_SHARE)) == 0).select("text"), plain, "key long, item long").distinct()
    found = sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "key").limit(HOT_KEYS).toPandas()
    hot = np.sort(found["key"].to_numpy(np.int64)).view(_U)
    parts = lines * (bands + LONG_BANDS) // 2 // PART + 1
    out = key_blocks(docs, parts, hot, k, threshold, bands, rows).groupBy("part").applyInArrow(_stars_of_part, "key long, lo long, item long")
    if len(hot):
        # Negative numbers of their own: no key of a block is negative.
        number = docs.sparkSession.createDataFrame([(int(h), -1 - i) for i, h in enumerate(hot.view(np.int64))], "key long, number long")
        ours = scratch.put(map_batches(docs.select("text"), lambda batch: plain(batch, hot), "key long, item long").join(F.broadcast(number), "key").select(F.col("number").alias("key"), "item").distinct())
        least = ours.groupBy("key").agg(F.min("item").alias("lo"))
        out = out.unionByName(ours.join(F.broadcast(least), "key").where("item > lo").select("key", "lo", "item"))
    return scratch.put(out)


def texts_and_sketches(k: int) -> Callable[[pa.Array, pa.Array], Iterator[pa.RecordBatch]]:
    """item, its line and its sketch (number of distinct runs, parity words, wide parity words)."""

    def make(items: pa.Array, column: pa.Array) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(items), LINES):
            own_items, own_lines = items.slice(at, LINES), column.slice(at, LINES)
            for a, b, lines in _lines_of(own_lines):
                flat, own = distinct_runs(*char_runs(lines, k))
                narrow = np.concatenate((np.diff(own)[:, None], signed(parity_sketches(flat, own))), axis=1)
                wide = wide_sketches(flat, own)
                both = [x for pair in zip(narrow, map(signed, wide)) for x in pair]
                sketch = list_array(pa.array(np.concatenate(both)), np.concatenate(([0], np.cumsum([5 + len(w) for w in wide]))))
                yield pa.RecordBatch.from_arrays([own_items.slice(a, b - a), own_lines.slice(a, b - a), sketch], names=["item", "line", "sketch"])

    return make


def similar_lines(lines: DataFrame, k: int, threshold: Fraction):
    """Verifier for pairs of items; ``lines`` has their texts."""
    up, down = threshold.numerator, threshold.denominator
    lines = lines.select("item", "line")

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # Runs of no more than so many pairs are held at once.
        for at in range(0, batch.num_rows, LINES):
            yield true_links(batch.slice(at, LINES))

    def true_links(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, np.ndarray] = {}

        def runs_of(column: pa.Array) -> list[np.ndarray]:
            texts = column.to_pylist()
            new = list({t for t in texts if t not in seen})
            for a, b, own in _lines_of(pa.array(new, pa.string())):
                values, bounds = char_runs(own, k)
                for i in range(b - a):
                    seen[new[a + i]] = np.unique(values[bounds[i] : bounds[i + 1]])
            return [seen[t] for t in texts]

        keep = []
        for x, y in zip(runs_of(batch.column(2)), runs_of(batch.column(3))):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * down >= up * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(lines.withColumnsRenamed({"item": "a", "line": "line_a"}), "a")
        both = both.join(lines.withColumnsRenamed({"item": "b", "line": "line_b"}), "b")
        return map_batches(both.select("a", "b", "line_a", "line_b"), over, "a long, b long")

    return verify


def dropped_lines(docs: DataFrame, k: int = K, threshold: Fraction | float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row, dropped): places of the lines to drop, for rows that have any."""
    threshold = Fraction(threshold).limit_denominator(1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), "text").where("doc_id is not null and text is not null")
    scratch = Scratch(docs.sparkSession, "line-dedup")
    each = line_table(docs).select("doc_id", "row", F.explode(F.arrays_zip("place", "h1", "h2")).alias("l"))
    each = scratch.put(each.select("doc_id", "row", "l.place", "l.h1", "l.h2"))
    # One row per distinct line: its first place, and how often it stands.
    first = each.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "place")).alias("at"), F.count(F.lit(1)).alias("n"))
    first = scratch.put(first.select("h1", "h2", "at", (F.col("n") > 1).alias("more")))
    members = marked_items(docs, each.count(), k, threshold, bands, rows, scratch)
    paired = members.select(F.col("item").alias("h1")).unionByName(members.select(F.col("lo").alias("h1"))).distinct()
    items = first.join(paired, "h1").groupBy("h1").agg(F.min(F.struct("h2", "at")).alias("one"))
    items = scratch.put(items.select(F.col("h1").alias("item"), "one.h2", "one.at"))
    lines = fetch_lines(docs, items.select("item", "at.*"), texts_and_sketches(k), "item long, line string, sketch array<long>")
    lines = scratch.put(lines.dropDuplicates(["item"]))
    _, found = linked_components(members, ["key"], similar_lines(lines, k, threshold), scratch, lines.select("item", "sketch"), wide_jaccard_possible(threshold))
    # The line of a component that stands first is kept; all others of its items, and repeats of items, go.
    linked = items.join(found.withColumnRenamed("node", "item"), "item")
    lead = linked.groupBy("component").agg(F.min(F.struct("at", "item")).alias("kept"))
    gone = linked.join(lead, "component").where("item != kept.item").select(F.col("item").alias("h1"), "h2", F.lit(True).alias("gone"))
    fate = first.join(gone, ["h1", "h2"], "left").where("more or gone").select("h1", "h2", F.when(F.col("gone").isNull(), F.col("at")).alias("kept"))
    fate = scratch.put(fate)
    for used in (members, items, lines, first):
        scratch.drop(used)
    lost = each.join(fate, ["h1", "h2"]).where(~F.struct("doc_id", "row", "place").eqNullSafe(F.col("kept")))
    lost = scratch.put(lost.groupBy("doc_id", "row").agg(F.collect_set("place").alias("dropped")))
    scratch.drop(each)
    scratch.drop(fate)
    return lost


def line_dedup(docs: DataFrame, k: int = K, threshold: Fraction | float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with the text that is left, and n_lines, n_dropped and emptied."""
    lost = dropped_lines(docs, k, threshold, bands, rows).withColumnsRenamed({"doc_id": "__doc", "row": "__row", "dropped": "__dropped"})
    others = [c for c in docs.columns if c != "text"]
    texts = packed_texts(docs.withColumn("__own", _row()), [*others, "__own"])
    joined = texts.join(lost, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.col("__own") == F.col("__row")), "left").drop("__doc", "__row", "__own")

    def rewrite(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        texts, counts, gone, emptied, size, done = [], [], [], [], 0, 0

        def made() -> pa.RecordBatch:
            arrays = [pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(gone, pa.int32()), pa.array(emptied, pa.bool_())]
            own = [c.slice(done, len(texts)) for c in batch.columns[: len(others)]]
            return pa.RecordBatch.from_arrays([*own, *arrays], names=[*others, "text", "n_lines", "n_dropped", "emptied"])

        for blob, dropped in zip(batch.column(len(others)), batch.column(len(others) + 1).to_pylist()):
            text = open_up(blob.as_py()).decode() if blob.is_valid else None
            n = 0 if text is None else text.count("\n") + 1
            drop = {p for p in dropped or () if p < n}
            left = [line for i, line in enumerate(text.split("\n")) if i not in drop] if drop else []
            texts.append("\n".join(left) if drop else text)
            counts.append(n)
            gone.append(len(drop))
            emptied.append(bool(drop) and not any(line.strip(" \t\v\f\r") for line in left))
            size += len(text or "")
            # No more text is open at once than makes a run.
            if size > CHUNK_BYTES:
                yield made()
                done += len(texts)
                texts, counts, gone, emptied, size = [], [], [], [], 0
        if texts:
            yield made()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    out = map_batches(joined, rewrite, f"{kinds}, text string, n_lines int, n_dropped int, emptied boolean")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped", "emptied")
