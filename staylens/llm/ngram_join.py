"""Jaccard self-join of documents on word n-grams by universe partitions and the pigeonhole principle.

A document is the set of its distinct ``n``-word shingles. Sizes fall into bands whose ratio is the threshold, so the two
sides of a link are in one band or in neighbouring ones; each document takes part in its own band and, as the larger
side, in the band below. If the smaller side of a link has at most s shingles, both sets differ in at most
``s (1 - t) / t`` of them. A band hashes the universe of shingles into one segment more than that, so that at least one
segment holds the same subset on both sides: each document is indexed under the hash of each of its subsets.

Costs decide where the budget goes. The collisions of each segment are counted over all documents; a segment whose
subsets collide far more often than others of its band gets nothing, and the cheapest segment of the band gets two units
for it: there the subset and all subsets short of one shingle are indexed, which finds any pair that differs in at most
one shingle of that segment. The units of a band always exceed the difference allowed by one.

Candidates whose sizes or parity sketches rule a link out are left out, the others are verified exactly on
their texts, links become components. Equal sets are one class throughout.

Cases: null texts and texts without words have an empty set, link with nothing and are their own component; fewer words
than ``n`` make one shingle of the whole sequence. Repeated rows count once for each doc_id; rows without doc_id are
left out. Ties of nothing: the component is the smallest doc_id. Further columns are not looked at. An empty table gives
an empty result. Shingles are told apart by 64-bit hashes within a document and sets by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.links import HOT_SHARE, linked_components, star_members
from staylens.llm.scan import CHUNK_BYTES, list_array, map_batches, mix, packed_texts, parity_sketches, runs, scan, segment_sums, shingles, signed, text_bytes, wide_jaccard_possible, wide_sketches
from staylens.llm.stored import Scratch

_U = np.uint64


class Bands:
    """Size bands for a threshold: lower edges, and the units (allowed difference plus one) of each band."""

    def __init__(self, threshold: Fraction, largest: int):
        edges = [1]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, math.floor(edges[-1] / threshold) + 1))
        self.edges = np.array(edges, np.int64)
        top = self.edges[1:] - 1
        t = threshold
        self.units = np.array([int(int(s) * (1 - t) / t) + 1 for s in top], np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1


def _subset_keys(flat: np.ndarray, bounds: np.ndarray, band: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the subset in each segment, for documents with a band and its units; and bounds by document."""
    at = np.concatenate(([0], np.cumsum(units)))
    owner = np.repeat(np.arange(len(units)), np.diff(bounds))
    segment = ((mix(flat) >> _U(32)) * units[owner].astype(_U)) >> _U(32)
    slot = at[owner] + segment.astype(np.int64)
    order = np.argsort(slot, kind="stable")
    edges = np.searchsorted(slot[order], np.arange(at[-1] + 1))
    return segment_sums(mix(flat ^ _U(0x5851F42D4C957F2D))[order], edges), at


def documents_as_sets(docs: DataFrame, n: int, threshold: Fraction, largest: int) -> DataFrame:
    """doc_id, size of the set, 128-bit hash of the set, and the subset keys of its own band and of the one below."""
    bands = Bands(threshold, largest)

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(1))
        for a, b in runs(offsets):
            flat, bounds = shingles(scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), n)
            size = np.diff(bounds)
            high, low = (segment_sums(mix(flat ^ _U(salt)), bounds) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
            band = bands.of(np.maximum(size, 1))
            columns = []
            for b_of in (band, band - 1):
                units = np.where((size > 0) & (b_of >= 0), bands.units[np.maximum(b_of, 0)], 0)
                keys, at = _subset_keys(flat, bounds, b_of, np.maximum(units, 1))
                keep = np.repeat(units > 0, np.diff(at))
                columns.append(list_array(pa.array(signed(keys[keep])), np.concatenate(([0], np.cumsum(units)))))
            sketch = np.concatenate((size.astype(np.int64)[:, None], signed(parity_sketches(flat, bounds))), axis=1)
            wide = wide_sketches(flat, bounds)
            both = [x for pair in zip(sketch, map(signed, wide)) for x in pair]
            sketch = list_array(pa.array(np.concatenate(both)), np.concatenate(([0], np.cumsum([5 + len(w) for w in wide]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(size), pa.array(signed(high)), pa.array(signed(low)), pa.array(band.astype(np.int32)), *columns, sketch],
                names=["doc_id", "n_shingles", "high", "low", "band", "own", "below", "sketch"],
            )

    schema = "doc_id long, n_shingles long, high long, low long, band int, own array<long>, below array<long>, sketch array<long>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null"), over, schema)


def deletions(docs: DataFrame, n: int, threshold: Fraction, largest: int, chosen: set[tuple[int, int]]) -> DataFrame:
    """Keys of the chosen (band, segment): the subset of each document there, and each subset short of one shingle."""
    bands = Bands(threshold, largest)

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        for a, b in runs(offsets):
            flat, bounds = shingles(scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), n)
            rows = []
            for d in range(b - a):
                own = flat[bounds[d] : bounds[d + 1]]
                top = int(bands.of(np.array([max(len(own), 1)]))[0])
                for band in (top, top - 1) if len(own) else ():
                    if band < 0:
                        continue
                    place = ((mix(own) >> _U(32)) * _U(bands.units[band])) >> _U(32)
                    part = mix(own ^ _U(0x5851F42D4C957F2D))
                    for segment in (s for c, s in chosen if c == band):
                        here = part[place == _U(segment)]
                        total = here.sum(dtype=_U)
                        for key in {int(total), *(int(x) for x in total - here)}:
                            rows.append((int(ids[a + d]), band, segment, key))
            if rows:
                doc, band, segment, key = (list(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(band, pa.int32()), pa.array(segment, pa.int32()), pa.array(signed(np.array(key, _U)))],
                    names=["item", "band", "segment", "key"],
                )

    return map_batches(docs.select("doc_id", "text"), over, "item long, band int, segment int, key long")


def allocate(loads: list[tuple[int, int, int, int]], units: dict[int, int]) -> tuple[set, set]:
    """Segments to leave out and segments to index with one-deletion neighbourhoods.

    ``loads``: (band, segment, pairs that collide, index rows a neighbourhood adds), for segments with collisions. The
    dearest segment of a band trades its unit with the cheapest one as long as that saves more than it adds.
    """
    out, two = set(), set()
    by_band: dict[int, list[tuple[int, int, int]]] = {}
    for band, segment, pairs, rows in loads:
        by_band.setdefault(band, []).append((pairs, segment, rows))
    for band, own in by_band.items():
        seen = {s for _, s, _ in own}
        mean_rows = max(r for _, _, r in own)
        free = [(0, s, mean_rows) for s in range(units[band]) if s not in seen]
        line = sorted(own + free)
        usual = line[len(line) // 2][0]
        low, high = 0, len(line) - 1
        while low < high:
            cheap, dear = line[low], line[high]
            # Near copies collide in most segments alike, and a component is found without its pairs.
            if dear[0] <= 4 * (cheap[0] + cheap[2]) or dear[0] <= 4 * usual:
                break
            out.add((band, dear[1]))
            two.add((band, cheap[1]))
            low, high = low + 1, high - 1
    return out, two


def verifier(docs: DataFrame, n: int, threshold: Fraction):
    """Keep of a table (a, b) the pairs whose sets of shingles reach the threshold, from the texts themselves."""
    up, down = threshold.numerator, threshold.denominator

    def cut(held: list[bytes]) -> Iterator[np.ndarray]:
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in held], dtype=np.int64)))
        flat, bounds = shingles(scan(np.frombuffer(b"".join(held), np.uint8), offsets), n)
        for d in range(len(held)):
            yield flat[bounds[d] : bounds[d + 1]]

    def sets(blobs: pa.Array) -> Iterator[np.ndarray]:
        """Sets of the rows in their order; no more texts are opened at once than make a run."""
        open_up, held, size = zstandard.ZstdDecompressor().decompress, [], 0
        for blob in blobs:
            held.append(open_up(blob.as_py()) if blob.is_valid else b"")
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield from cut(held)
                held, size = [], 0
        if held:
            yield from cut(held)

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hubs = pc.dictionary_encode(batch.column(0))
        first = {}
        codes = hubs.indices.to_pylist()
        for row, code in enumerate(codes):
            first.setdefault(code, row)
        texts = batch.column(2).take(pa.array([first[c] for c in range(len(hubs.dictionary))], pa.int64()))
        of_hub = list(sets(texts))
        keep = np.zeros(batch.num_rows, bool)
        for row, own in enumerate(sets(batch.column(3))):
            hub = of_hub[codes[row]]
            if min(len(hub), len(own)) * down < up * max(len(hub), len(own)):
                continue
            both = len(np.intersect1d(hub, own, assume_unique=True))
            keep[row] = both and both * down >= up * (len(hub) + len(own) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    def verify(pairs: DataFrame) -> DataFrame:
        # Repeated rows of one doc_id are one document here: any one of its texts.
        texts = packed_texts(docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null"), ["id"])
        other = pairs.join(texts.withColumnsRenamed({"id": "b", "blob": "text_b"}), "b")
        both = other.join(texts.withColumnsRenamed({"id": "a", "blob": "text_a"}), "a")
        return map_batches(both.select("a", "b", "text_a", "text_b"), over, "a long, b long").distinct()

    return verify


def ngram_join(docs: DataFrame, n: int = 5, threshold: Fraction | float = Fraction(4, 5)) -> tuple[DataFrame, DataFrame]:
    """(links, members) of a Jaccard self-join on distinct ``n``-word shingles.

    ``links``: pairs (a, b) of class representatives that were verified; they connect every two documents that any chain
    of links connects. ``members``: one row per doc_id with n_shingles, class_id (smallest doc_id with an equal set; its
    own if the set is empty) and component_id (smallest doc_id that links reach).
    """
    threshold = Fraction(threshold).limit_denominator(1000)
    scratch = Scratch(docs.sparkSession, "ngram-join")
    # No text of b bytes has more than (b + 1) / 2 words.
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0
    largest = longest // 2 + 1
    units = Bands(threshold, largest).units
    keyed = scratch.put(documents_as_sets(docs, n, threshold, largest))
    # The keys are most of it, and go as soon as it is known who shares them.
    sets = scratch.put(keyed.drop("own", "below"))
    same = ["high", "low", "n_shingles"]
    filled = sets.where("n_shingles > 0")
    classes = scratch.put(filled.groupBy(*same).agg(F.min("doc_id").alias("class_id")))
    standing = classes.select(F.col("class_id").alias("doc_id")).distinct()
    ours = filled.join(standing, "doc_id", "left_semi")

    def marks_of(column: str, shift: int) -> DataFrame:
        return keyed.where("n_shingles > 0").join(standing, "doc_id", "left_semi").select(
            F.col("doc_id").alias("item"), (F.col("band") - shift).alias("band"), F.posexplode(column).alias("segment", "key")
        )

    marks = marks_of("own", 0).unionByName(marks_of("below", 1))
    on = ["band", "segment", "key"]
    some = F.pmod(F.xxhash64("item"), F.lit(HOT_SHARE)) == 0
    members = star_members(marks, on, marks.where(some), scratch)
    scratch.drop(keyed)
    sizes = filled.groupBy("band").agg(F.sum("n_shingles").alias("total"))
    each = members.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    loads = each.groupBy("band", "segment").agg(F.sum(F.col("n") * (F.col("n") + 1) / 2).alias("pairs")).join(F.broadcast(sizes), "band")
    spare = {int(b): int(u) for b, u in enumerate(units)}
    # A row per segment with collisions: bounded by the longest document, not by their number.
    rows = [(r.band, r.segment, int(r.pairs), int(2 * r.total / spare[r.band])) for r in loads.collect()]
    out, two = allocate(rows, spare)
    if out:
        gone = docs.sparkSession.createDataFrame(sorted(out | two), "band int, segment int")
        reps = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
        extra = scratch.put(deletions(reps, n, threshold, largest, two))
        near = star_members(extra, on, extra.where(some), scratch)
        scratch.drop(extra)
        members = members.join(F.broadcast(gone), ["band", "segment"], "left_anti").unionByName(near)
    sketches = ours.select(F.col("doc_id").alias("item"), "sketch").dropDuplicates(["item"])
    links, found = linked_components(members, on, verifier(docs, n, threshold), scratch, sketches, wide_jaccard_possible(threshold))
    classed = (
        sets.select("doc_id", *same)
        .join(classes, same, "left")
        .groupBy("doc_id")
        .agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("class_id", "doc_id")).alias("class_id"))
    )
    classed = classed.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    return links, classed.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
