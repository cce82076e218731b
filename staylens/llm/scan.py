"""Word scan over Arrow text columns: one numpy pass over the raw bytes of many documents at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. A-Z are lower-cased, nothing else is changed, so the
bytes of UTF-8 letters stay as they are. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Bytes of text that are looked at together; bounds the memory of a task (a longer document stands alone).
CHUNK_BYTES = 2 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor, shift, multiply)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 40)) * _U(0x9E3779B97F4A7C15))


_BYTE = stream(1, 256)
_PLACE = stream(2, 1 << 12) | _U(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = stream(2, 2 * n) | _U(1)
    return _PLACE


@dataclass
class Words:
    """Words of a run of documents: byte range, document (index in the run) and 64-bit hash of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    docs: int

    @property
    def bounds(self) -> np.ndarray:
        """Index of the first word of each document, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.docs + 1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut documents into consecutive runs of about ``limit`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def scan(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the documents whose texts are ``data[offsets[i]:offsets[i + 1]]``."""
    low = _LOWER[data]
    solid = ~_SPACE[low]
    n = len(low)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    if not len(start):
        return Words(low, start, end, doc, np.zeros(0, _U), len(offsets) - 1)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    value = _BYTE[low[solid]]
    value *= _places(int(size.max()) + 1)[place]
    hashes = np.add.reduceat(value, first)
    hashes += size.astype(_U) * _U(0xD6E8FEB86659FD93)
    return Words(low, start, end, doc, mix(hashes), len(offsets) - 1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each document as sorted hashes, and the bounds of each document.

    A document of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    bounds, weight = words.bounds, stream(3, k) | _U(1)
    count = np.diff(bounds)
    n = max(0, len(words.hash) - k + 1)
    rolled = np.zeros(n, _U)
    for i in range(k):
        rolled += words.hash[i : i + n] * weight[i]
    rolled = mix(rolled)
    parts, sizes = [], np.zeros(words.docs, np.int64)
    for d in range(words.docs):
        c = count[d]
        if c >= k:
            own = np.sort(rolled[bounds[d] : bounds[d + 1] - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif c:
            short = words.hash[bounds[d] : bounds[d + 1]] * weight[:c]
            own = mix(np.array([short.sum() + _U(c)], _U))
        else:
            continue
        parts.append(own)
        sizes[d] = len(own)
    flat = np.concatenate(parts) if parts else np.zeros(0, _U)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum (mod 2^64) of the values between consecutive bounds; 0 where there are none."""
    total = np.concatenate((np.zeros(1, _U), np.cumsum(values, dtype=_U)))
    return total[bounds[1:]] - total[bounds[:-1]]


def parity_sketches(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """256 bits for each set of hashes, as four 64-bit numbers: each element flips one bit.

    Bits in which two sketches differ are never more than elements in which the sets differ.
    """
    sets = len(bounds) - 1
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    place = owner * 256 + (mix(flat ^ _U(0x2545F4914F6CDD1D)) >> _U(56)).astype(np.int64)
    odd = (np.bincount(place, minlength=sets * 256) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(sets, 256), axis=1).view(_U)


# Sets of more elements have a wide sketch too: 256 bits of unlike sets differ in about half of them, however large the sets are.
WIDE_FROM = 512


def wide_sketches(flat: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each set of more than WIDE_FROM hashes a parity sketch of at least a bit an element, and the same folded to half its width."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a <= WIDE_FROM:
            out.append(np.zeros(0, _U))
            continue
        bits = 1 << (b - a - 1).bit_length()
        place = (mix(flat[a:b] ^ _U(0x2545F4914F6CDD1D)) & _U(bits - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=bits) & 1).astype(np.uint8)
        out.append(np.packbits(np.concatenate((odd, odd[: bits // 2] ^ odd[bits // 2 :]))).view(_U))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=_U).view(np.int64)


def list_array(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Arrow list column from flat values and the bounds of each row."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), values)


def jaccard_possible(threshold: Fraction) -> Callable[[Column, Column], Column]:
    """Test of two sketches (size, then parity words): false only if the sets cannot reach the threshold."""
    up, down = threshold.numerator, threshold.denominator

    def test(a: Column, b: Column) -> Column:
        differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])).cast("long") for i in range(1, 5)), F.lit(0).cast("long"))
        sizes = a[0] + b[0]
        return (differ * (down + up) <= sizes * (down - up)) & (F.least(a[0], b[0]) * down >= F.greatest(a[0], b[0]) * up)

    return test


def wide_jaccard_possible(threshold: Fraction) -> Callable[[Column, Column], Column]:
    """``jaccard_possible`` for sketches that are followed by the words of ``wide_sketches``, compared at the smaller width."""
    up, down = threshold.numerator, threshold.denominator
    narrow = jaccard_possible(threshold)

    def test(a: Column, b: Column) -> Column:
        own = [((F.size(x) - 5) * 2 / 3).cast("int") for x in (a, b)]
        n = F.least(*own)
        parts = [F.slice(x, F.when(w == n, 6).otherwise(w + 6), n) for x, w in zip((a, b), own)]
        bits = F.zip_with(*parts, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
        differ = F.aggregate(bits, F.lit(0).cast("long"), lambda total, x: total + x)
        known = (n > 0) & (F.greatest(*own) <= 2 * n)
        return narrow(a, b) & F.when(known, differ * (down + up) <= (a[0] + b[0]) * (down - up)).otherwise(True)

    return test


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch; input rows are only ever seen batch by batch."""

    def over(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(over, schema)


def packed_texts(docs: DataFrame, names: list[str]) -> DataFrame:
    """``names`` and the text as a compressed ``blob``, which is what travels in shuffles."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        # One text at a time: a batch may hold ten thousand.
        blobs = [press(t.as_buffer()) if t.is_valid else None for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(blobs, pa.binary())], names=[*names, "blob"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(docs.select(*[F.col(f"`{c}`") for c in names], "text"), over, f"{kinds}, blob binary")
