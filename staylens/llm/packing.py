"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity`` tokens. The pieces are dealt to partitions of bounded size and
each partition is packed by best-fit decreasing. Dual feasible functions give a lower bound on the bins that any packing
of that partition needs. A partition that meets its bound, with less room left than a bin, is certified and keeps its
bins but for the one that is filled least; other partitions give back all bins with room to spare, since the pieces of
others may fit there. What was given back is exchanged, dealt anew and packed again, until one partition is left or a
round saves nothing.

Cases: null or empty texts are one piece (the end id alone); documents without an id and repeated rows are packed like
any others; an empty table gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.scan import list_array, map_batches, runs, scan, text_bytes
from staylens.llm.stored import Scratch
from staylens.llm.subwords import default_path, encoder

CAPACITY = 4096
# Pieces in a partition; bounds the memory of a packing task.
PIECES = 40_000
# A bin with at most this share of room left counts as full when a partition has a gap.
ROOM = 0.002
END_ID = 1


def tokenize(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    path = path or default_path()

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        doc_ids = batch.column(0)
        data, offsets = text_bytes(batch.column(1))
        for a, b in runs(offsets):
            raw = data[offsets[a] : offsets[b]]
            words = scan(raw, offsets[a : b + 1] - offsets[a])
            ids, word_bounds = encode.of_words(words, raw)
            bounds = word_bounds[words.bounds]
            rows = []
            for d in range(b - a):
                own = np.append(ids[bounds[d] : bounds[d + 1]], np.uint32(END_ID)).astype("<u4")
                for piece, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((a + d, piece, at, len(part), zlib.crc32(part.tobytes()), part if with_ids else None))
            cols = list(zip(*rows))
            out = [doc_ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = pa.array(np.concatenate(cols[5]).astype(np.int32), pa.int32())
                out.append(list_array(flat, np.concatenate(([0], np.cumsum(cols[3])))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_batches(docs.select("doc_id", "text"), over, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions, and their sums."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    # Sizes above capacity - e become whole bins, sizes below e vanish.
    many, much = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * size)))
    e = np.arange(0, capacity // 2 + 1)
    whole = many[-1] - many[capacity - e + 1]
    between = much[capacity - e + 1] - much[e]
    best = max(best, int((whole + -(-between // capacity)).max()))
    # Sizes become multiples of 1/k, rounded down, unless they are an exact multiple of capacity / (k + 1).
    for k in range(1, 33):
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin."""
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offset, np.array(fill, np.int64)


def _packer(capacity: int, turn: int, room: float):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy().astype(np.int64)
        bins, offset, fill = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if len(fill) == bound and len(fill) * capacity - lengths.sum() < capacity:
            back = np.zeros(len(fill), bool)
            back[int(fill.argmin())] = fill.min() < capacity
        else:
            back = fill < capacity * (1 - room)
        sequence = (np.int64(turn) << 56) + (np.int64(key[0].as_py()) << 24) + bins
        out = rows.drop_columns(["__part"])
        out = out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        out = out.append_column("__back", pa.array(back[bins]))
        return out.append_column("__first", pa.array(offset == 0))

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES, rounds: int = 8, room: float = ROOM) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    ``rounds`` bounds the exchanges; every row has a valid place after each of them.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    todo, left = scratch.put(pieces), []
    rows, kinds, last = todo.count(), pieces.schema, None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    for turn in range(rounds):
        parts = max(1, -(-rows // per_task))
        # Any dealing will do; the place of a row in a stored table does not change when a task is run again.
        dealt = todo.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)))
        packed = scratch.put(
            dealt.groupBy("__part").applyInArrow(_packer(capacity, turn, room), f"{fields}, sequence_id long, offset long, __back boolean, __first boolean")
        )
        back = F.col("__back")
        now = packed.agg(F.sum(F.when(back, 1)).alias("rows"), F.sum(F.when(back & F.col("__first"), 1)).alias("bins")).first()
        if last is not None:
            total = packed.where("__first").count()
            if total >= (last["bins"] or 0):
                break
        left.append(packed)  # a round without a saving is not kept: the one before has a place for its rows
        rows, last = now["rows"] or 0, now
        if not rows or parts == 1:
            break
        todo = packed.where(back).select(*pieces.columns)
    names = [*pieces.columns, "sequence_id", "offset"]
    out = None
    for i, packed in enumerate(left):
        kept = (packed if i == len(left) - 1 else packed.where(~F.col("__back"))).select(*names)
        out = kept if out is None else out.unionByName(kept)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the place in it that each was packed into."""
    return pack(tokenize(docs, capacity, path, with_ids), capacity)
