"""Interaction audit of five text filters by wide packed counters.

A document fails a set of filters, a mask of five bits. Under each of the 120 orders the mask settles what happens at each
of the 5 steps, so 32 big integers hold all there is to say: each has one 64-bit field for every outcome of every one of
the 600 steps, set to 1 where the outcome is that of the mask. Tasks add the integers of their documents up, one running
sum for each part; sums of tasks are added in two streaming exchanges, and the last one unpacks the fields. No table has
2^63 rows, so no field ever carries into its neighbour.

The text of a document stays where it is read: what is shuffled is its mask, its part and a 256-bit digest of the text,
by which filter E finds the smallest id that has the same text.

Cases: a null text is empty, a null part (``lang``) is the empty string and one part with it. Rows with the same smallest
id do not fail filter E on each other, rows without an id fail it never (and make no other row fail it), and have no
labels. Every row counts, repeated ones too. Several labels of one document count as label 1 if any of them is 1. Documents
without labels are neither good nor toxic. An empty table has no parts and gives an empty result. Further columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.scan import map_batches
from staylens.llm.stored import Scratch

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 100, 80, 10, b"#$%&*|"
# Outcomes of a step. The last two count documents with that label.
OUTCOMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
FIELD_BYTES = 8
# Parts whose sums a task holds at once; beyond that it hands them on and starts anew.
PARTS_AT_ONCE = 256

_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def text_mask(text: str) -> tuple[int, bytes]:
    """Bits of the filters A to D that a text fails, and the digest by which equal texts are found."""
    raw = text.encode()
    words = raw.split()  # bytes are split at 0x20 and 0x09-0x0D, and at nothing else
    upper = len(raw) - len(raw.translate(None, _UPPER))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * upper > UPPER_PERCENT * len(text),
        len(raw.translate(None, MARKS)) < len(raw),
    )
    return sum(bit << i for i, bit in enumerate(fails)), hashlib.sha256(raw).digest()


def text_masks(docs: DataFrame) -> DataFrame:
    """One row per document: id, part, mask of A to D, digest of the text."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        masks, keys = [], []
        for text in batch.column(2):
            mask, key = text_mask(text.as_py() or "")
            masks.append(mask)
            keys.append(key)
        part = batch.column(1).cast(pa.string()).fill_null("")
        yield pa.RecordBatch.from_arrays([batch.column(0), part, pa.array(masks, pa.int32()), pa.array(keys, pa.binary())], names=["doc_id", "part", "mask", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("lang").cast("string"), "text")
    return map_batches(rows, over, f"doc_id {kind}, part string, mask int, key binary")


def full_masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document: part, mask of all filters, and whether it is labelled good and toxic.

    Both joins meet stored tables of one row per key, so that Spark can split a key that many documents have.
    """
    rows = scratch.put(text_masks(docs))
    first = scratch.put(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1").drop("n"))
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id")
    flags = scratch.put(label.agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]))
    copies = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    joined = rows.join(first, "key", "left").select("doc_id", "part", (F.col("mask") + copies).alias("mask"))
    return joined.join(flags, "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def packed(mask: int, good: bool, toxic: bool) -> int:
    """The integer of a mask: fields in the order of ``ORDERS``, steps, ``OUTCOMES``, the first one lowest."""
    fields = np.zeros((len(ORDERS), STEPS, len(OUTCOMES)), "<u8")
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails = bool(mask & bit)
            removed = fails and not gone
            fields[o, s] = (not gone and not fails, removed, fails and gone, mask == bit, removed and good, removed and toxic)
            gone = gone or fails
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counts by order, step and outcome."""
    shape = (len(ORDERS), STEPS, len(OUTCOMES))
    return np.frombuffer(total.to_bytes(int(np.prod(shape)) * FIELD_BYTES, "little"), "<u8").reshape(shape).astype(np.int64)


def _sums(parts: dict[str, int]) -> pa.RecordBatch:
    size = len(ORDERS) * STEPS * len(OUTCOMES) * FIELD_BYTES
    totals = [v.to_bytes(size, "little") for v in parts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), pa.array(totals, pa.binary())], names=["part", "total"])


def _add(parts: dict[str, int], part: str, value: int) -> Iterator[pa.RecordBatch]:
    if part not in parts and len(parts) >= PARTS_AT_ONCE:
        yield _sums(parts)
        parts.clear()
    parts[part] = parts.get(part, 0) + value


def sum_masks(masks: DataFrame) -> DataFrame:
    """Sum of the documents' integers, one row for each part of each input partition (or more, with very many parts)."""

    def over(batches):
        integers = {case: packed(*case) for case in ((m, g, t) for m in range(1 << STEPS) for g in (False, True) for t in (False, True))}
        parts: dict[str, int] = {}
        for batch in batches:
            counts = pa.Table.from_batches([batch]).group_by(["part", "mask", "good", "toxic"]).aggregate([([], "count_all")])
            for row in counts.to_pylist():
                yield from _add(parts, row["part"], row["count_all"] * integers[row["mask"], row["good"], row["toxic"]])
        if parts:
            yield _sums(parts)

    return masks.mapInArrow(over, "part string, total binary")


def add_up(sums: DataFrame) -> DataFrame:
    """Sums of a partition added part by part, row after row, whatever their number."""

    def over(batches):
        parts: dict[str, int] = {}
        for batch in batches:
            for part, total in zip(batch.column(0), batch.column(1)):
                yield from _add(parts, part.as_py(), int.from_bytes(total.as_py(), "little"))
        if parts:
            yield _sums(parts)

    return sums.mapInArrow(over, "part string, total binary")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step with the counts of all outcomes and the filter's share over all orders."""
    scratch = Scratch(docs.sparkSession, "filter-audit")
    sums = scratch.put(sum_masks(full_masks(docs, labels, scratch)))
    # One row per part and task; a square root of them is added up first, so that no task reads the sums of all tasks.
    n = max(1, int(sums.count() ** 0.5))
    some = add_up(sums.repartition(n, "part", F.pmod(F.xxhash64("total"), F.lit(n))))

    letter = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    orders, steps = [order for order in ORDERS for _ in range(STEPS)], np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))

    def rows_of(part: str, total: int) -> pa.RecordBatch:
        counts = unpacked(total).reshape(-1, len(OUTCOMES))
        shapley = np.zeros(STEPS, np.int64)
        np.add.at(shapley, letter, counts[:, OUTCOMES.index("removed")])
        columns = [pa.array([part] * len(orders), pa.string()), pa.array(orders), pa.array(steps), *map(pa.array, counts.T.copy()), pa.array(shapley[letter])]
        return pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *OUTCOMES, "shapley"])

    def over(batches):
        at, value = None, 0
        for batch in batches:
            for part, total in zip(batch.column(0), batch.column(1)):
                if part.as_py() != at and at is not None:
                    yield rows_of(at, value)
                    value = 0
                at = part.as_py()
                value += int.from_bytes(total.as_py(), "little")
        if at is not None:
            yield rows_of(at, value)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*OUTCOMES, "shapley"])
    return some.repartition("part").sortWithinPartitions("part").mapInArrow(over, schema)
