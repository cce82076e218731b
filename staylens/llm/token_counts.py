"""Token counts that follow edits.

A document is kept as a tree over segments of a few words each: a leaf has the length and the token count of its segment,
an inner node the sums of its two children. Each segment ends with white space, which tokens never cross. An edit finds
the first and the last segment it touches from the root down by lengths; only those are encoded again, and, where an
edit takes away the white space at a boundary or writes none, the following segment too, whose first word has become
part of another one. Sums change along the way to the root. All other counts stay.

Cases: null texts are empty; a null insertion is an empty one; starts and lengths are cut to what the text has at that
moment, null starts and lengths count as 0; edits of a document apply in order of ``seq``, ties by start, length and
insertion; edits of unknown documents are left out, documents without edits keep their counts; rows without doc_id are
counted and have no edits; repeated rows of a doc_id each get its edits. Empty tables give empty results. Further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.scan import map_batches, runs, scan, segment_sums, text_bytes
from staylens.llm.subwords import WordEncoder, default_path, encoder

LEAF_WORDS = 16
_SPACE = " \t\n\v\f\r"


class SegmentTree:
    """Lengths and token counts of the segments of one text, with sums."""

    def __init__(self, text: str, starts: list[int], counts: list[int], encode: WordEncoder):
        """``starts``: where segments begin, the first one at 0; ``counts``: their tokens."""
        self.encode = encode
        edges = [*starts, len(text)]
        self.parts = [text[a:b] for a, b in zip(edges[:-1], edges[1:])]
        self.leaves = 1 << max(0, len(self.parts) - 1).bit_length()
        self.lengths, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        self.lengths[self.leaves : self.leaves + len(self.parts)] = map(len, self.parts)
        self.tokens[self.leaves : self.leaves + len(counts)] = counts
        for i in range(self.leaves - 1, 0, -1):
            self.lengths[i] = self.lengths[2 * i] + self.lengths[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.encoded = 0

    @property
    def length(self) -> int:
        return self.lengths[1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.parts)

    def _find(self, at: int) -> tuple[int, int]:
        """Segment that holds the character at ``at`` (the last one for the end of the text) and the place in it."""
        node = 1
        while node < self.leaves:
            left = self.lengths[2 * node]
            if at < left or not self.lengths[2 * node + 1]:
                node = 2 * node
            else:
                at, node = at - left, 2 * node + 1
        return node - self.leaves, at

    def _set(self, leaf: int, part: str) -> None:
        self.parts[leaf] = part
        node = leaf + self.leaves
        length = len(part) - self.lengths[node]
        tokens = -self.tokens[node]
        if part:
            tokens += len(self.encode.encode(_words(part))[0])
            self.encoded += len(part)
        while node:
            self.lengths[node] += length
            self.tokens[node] += tokens
            node >>= 1

    def edit(self, start: int, length: int, insert: str) -> None:
        """Put ``insert`` in the place of ``length`` characters from ``start``."""
        start = min(max(start, 0), self.length)
        end = min(start + max(length, 0), self.length)
        first, a = self._find(start)
        last, b = self._find(end)
        part = self.parts[first][:a] + insert + self.parts[last][b:]
        following = last + 1
        while part and part[-1] not in _SPACE and following < len(self.parts):
            # The boundary is gone: what follows begins in the middle of a word now.
            part += self.parts[following]
            following += 1
        for leaf in range(first + 1, following):
            if self.parts[leaf]:
                self._set(leaf, "")
        self._set(first, part)


def _words(part: str) -> list[str]:
    for c in _SPACE[1:]:
        part = part.replace(c, " ")
    return [w for w in part.split(" ") if w]


def _trees(column: pa.Array, encode: WordEncoder) -> Iterator[SegmentTree]:
    """Trees of all texts of a column; words are counted for many texts at once."""
    data, offsets = text_bytes(column)
    for a, b in runs(offsets):
        raw = data[offsets[a] : offsets[b]]
        at = offsets[a : b + 1] - offsets[a]
        words = scan(raw, at)
        _, word_bounds = encode.of_words(words, raw)
        sizes = np.diff(word_bounds).astype(np.uint64)
        # Characters before each byte, so that segments can be cut from text.
        before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        bounds, blob = words.bounds, raw.tobytes()
        for d in range(b - a):
            lo, hi = bounds[d], bounds[d + 1]
            heads = np.arange(lo, hi, LEAF_WORDS)
            counts = segment_sums(sizes[lo:hi], np.append(heads, hi) - lo).astype(int).tolist() if len(heads) else [0]
            starts = (before[words.start[heads]] - before[at[d]]).tolist() if len(heads) else [0]
            yield SegmentTree(blob[at[d] : at[d + 1]].decode(), [0, *starts[1:]], counts, encode)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row."""
    path = path or default_path()

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = [tree.count for tree in _trees(batch.column(1), encoder(path))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), over, f"doc_id {kind}, n_tokens long")


def counts_after_edits(docs: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Counts of every row of ``docs`` before and after its edits (doc_id, seq, start, length, insert).

    Returns doc_id, n_edits, tokens_before, n_tokens, n_chars and encoded_chars: what edits made the tree encode again.
    """
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def press(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        blobs = [shrink((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["doc_id", "blob"])

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        texts = pa.array([grow(x).decode() for x in batch.column(1).to_pylist()], pa.string())
        rows = []
        for tree, steps in zip(_trees(texts, encoder(path)), batch.column(2).to_pylist()):
            before = tree.count
            for e in steps or ():
                tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
            rows.append((len(steps or ()), before, tree.count, tree.length, tree.encoded))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_edits", "tokens_before", "n_tokens", "n_chars", "encoded_chars"])

    blobs = map_batches(docs.select("doc_id", "text"), press, f"doc_id {kind}, blob binary")
    step = F.struct(*[F.col(c) for c in ("seq", "start", "length", "insert")])
    by_doc = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(step)).alias("edits"))
    joined = blobs.join(by_doc, "doc_id", "left").select("doc_id", "blob", "edits")
    return map_batches(joined, over, f"doc_id {kind}, n_edits long, tokens_before long, n_tokens long, n_chars long, encoded_chars long")


def edits_by_rule(docs: DataFrame, per_document: int = 3) -> DataFrame:
    """Edits whose places, lengths and insertions follow from the row: insertions repeat a part of the text itself."""
    size = F.length(F.coalesce("text", F.lit("")))

    def draw(i: int, k: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(i), F.lit(k)), F.lit(1 << 30))

    steps = [
        F.struct(
            F.lit(i).alias("seq"),
            F.pmod(draw(i, 0), size + 1).cast("int").alias("start"),
            F.pmod(draw(i, 1), F.lit(60)).cast("int").alias("length"),
            F.substring(F.coalesce("text", F.lit("")), (F.pmod(draw(i, 2), size + 1) + 1).cast("int"), F.pmod(draw(i, 3), F.lit(40)).cast("int")).alias("insert"),
        )
        for i in range(per_document)
    ]
    return docs.select("doc_id", F.explode(F.array(*steps)).alias("e")).select("doc_id", "e.*")
