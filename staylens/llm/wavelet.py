"""Token ids in files that hold one wavelet matrix each.

Documents become token ids, each with the end id after them, and are put in ascending order of doc_id over files. A file is
a shard: the ids of consecutive documents, about ``SHARD_TOKENS`` of them, as a wavelet matrix. That is one bit plane per
bit of an id, the highest first; in each plane the ids stand in the order that a stable sort by the bit of the plane
before has left them in. A directory of counts per block of ``BLOCK`` bits turns a plane into an index for rank and
select, and with those a file answers, without being unpacked into ids: which id stands at a place (``access``), how often
an id stands before a place (``rank``), and where its k-th occurrence is (``select``). Planes are compressed one by one.

Format of a file (little-endian): the mark ``WVM1``; version, number of planes, two zero bytes; documents, tokens (64 bit each);
then for the document bounds and for each plane the number of its compressed bytes (64 bit each); then those parts as
zstandard frames: bounds as 64-bit differences, planes as bits, eight to a byte, the lowest first, each with the number of
ones before each block as 32-bit numbers in front. The doc_ids stand beside the file's bytes in its row.

Spark's own writer puts each shard's bytes as the only row of one Parquet file, so a file is there only if its task
succeeded, whatever store the folder is in, and a lost executor leaves nothing half written.

Cases: null and empty texts have the end id alone. Repeated rows are documents of their own; rows with one doc_id stand in
the order of their length and checksum, null ids before all others. A document is never cut: one that is longer than a
shard has a file of its own, or the end of one. An empty table gives no file and an empty result. Further columns are not
looked at.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from staylens.llm.scan import list_array, map_batches, runs, scan, text_bytes
from staylens.llm.stored import Scratch
from staylens.llm.subwords import WordEncoder, default_path
from staylens.runtime import broadcast_if_small

END_ID = 1
# Ids in a shard, but for its last document; bounds the memory of a task. Ids of a task that writes shards.
SHARD_TOKENS, PARTITION_TOKENS = 1 << 20, 1 << 25
BLOCK = 2048
LEVEL = 3
# Pieces of words in one text for the library.
LIBRARY_PIECES = 512

_MARK = b"WVM1"
_HEAD = struct.Struct("<4sBB2xqq")


class LibraryEncoder(WordEncoder):
    """Ids of words by the tokenizers library itself, to which a worker gives each distinct piece of words once.

    Pieces (letters, a digit, or other signs in a row) are what merges never cross. Many of them, with spaces between, go
    to the library in one text; each ends with an id that ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        super().__init__(path)
        self.parts = regex.compile(self.pieces.pattern + "|\n")
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.library.get_added_tokens_decoder().values()))
        self.last = self.ends_word()[:-1] == 1
        self.bare = Tokenizer.from_file(path)  # for pieces, which are normalised already
        self.bare.normalizer = normalizers.Sequence([])

    def _forget(self) -> None:
        super()._forget()
        self.known: dict[str, int] = {}
        self.piece_ids, self.piece_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _meet(self, pieces: list[str]) -> None:
        new = [p for p in dict.fromkeys(pieces) if p != "\n" and p not in self.known]
        texts = [" ".join(new[a : a + LIBRARY_PIECES]) for a in range(0, len(new), LIBRARY_PIECES)]
        got = [np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([*got, np.zeros(0, np.uint32)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            raise RuntimeError("the library cut the pieces of words otherwise")
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.piece_at = np.concatenate((self.piece_at, ends + len(self.piece_ids)))
        self.piece_ids = np.concatenate((self.piece_ids, ids))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(words)
        if self.special.search(joined):
            got = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))
        pieces = self.parts.findall(self._normal(joined) + "\n")
        self._meet(pieces)
        place = np.fromiter((self.known.get(p, -1) for p in pieces), np.int64, len(pieces))
        breaks = np.flatnonzero(place < 0)
        place = np.delete(place, breaks)
        size = self.piece_at[place + 1] - self.piece_at[place]
        ends = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(ends[-1]) + np.repeat(self.piece_at[place] - ends[:-1], size)
        return self.piece_ids[take], np.concatenate(([0], ends[breaks - np.arange(len(breaks))]))

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, bounds = self.encode(words)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.at = np.insert(self.at, place, bounds[:-1] + len(self.flat))
        self.sizes = np.insert(self.sizes, place, np.diff(bounds).astype(np.int32))
        self.flat = np.concatenate((self.flat, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def id_type(path: str) -> str:
    """The narrowest type that holds all ids of a vocabulary."""
    return "<u2" if encoder(path).size <= 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32, and its ids with the end id, as bytes of ``id_type``."""
    path = path or default_path()
    narrow = id_type(path)

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        data, offsets = text_bytes(batch.column(1))
        for a, b in runs(offsets):
            raw = data[offsets[a] : offsets[b]]
            words = scan(raw, offsets[a : b + 1] - offsets[a])
            ids, word_bounds = encode.of_words(words, raw)
            bounds = word_bounds[words.bounds]
            ended = np.insert(ids.astype("<u4"), bounds[1:], END_ID)
            counts = np.diff(bounds) + 1
            ends = np.cumsum(counts).tolist()
            wide, thin = ended.tobytes(), ended.astype(narrow).tobytes()
            width = len(thin) // len(ended)
            crc = pa.array([zlib.crc32(wide[4 * x : 4 * y]) for x, y in zip([0, *ends], ends)], pa.int64())
            own = [thin[width * x : width * y] for x, y in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), crc, pa.array(own, pa.binary())], names=["doc_id", "n_tokens", "ids_crc32", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), over, f"doc_id {kind}, n_tokens long, ids_crc32 long, ids binary")


class WaveletMatrix:
    """Bit planes of a sequence of ids with rank and select; positions count from 0."""

    def __init__(self, planes: list[np.ndarray], before: list[np.ndarray], n: int, bounds: np.ndarray):
        self.planes, self.before, self.n, self.bounds = planes, before, n, bounds
        self.zeros = [n - int(c[-1]) for c in before]

    @staticmethod
    def build(ids: np.ndarray, bounds: np.ndarray) -> WaveletMatrix:
        """From ids and the bounds of the documents in them."""
        n, bits = len(ids), max(1, int(ids.max(initial=0)).bit_length())
        at = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, before = [], []
        for k in range(bits - 1, -1, -1):
            bit = at & at.dtype.type(1 << k) != 0
            padded = np.zeros(-(-n // BLOCK) * BLOCK, bool)
            padded[:n] = bit
            planes.append(np.packbits(padded, bitorder="little"))
            ones = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32)
            before.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32))))
            at = np.concatenate((at[~bit], at[bit]))
        return WaveletMatrix(planes, before, n, np.asarray(bounds, np.int64))

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        parts = [pack(np.diff(self.bounds).astype("<i8").tobytes())]
        parts += [pack(c.astype("<u4").tobytes() + p.tobytes()) for p, c in zip(self.planes, self.before)]
        head = _HEAD.pack(_MARK, 1, len(self.planes), len(self.bounds) - 1, self.n)
        return b"".join([head, np.array([len(p) for p in parts], "<i8").tobytes(), *parts])

    @staticmethod
    def from_bytes(data: bytes) -> WaveletMatrix:
        mark, version, n_planes, docs, n = _HEAD.unpack_from(data)
        if mark != _MARK or version != 1:
            raise ValueError("not a wavelet file of version 1")
        sizes = np.frombuffer(data, "<i8", n_planes + 1, _HEAD.size)
        ends = _HEAD.size + sizes.nbytes + np.cumsum(sizes)
        blocks = -(-n // BLOCK)
        unpack = zstandard.ZstdDecompressor().decompress
        parts = [unpack(data[e - s : e], max_output_size=max(8 * docs, 4 * (blocks + 1) + blocks * BLOCK // 8)) for s, e in zip(sizes, ends)]
        bounds = np.concatenate(([0], np.cumsum(np.frombuffer(parts[0], "<i8"))))
        before = [np.frombuffer(p, "<u4", blocks + 1) for p in parts[1:]]
        return WaveletMatrix([np.frombuffer(p, np.uint8, offset=4 * (blocks + 1)) for p in parts[1:]], before, n, bounds)

    def _bit(self, plane: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[plane][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position: the block's count, and those of its bytes before the position."""
        block = at // BLOCK
        own = self.planes[plane].reshape(-1, BLOCK // 8)
        out = self.before[plane][block].astype(np.int64)
        inside = at % BLOCK
        some = np.flatnonzero(inside)
        for a in range(0, len(some), 4096):
            i = some[a : a + 4096]
            rows = own[block[i]]
            places = np.arange(BLOCK // 8)
            whole = inside[i] >> 3
            counts = np.bitwise_count(rows) * (places < whole[:, None])
            last = rows[np.arange(len(i)), whole] & ((1 << (inside[i] & 7)) - 1).astype(np.uint8)
            out[i] += counts.sum(axis=1, dtype=np.int64) + np.bitwise_count(last)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at positions."""
        at = np.asarray(at, np.int64)
        if ((at < 0) | (at >= self.n)).any():
            raise IndexError("position outside of the shard")
        value = np.zeros(len(at), np.uint32)
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, at), self._ones(k, at)
            value = value << np.uint32(1) | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id between two positions stand after the last plane."""
        ends = np.array([start, end], np.int64)
        if token >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            ones = self._ones(k, ends)
            ends = self.zeros[k] + ones if token >> (len(self.planes) - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id stands between two positions."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) bit of that value: its block by the directory, its place within by counting."""
        before = self.before[plane].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        own = self.planes[plane].reshape(-1, BLOCK // 8)
        for a in range(0, len(k), 1024):
            rows = np.unpackbits(own[block[a : a + 1024]], axis=1, bitorder="little") == bit
            nth = (k[a : a + 1024] - before[block[a : a + 1024]] + 1)[:, None]
            out[a : a + 1024] = block[a : a + 1024] * BLOCK + (np.cumsum(rows, axis=1, dtype=np.int32) >= nth).argmax(axis=1)
        return out

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Positions of an id between two positions, ascending."""
        a, b = self._range(token, start, self.n if end is None else end)
        at = np.arange(a, b, dtype=np.int64)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up."""
        value = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(value)
            above[~bit] = value[: self.zeros[k]]
            above[bit] = value[self.zeros[k] :] | value.dtype.type(1 << (len(self.planes) - 1 - k))
            value = above
        return value.astype(np.uint32)


def write_files(docs: DataFrame, folder: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` and write one file per shard into ``folder``, in order of (part, shard)."""
    scratch, narrow = Scratch(docs.sparkSession, "wavelet"), id_type(path or default_path())
    # A stored number keeps apart equal documents of one id, so that ranges can cut between them.
    encoded = scratch.put(encode_documents(docs, path).withColumn("apart", F.xxhash64(F.monotonically_increasing_id())))
    total = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def over(batches):
        from pyspark import TaskContext

        part, shard, before, ids, parts, counts = TaskContext.get().partitionId(), 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), narrow), np.concatenate(([0], np.cumsum(counts))))
            owners = pa.concat_arrays(ids)
            names = ["part", "shard", "before", "n_tokens", "doc_ids", "matrix"]
            where = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([matrix.n], pa.int64())]
            own = list_array(owners, np.array([0, len(owners)]))
            return pa.RecordBatch.from_arrays([*where, own, pa.array([matrix.to_bytes()], pa.binary())], names=names)

        for batch in batches:
            sizes = batch.column(1).to_numpy()
            at = 0
            while at < len(sizes):
                room = shard_tokens - sum(counts)
                to = min(len(sizes), at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), room)))
                ids.append(batch.column(0).slice(at, to - at))
                parts += batch.column(2).slice(at, to - at).to_pylist()
                counts += sizes[at:to].tolist()
                at = to
                if sum(counts) >= shard_tokens:
                    yield close()
                    shard, before, ids, parts, counts = shard + 1, before + sum(counts), [], [], []
        if counts:
            yield close()

    order = ["doc_id", "n_tokens", "ids_crc32", "apart"]
    tasks = min(docs.sparkSession.sparkContext.defaultParallelism, -(-total // shard_tokens))
    ranged = encoded.repartitionByRange(max(1, tasks, -(-total // PARTITION_TOKENS)), *order).sortWithinPartitions(*order)
    shards = ranged.select("doc_id", "n_tokens", "ids").mapInArrow(over, f"part int, shard int, before long, n_tokens long, doc_ids array<{kind}>, matrix binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").mode("errorifexists").parquet(folder)
    scratch.drop(encoded)


def open_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, with the number of ids in all files before it (``first``).

    A file knows what its part holds before it; only the totals of parts, one row per writing task, are added up here.
    """
    files = spark.read.parquet(folder)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return files.join(broadcast_if_small(parts), "part").withColumn("first", F.col("base") + F.col("before"))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = open_files(spark, folder)

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, owners, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            matrix = WaveletMatrix.from_bytes(data.as_py())
            raw, bounds = matrix.ids().astype("<u4"), matrix.bounds
            crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            columns = [owners.values, pa.array(first + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return map_batches(files.select("first", "doc_ids", "matrix"), over, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """Ids at the places (column ``place``: ids of all documents before it), each read from its file's planes.

    Places meet files by the range a file covers: both are cut into cells of a shard's size, and a file is sent to its
    cells once, with the places of a cell as one list. Places outside of the table have no row.
    """
    files = open_files(spark, folder).where("n_tokens > 0")
    last = F.col("first") + F.col("n_tokens") - 1
    cells = F.sequence(F.floor(F.col("first") / SHARD_TOKENS), F.floor(last / SHARD_TOKENS))
    spans = files.select("part", "shard", "first", last.alias("last"), F.explode(cells).alias("cell"))
    asked = places.select(F.col("place").cast("long")).where("place >= 0").distinct()
    asked = asked.withColumn("cell", F.floor(F.col("place") / SHARD_TOKENS))
    met = asked.join(spans, (asked["cell"] == spans["cell"]) & F.col("place").between(F.col("first"), F.col("last")))
    lists = met.groupBy("part", "shard", "first").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, asked_for, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            place = asked_for.values.to_numpy()
            found = WaveletMatrix.from_bytes(data.as_py()).access(place - first)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(found.astype(np.int64))], names=["place", "token"])

    return map_batches(lists.join(files.select("part", "shard", "matrix"), ["part", "shard"]).select("first", "places", "matrix"), over, "place long, token long")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """How often each of the given ids stands in the files, by rank; a sum over files."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data in batch.column(0):
            matrix = WaveletMatrix.from_bytes(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return map_batches(spark.read.parquet(folder).select("matrix"), over, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """All places of the given ids, by select, with the document each stands in."""
    files = open_files(spark, folder)

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, owners, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            matrix = WaveletMatrix.from_bytes(data.as_py())
            for token in tokens:
                at = matrix.occurrences(token)
                doc = np.searchsorted(matrix.bounds, at, "right") - 1
                columns = [pa.array(np.full(len(at), token)), pa.array(first + at), owners.values.take(pa.array(doc))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "place", "doc_id"])

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return map_batches(files.select("first", "doc_ids", "matrix"), over, f"token long, place long, doc_id {kind}")


def round_trip(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the files and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{Scratch(spark, 'wavelet-files').root}/shards"
    write_files(docs, folder, path)
    return read_back(spark, folder)
