"""Quality score by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled bad. A document is compressed
once with each; what the bad dictionary needs more than the good one, as a share of both sizes, is its evidence. How
telling evidence is depends on the length of a text and on how far it shrinks at all (endless repeats shrink with any
dictionary), so the calibration, a logistic curve fitted on labelled rows that neither dictionary has seen, takes
evidence together with both and gives a score from 0 to 1.

The fit uses a bounded sample of the labelled rows: per label at most ``rows`` rows, the first by a hash of the id, and of
those at most ``megabytes`` of text, a text that no longer fits being passed over; one half trains the dictionary, the other the curve. Scoring reads every whole text.

Cases: null texts count as empty and are scored like them; rows without doc_id are scored and not held out; if a label
has too few rows to train a dictionary on, every score is the share of label 1 among the labelled rows (0.5 without
any). Repeated rows have equal scores. Several labels of one doc_id count as one row each. Empty tables give empty
results. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.scan import map_batches

ROWS, MEGABYTES = 4_000, 12
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    """Dictionaries, and the curve over standardised features; without dictionaries a constant score."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def curve(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Sizes:
    """Features of texts from their compressed sizes with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            for d in (good, bad)
        ]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([[*(len(c.compress(t)) for c in self.both), len(t)] for t in texts], np.float64).reshape(-1, 3)
        good, bad, whole = sizes.T
        evidence = (bad - good) / (bad + good)
        shrunk, length = np.log((np.minimum(good, bad) + 1) / (whole + 1)), np.log(whole + 1)
        first = [evidence, shrunk, length]
        second = [first[i] * first[j] for i in range(3) for j in range(i, 3)]
        return np.stack([*first, *second, evidence**3, shrunk**3, (bad - good) / (whole + 1)], axis=1)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression with a small ridge by damped Newton steps: weights, means and scales."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate((np.ones((len(x), 1)), (x - mean) / scale), axis=1)
    ridge = np.full(z.shape[1], 0.5)
    ridge[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float(np.logaddexp(0, t).sum() - t @ y + 0.5 * (ridge * w * w).sum())

    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, megabytes: int = MEGABYTES) -> Model:
    """``labels`` has doc_id and the label column (0 or 1)."""
    mark = F.col(f"`{label}`")
    known = labels.select("doc_id", mark.cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rates = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts: dict[int, list[bytes]] = {}
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        kept = some.join(docs.select("doc_id", "text").where("text is not null and text != ''"), "doc_id")
        # A text that does not fit any more is passed over, and those after it are tried.
        own, left = [], megabytes << 20
        size = F.octet_length("text")
        for r in kept.where(size <= left).orderBy(F.xxhash64("doc_id"), "doc_id").select("text").toLocalIterator():
            raw = r["text"].encode()
            if len(raw) <= left:
                left -= len(raw)
                own.append(raw)
        texts[y] = own
    share = rates.get(1, 0) / sum(rates.values()) if rates else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    try:
        good, bad = (zstandard.train_dictionary(DICTIONARY_BYTES, texts[y][::2]).as_bytes() for y in (1, 0))
    except zstandard.ZstdError:  # too little text of a label
        return Model(b"", b"", np.array([np.log(share / (1 - share))]), np.zeros(0), np.ones(0))
    sizes = _Sizes(good, bad)
    rest = {y: texts[y][1::2] for y in (0, 1)}
    x = np.concatenate([sizes(rest[y]) for y in (0, 1)])
    weights, mean, scale = _fit_curve(x, np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])]))
    # The sample may hold the labels in other shares than they have; that comes back through the intercept.
    weights[0] += np.log(share / (1 - share)) - np.log(max(len(rest[1]), 1) / max(len(rest[0]), 1))
    return Model(good, bad, weights, mean, scale)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    if not model.good:
        return model.curve(np.zeros((len(texts), 0)))
    sizes = _Sizes(model.good, model.bad)
    # One text after the other: only one is in memory beside its batch.
    return model.curve(np.concatenate([sizes([(t.as_py() or "").encode()]) for t in texts]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), over, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, whose score reaches the threshold."""
    at = docs.columns.index("text")

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(_scores(model, batch.column(at)) >= threshold))

    return map_batches(docs, over, docs.schema)


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))
