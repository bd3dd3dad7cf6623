"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Every text becomes counts of hashed byte trigrams, pairs of character classes
and words that repeat the one before.  The labelled rows of a bounded sample give the latent space, a
truncated singular value decomposition of their log-weighted counts, and their
vectors in it are the voters.  They are sent to every task (at most
``MAX_VOTERS`` rows of ``DIMS`` numbers, under 1 MB) and each document takes exact
cosine products with all of them, block by block.  The ``NEIGHBOURS`` nearest
vote with a weight that falls with distance.

Inputs of a score are text only.  Defined results: null and empty texts have an
all-zero vector and get the share of label 1 among the voters; labels that are
null or conflict for a document are averaged; documents without an id are scored
and never learnt from; extra columns are ignored.  Without any usable label every
score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096  # hashed trigram counts of a text
CLASSES = 10  # character classes; their pairs are the style part
DIMS = 64  # latent dimensions
MAX_VOTERS = 3000  # labelled rows that vote, chosen by hash of the id
NEIGHBOURS = 15
THRESHOLD = 0.3

STYLE = BUCKETS + CLASSES * CLASSES
WIDTH = STYLE + 2  # and words that differ from, or repeat, the one before
_PARTS = ((slice(0, BUCKETS), 1.0), (slice(BUCKETS, STYLE), 1.0), (slice(STYLE, WIDTH), 1.0))

# Character class of a byte: lower, upper, digit, space, line end, sentence marks, quotes, brackets, other signs, high bytes.
_CLASS = np.full(256, 8, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 9
for _k, _chars in ((3, " \t"), (4, "\r\n"), (5, ".,;:?"), (6, "\"'`"), (7, "()[]{}<>")):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_PIECE = 1 << 20


def counts(text: str | None) -> np.ndarray:
    """Trigram and class-pair counts of a whole text, read in pieces of a megabyte."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float64)
    for lo in range(0, len(data), _PIECE):
        a = np.frombuffer(data[lo : lo + _PIECE + 2], np.uint8)
        cls, a = _CLASS[a], a.astype(np.uint32)
        if len(a) > 2:
            h = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
            h = (h * np.uint32(2654435761)) >> np.uint32(20)
            out[:BUCKETS] += np.bincount(h, minlength=BUCKETS)
        if len(a) > 1:
            out[BUCKETS:STYLE] += np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
    words = data.split()
    out[WIDTH - 1] = sum(map(eq, words, words[1:]))
    out[WIDTH - 2] = len(words) - out[WIDTH - 1]
    return out


def weighted(rows: np.ndarray) -> np.ndarray:
    """Every part on a square-root scale of shares, each of length one."""
    out = np.empty_like(rows, dtype=np.float32)
    for part, weight in _PARTS:
        x = np.sqrt(rows[:, part])
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[:, part] = weight * x / np.where(norm > 0, norm, 1)
    return out


@dataclass
class Model:
    """Latent space and voters; ``prior`` is the share of label 1."""

    mean: np.ndarray
    basis: np.ndarray
    voters: np.ndarray
    votes: np.ndarray
    prior: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        x = (weighted(rows) - self.mean) @ self.basis
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.votes):
            return np.full(len(rows), self.prior)
        cosine = self.project(rows) @ self.voters.T
        k = min(NEIGHBOURS, len(self.votes))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        close = np.take_along_axis(cosine, near, axis=1).astype(np.float64)
        weight = np.exp(8 * (close - close.max(axis=1, keepdims=True)))
        out = (weight * self.votes[near]).sum(axis=1) / weight.sum(axis=1)
        return np.where(rows.sum(axis=1) > 0, np.clip(out, 0, 1), self.prior)


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Latent space by an eigendecomposition of the sample's own covariance."""
    if not len(labels):
        return Model(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = weighted(rows)
    mean = x.mean(axis=0)
    rng = np.random.default_rng(0)
    y = (x - mean) @ rng.standard_normal((WIDTH, min(DIMS + 16, WIDTH))).astype(np.float32)
    for _ in range(3):  # subspace iteration of the randomised decomposition
        y, _ = np.linalg.qr((x - mean) @ ((x - mean).T @ y))
    _, _, vt = np.linalg.svd(y.T @ (x - mean), full_matrices=False)
    basis = np.ascontiguousarray(vt[:DIMS].T, dtype=np.float32)
    model = Model(mean.astype(np.float32), basis, np.zeros((0, 1), np.float32), np.zeros(0), float(labels.mean()))
    model.voters, model.votes = model.project(rows).astype(np.float32), labels.astype(np.float64)
    return model


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_voters: int = MAX_VOTERS) -> Model:
    """Fit on at most ``max_voters`` labelled rows outside the held-out fifth."""
    marked = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
              .agg(F.avg(F.col("quality").cast("double")).alias("quality")).filter(~held_out("doc_id")))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                packed = [zlib.compress(counts(t.as_py()).astype(np.float32).tobytes(), 1) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["doc_id", "quality", "c"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
            .mapInArrow(run, "doc_id long, quality double, c binary").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas())
    data = [np.frombuffer(zlib.decompress(c), np.float32) for c in rows["c"]]
    x = np.array(data, np.float32) if data else np.zeros((0, WIDTH), np.float32)
    del data
    use = x.sum(axis=1) > 0
    return fit(x[use], rows["quality"].to_numpy(float)[use])


def score_texts(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``score`` of the column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.select(*columns, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = np.array([counts(t.as_py()) for t in part.column(len(columns))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(m.score(x), pa.float64())], [*columns, "score"])

    return keep.mapInArrow(run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), "score double"]))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    scored = score_texts(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
