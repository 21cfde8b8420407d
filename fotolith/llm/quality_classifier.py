"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed: words, word shapes (runs of upper case, lower case, digits or one other character), pairs of shapes,
and whether a word repeats the one before. A text is the square roots of its term shares (so length doesn't matter),
weighted by inverse document frequency, which is counted over all documents. A singular value decomposition of the
labelled sample gives the latent axes. The sample's vectors and labels are broadcast (``sample`` rows of ``dims``
floats: at most 2 MB by default, whatever the input), every document is scored by exact cosine products in blocks, and
its ``neighbours`` nearest vote with their similarity.

Only the training sample is bounded: at most ``sample`` labelled rows, the first by hash of doc_id, half of either
label if there are enough. Labels, language, source and doc_id are not inputs of a score.

Defined results: null texts count as empty; a text without terms, or with no similar neighbour, gets the share of label
1 among the sample; without any labels that is 0.5. Labels other than 0 and 1, null labels and labels of unknown
documents are not used; of several labels of a document the smallest counts, of several texts of a labelled doc_id the
smallest is learned from. Repeated rows give a row each; ties among neighbours go to the earlier in the sample. Very
long texts are read whole. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.llm import textkernel as tk

_WORDS, _SHAPES, _PAIRS = 1024, 512, 512
DIMS_RAW = _WORDS + _SHAPES + _PAIRS
_ROWS = 256
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[0x80:], _KIND[48:58] = 65, 97, 97, 48


@dataclass(frozen=True)
class Settings:
    sample: int = 4000
    dims: int = 64
    neighbours: int = 25
    threshold: float = 0.3
    seed: int = 13


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every term found, with repetition."""
    buf, offs = tk.flat(column)
    starts, ends, row = tk.runs(tk.NOT_SPACE[buf], offs)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = tk.Prefix(tk.LOWER[buf]).ranges(starts, ends)
    kind = _KIND[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    at = np.concatenate([[0], np.cumsum(new)])
    shapes = tk.Prefix(kind[new]).ranges(at[starts], at[ends])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    shapes = tk.mix(shapes + again.astype(np.uint64))
    pairs, two = tk.windows(shapes, row, 2)
    parts = ((row, words, 0, _WORDS), (row, shapes, _WORDS, _SHAPES), (row[pairs], two, _WORDS + _SHAPES, _PAIRS))
    return np.concatenate([p[0] for p in parts]), np.concatenate([(p[1] >> np.uint64(40)).astype(np.int64) % p[3] + p[2] for p in parts])


def features(column: pa.Array) -> np.ndarray:
    """Square roots of term shares, a row for each text."""
    row, term = terms(column)
    n = len(column)
    counts = np.bincount(row * DIMS_RAW + term, minlength=n * DIMS_RAW).reshape(n, DIMS_RAW).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, _ROWS):
            yield from tk.slices(whole.slice(k, _ROWS), "text", 1 << 20)


@tk.tidy
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = np.zeros(DIMS_RAW, np.int64), 0
    for batch in _small(batches):
        row, term = terms(batch.column("text"))
        found += np.bincount(np.unique(row * DIMS_RAW + term) % DIMS_RAW, minlength=DIMS_RAW)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(range(DIMS_RAW + 1), pa.int32()), pa.array(np.append(found, n))], names=["term", "n"])


@tk.tidy
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        x = features(batch.column("text")).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])


@dataclass
class Model:
    weights: np.ndarray  # terms
    axes: np.ndarray  # terms x dims
    vectors: np.ndarray  # sample x dims, of length one
    labels: np.ndarray
    prior: float
    neighbours: int

    def score(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if not len(self.vectors):
            return np.full(n, self.prior)
        x = _unit((features(column) * self.weights) @ self.axes)
        near = x @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        # ties at the edge go to the earlier: similarities are compared with the place as the last word
        order = np.argpartition(-near, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(near, order, 1).min(1, keepdims=True)
        inside = near > edge
        tied = near == edge
        keep = inside | (tied & (np.cumsum(tied, 1) <= k - inside.sum(1, keepdims=True)))
        vote = np.where(keep, np.maximum(near, 0), 0).astype(np.float64) ** 2
        total = vote.sum(1)
        return np.where(total > 0, (vote @ self.labels) / np.maximum(total, 1e-12), self.prior)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def train(documents: DataFrame, labels: DataFrame, usable: Column | None = None, settings: Settings | None = None) -> Model:
    """Fits on labelled rows of documents (doc_id, text) for which ``usable`` (on doc_id) holds."""
    s = settings or Settings()
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    counts = dict(documents.select(text).mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())  # one row a term
    n = counts.get(DIMS_RAW, 0)
    weights = np.array([np.log((n + 1) / (counts.get(i, 0) + 1)) + 0.1 for i in range(DIMS_RAW)], np.float32)
    known = labels.where("quality in (0, 1) and doc_id is not null")
    known = known.where(usable) if usable is not None else known
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    ranked = known.withColumn("r", F.xxhash64("doc_id"))
    chosen = []
    for y, other in ((0, 1), (1, 0)):
        own = ranked.where(F.col("y") == y).orderBy("r", "doc_id").limit(s.sample).select("doc_id", "y").collect()
        chosen.append(own)
    half = s.sample // 2
    take = [min(len(c), max(half, s.sample - len(o))) for c, o in ((chosen[0], chosen[1]), (chosen[1], chosen[0]))]
    rows = [tuple(r) for c, k in zip(chosen, take, strict=True) for r in c[:k]]
    if not rows:
        return Model(weights, np.zeros((DIMS_RAW, 1), np.float32), np.empty((0, 1), np.float32), np.empty(0), 0.5, s.neighbours)
    sample = spark.createDataFrame(rows, "doc_id long, y int")  # at most s.sample rows
    joined = documents.select(F.col("doc_id").cast("long"), text).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = sorted((r.doc_id, r.y, bytes(r.x)) for r in joined.mapInArrow(_vectors, "doc_id long, y int, x binary").collect())
    if not got:
        return Model(weights, np.zeros((DIMS_RAW, 1), np.float32), np.empty((0, 1), np.float32), np.empty(0), 0.5, s.neighbours)
    x = np.stack([np.frombuffer(r[2], np.float16) for r in got]).astype(np.float32) * weights
    y = np.array([r[1] for r in got], np.float64)
    _, vecs = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(vecs[:, ::-1][:, : s.dims], np.float32)
    return Model(weights, axes, _unit(x @ axes), y, float(y.mean()), s.neighbours)


@tk.tidy
def _score(batches: Iterator[pa.RecordBatch], model, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.value.score(batch.column("text")))], names=[*keep, "score"])


def score(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the score of each row's text."""
    bc = documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    rows = documents.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _score(it, bc, keep), schema)
