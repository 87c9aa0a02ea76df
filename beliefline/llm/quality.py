"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network in numpy.

A text is cut into runs of letters, digits or other signs; an ideograph, kana or Hangul syllable is a run of its own.
A run's form (letters: lower-cased, with its case pattern; else the run itself) is hashed to one of 2^15 entries. Each entry has a fixed sparse ternary index
vector; its word vector is the sum of the index vectors of the entries within two places, over all documents
(random indexing). The table of sums has a fixed size, so it is added up from partial sums of each task, collected
and broadcast. A document is the mean and the spread of its word vectors and a few ratios. The network learns from a
bounded sample of labelled rows; a temperature fitted on held-out rows of the sample calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernels as K
from .common import bounded_batches

ENTRIES, DIMS, NONZERO, REACH = 1 << 15, 32, 2, 2
#: At most so many labelled rows, those with the least hash of the id, train the network.
SAMPLE, HIDDEN, EPOCHS, THRESHOLD = 20_000, 32, 30, 0.3

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALONE = np.zeros(256, bool)
_ALONE[0xE3:0xEE] = True
_INDEX = K.random_words(ENTRIES, 20)
_PLACES = np.stack([((_INDEX >> np.uint64(8 * i)) % np.uint64(DIMS)).astype(np.int64) for i in range(NONZERO)], 1)
_SIGNS = np.stack([1.0 - 2.0 * ((_INDEX >> np.uint64(40 + i)) & np.uint64(1)) for i in range(NONZERO)], 1)


class Runs:
    """Runs of one kind of byte: entry, kind, upper-case pattern, the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        kind = _KIND[data]
        edge = np.ones(n, bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[offsets[:-1][offsets[:-1] < n]] = True
        alone = np.flatnonzero(_ALONE[data])  # lead bytes of three
        edge[alone] = True
        edge[alone[alone + 3 < n] + 3] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n)[: len(starts)]
        solid = kind[starts] > 0
        starts, ends = starts[solid], ends[solid]
        self.kind, self.size = kind[starts], ends - starts
        self.first = np.searchsorted(starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        letters = self.kind == 1
        upper = _UPPER[data]
        case = np.where(letters, upper[starts] * 1 + upper[np.minimum(starts + 1, ends - 1)] * 2, 0) if n else self.kind
        form = K.mix(K.hash_spans(data, starts, ends, K._LOWER_BYTE) + (case.astype(np.uint64) + np.uint64(1)))
        self.form = form
        self.entry = (form % np.uint64(ENTRIES)).astype(np.int64)
        self.shout = letters & (case == 3) & (self.size > 1)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums: entry and DIMS whole numbers."""
    table = np.zeros(ENTRIES * DIMS)
    for batch in batches:
        for _, data, offsets in K.text_blocks(batch):
            runs = Runs(data, offsets)
            for reach in range(1, REACH + 1):
                same = runs.row[reach:] == runs.row[:-reach]
                left, right = runs.entry[:-reach][same], runs.entry[reach:][same]
                for a, b in ((left, right), (right, left)):
                    for i in range(NONZERO):
                        table += np.bincount(a * DIMS + _PLACES[b, i], _SIGNS[b, i], minlength=len(table))
    table = table.reshape(ENTRIES, DIMS)
    used = np.flatnonzero(np.abs(table).sum(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, i].astype(np.int64)) for i in range(DIMS))], names=["entry", *(f"v{i}" for i in range(DIMS))])


def word_vectors(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """The ENTRIES x DIMS table over all documents, rows of length 1 (or 0 where an entry never occurs)."""
    bounded_batches(docs.sparkSession)
    columns = [f"v{i}" for i in range(DIMS)]
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_contexts, "entry long, " + ", ".join(f"{c} long" for c in columns))
    found = found.groupBy("entry").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    table = np.zeros((ENTRIES, DIMS), np.float32)
    table[found["entry"].to_numpy()] = np.stack([found[c].to_numpy() for c in columns], 1)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.maximum(length, 1e-9)


def document_vectors(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors, and ratios; zeros for a text without a run."""
    runs = Runs(data, offsets)
    n = len(offsets) - 1
    count = np.diff(runs.first)
    have = np.flatnonzero(count)
    out = np.zeros((n, 2 * DIMS + 8), np.float32)
    if not len(have):
        return out
    at, size = runs.first[have], count[have][:, None]
    v = vectors[runs.entry]
    mean = np.add.reduceat(v, at, axis=0) / size
    out[have, :DIMS] = mean
    out[have, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(v * v, at, axis=0) / size - mean * mean, 0))
    key = np.sort((runs.row.astype(np.uint64) << np.uint64(40)) + (runs.form >> np.uint64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]]).astype(np.float32)
    again = np.zeros(len(runs.form), np.float32)
    again[2:] = ((runs.form[2:] == runs.form[:-2]) | (runs.form[2:] == runs.form[1:-1])) & (runs.row[2:] == runs.row[:-2])

    def share(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.float32), at) / size[:, 0]

    distinct = share(new)
    logs = np.log1p(count[have])
    out[have, 2 * DIMS :] = np.stack([logs, distinct, distinct * logs, share(again), share(runs.kind == 3), share(runs.kind == 2), share(runs.shout), np.log1p(share(runs.size))], 1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the log loss; a fifth of the rows is held out to fit the temperature. One class alone, or no row,
    gives its share (0.5 without rows) for every text."""
    d = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Network(np.zeros(d), np.ones(d), (np.zeros((d, 1)), np.zeros(1), np.zeros(1), np.log(p / (1 - p))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    z = (x - mean) / scale
    params = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            a = np.tanh(z[part] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30)))
            g = (p - y[part]) / len(part)
            back = np.outer(g, params[2]) * (1 - a * a)
            grads = [z[part].T @ back + 1e-4 * params[0], back.sum(axis=0), a.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                params[i] = params[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(z[held] @ params[0] + params[1]) @ params[2] + params[3]
    grid = np.geomspace(0.25, 8, 60)
    loss = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / t).mean() for t in grid]
    return Network(mean, scale, tuple(params), float(grid[int(np.argmin(loss))]))


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def _vectors_of(vectors, ids: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                x = document_vectors(data, offsets, vectors.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))], names=["label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Word vectors over all docs; a network from ``sample`` labelled rows at most, those with the least hash of the id.

    labels: id_col and label_col (0 or 1). Null ids and labels are passed over; of labels that disagree on an id, the
    larger counts. Where an id stands on several rows of docs, each of them is learnt from.
    """
    spark = bounded_batches(docs.sparkSession)
    vectors = word_vectors(docs, text_col=text_col)
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label")).where("label in (0, 1) and __id is not null")
    chosen = chosen.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # sample rows at most
    shared = spark.sparkContext.broadcast(vectors)
    found = rows.select("label", "text")
    found = found.mapInArrow(_vectors_of(shared, pa.float64()), "label double, x array<float>").toArrow()
    y = found["label"].to_numpy()
    x = np.array(found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(y), -1) if len(y) else np.zeros((0, 2 * DIMS + 8))
    order = np.lexsort((*x.T[:4], y)) if len(y) else np.zeros(0, int)  # however the rows came in
    return QualityModel(vectors, fit(x[order].astype(np.float64), y[order]))


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of each row's whole text. Null and empty texts are scored as texts
    without a run. Rows count alone, whatever their ids; other columns are not read."""
    spark = bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    shared = spark.sparkContext.broadcast((model.vectors, model.network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                p = network.score(document_vectors(data, offsets, vectors).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=schema)

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("score", pa.float64()), ("predicted", pa.int32())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, score double, predicted int")


def keep(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model does not reject, in place: no row moves or is joined."""
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.vectors, model.network))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            data, offsets = K.utf8(batch.column(at))
            for i, j in K.chunks(offsets):
                p = network.score(document_vectors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vectors).astype(np.float64))
                yield batch.slice(i, j - i).filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
