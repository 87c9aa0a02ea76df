"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text becomes code points, lower-cased one by one, everything but letters a blank. N-grams of one to three characters
are hashed into a fixed number of features. Training counts (language, feature) over all labelled rows, with a partial
count for each task. The matrix of log-probabilities (languages x features, its size fixed by the labels) is broadcast
and whole texts are scored by gathering its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernels as K
from .bpe import LETTER, _classes, clean_utf8
from .common import bounded_batches

BITS, ORDERS, SMOOTHING, UNKNOWN = 15, 3, 0.5, "und"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point to lower case, 0x20 for what is no letter."""
    out = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)
    out[_classes() != LETTER] = 0x20
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, n + 1 row offsets) for each order; n-grams do not cross rows, blanks alone do not count.
    First comes (letters, offsets), which says how many letters each row has."""
    data, offsets, points = clean_utf8(data, offsets)
    first = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    c = _folded()[points]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    solid = c != 0x20
    yield solid, np.concatenate([[0], np.cumsum(solid)])[first]
    h = np.zeros(len(c), np.uint32)
    any_solid = np.zeros(len(c), bool)
    for order in range(1, ORDERS + 1):
        n = len(c) - order + 1
        if n <= 0:
            return
        h = h[:n] * np.uint32(0x01000193) + c[order - 1 :]
        any_solid = any_solid[:n] | solid[order - 1 :]
        good = any_solid & (row[:n] == row[order - 1 :])
        x = h[good] * np.uint32(0x9E3779B1) + np.uint32(order)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        yield x >> np.uint32(32 - BITS), np.searchsorted(row[:n][good], np.arange(len(offsets)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, feature (-1: rows), n of the task's rows; columns in: lang, text."""
    size = 1 << BITS
    seen: dict[str, int] = {}
    table = np.zeros((0, size), np.int64)
    rows: list[int] = []
    for batch in batches:
        for part, data, offsets in K.text_blocks(batch):
            names = part.column(0).to_pylist()
            for name in names:
                if name not in seen:
                    seen[name] = len(seen)
                    rows.append(0)
                    table = np.concatenate([table, np.zeros((1, size), np.int64)])
                rows[seen[name]] += 1
            code = np.array([seen[name] for name in names])
            found = features(data, offsets)
            next(found)
            for x, at in found:
                key = np.repeat(code, np.diff(at)) * size + x
                table += np.bincount(key, minlength=table.size).reshape(table.shape)
    for name, i in seen.items():
        x = np.flatnonzero(table[i])
        yield pa.RecordBatch.from_arrays([pa.array([name] * (len(x) + 1), pa.string()), pa.array(np.append(x, -1)), pa.array(np.append(table[i][x], rows[i]))], names=["lang", "feature", "n"])


@dataclass
class LanguageModel:
    langs: list[str]
    prior: np.ndarray
    logs: np.ndarray  # features x languages


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts over all rows with a text and a language. What comes to the driver is languages x 2^15 counts at most."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    found = rows.mapInArrow(_counts, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(found["lang"].to_pylist(), object)
    langs = sorted(set(names.tolist()))
    if not langs:
        return LanguageModel([], np.zeros(0), np.zeros((1 << BITS, 0), np.float32))
    code = np.searchsorted(np.array(langs, object), names)
    feature, n = found["feature"].to_numpy(), found["n"].to_numpy()
    rows_of = np.zeros(len(langs))
    rows_of[code[feature < 0]] = n[feature < 0]
    counts = np.full((1 << BITS, len(langs)), SMOOTHING)
    counts[feature[feature >= 0], code[feature >= 0]] += n[feature >= 0]
    return LanguageModel(langs, np.log(rows_of / rows_of.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (posterior of the language) of each row's whole text.

    A text that is null or has no letter gets ``und`` and 0, as does every text if the model has no language. Ties go
    to the language that comes first. Each row counts alone; columns but id and text are not read.
    """
    spark = bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    shared = spark.sparkContext.broadcast((model.langs, model.prior, model.logs))
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logs = shared.value
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                found = features(data, offsets)
                _, letters = next(found)
                known = np.diff(letters) > 0
                total = np.tile(prior, (part.num_rows, 1))
                for x, at in found:
                    have = np.flatnonzero(np.diff(at))
                    if len(have) and langs:
                        total[have] += np.add.reduceat(logs[x], at[have], axis=0, dtype=np.float64)
                if langs:
                    best = total.argmax(axis=1)
                    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    best, score, known = np.zeros(part.num_rows, int), np.zeros(part.num_rows), known & False
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, score, 0.0))], schema=schema)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, lang_pred string, score double")
