"""Document fingerprints by consistent weighted sampling.

A document is a bag of words (runs of anything but ASCII white space), each weighted by its count. For each word and
each of ``k`` samples, fixed gamma(2, 1) variates r and c and a uniform b (all drawn from the word's hash) give
t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r; the word with the least a is the sample, together with t
(Ioffe 2010). Two documents agree on a sample with the probability of their generalised Jaccard similarity,
sum of minima over sum of maxima of the weights. A word of one count draws the same numbers in every document, so a
block computes them once for each distinct (word, count).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernels as K
from .bpe import clean_utf8
from .common import bounded_batches

SAMPLES = 64


def _uniforms(h: np.ndarray, columns: np.ndarray) -> list[np.ndarray]:
    """Five uniform numbers in (0, 1) for each hash and sample, from 21 bits each of two related 64-bit hashes."""
    x = K.mix(h[:, None] ^ K.random_words(int(columns[-1]) + 1, 10)[None, columns])
    y = x * np.uint64(0xD1B54A32D192ED03)
    y ^= y >> np.uint64(29)
    y *= np.uint64(0x94D049BB133111EB)
    parts = (x >> np.uint64(43), x >> np.uint64(22), x >> np.uint64(1), y >> np.uint64(43), y >> np.uint64(22))
    out = []
    for p in parts:
        u = (p & np.uint64(0x1FFFFF)).view(np.int64).astype(np.float32)
        u += np.float32(0.5)
        u *= np.float32(1 / (1 << 21))
        out.append(u)
    return out


def samples(h: np.ndarray, weight: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, t) for each weighted term and the given samples."""
    u = _uniforms(h, columns)
    r, log_c = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
    t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + u[4])
    return log_c - r * (t - u[4]) - r, t


def signatures(data: np.ndarray, offsets: np.ndarray, k: int = SAMPLES) -> np.ndarray:
    """A row of k 32-bit samples for each text; 0 throughout for a text without words."""
    words = K.Words(data, offsets)
    n = len(offsets) - 1
    sig = np.zeros((n, k), np.uint32)
    if not len(words.hashes):
        return sig
    terms, inverse = np.unique(words.hashes, return_inverse=True)
    key = np.sort(words.row() * len(terms) + inverse)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(new, len(key)))
    row, term = np.divmod(key[new], len(terms))
    most = int(count.max()) + 1
    pairs, entry = np.unique(term * most + count, return_inverse=True)
    h, weight = terms[pairs // most], pairs % most
    first = np.searchsorted(row, np.arange(n + 1))
    have = np.flatnonzero(np.diff(first))
    for a in range(0, k, 16):  # some samples at a time
        cols = np.arange(a, min(k, a + 16))
        log_a, t = samples(h, weight, cols)
        bits = log_a.view(np.int32).astype(np.int64)
        bits ^= (bits >> 63) & 0x7FFFFFFF  # in the order of the numbers
        bits <<= 32
        bits += np.arange(len(pairs))[:, None]
        for i in range(0, len(have), 256):  # some texts at a time
            some = have[i : i + 256]
            lo, hi = first[some[0]], first[some[-1] + 1]
            best = np.minimum.reduceat(bits[entry[lo:hi]], first[some] - lo, axis=0) & 0xFFFFFFFF
            chosen = K.mix(h[best] ^ (t[best, np.arange(len(cols))[None, :]].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            sig[some[:, None], cols[None, :]] = (chosen >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return sig


def texts_of(sig: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text, 8 digits a sample."""
    raw, size = sig.astype(">u4").tobytes().hex(), 8 * sig.shape[1]
    return [raw[i : i + size] for i in range(0, len(raw), size)] if size else []


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of samples on which rows agree."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of each row's whole text; null and blank texts have one fingerprint, of zeros."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts_of(signatures(data, offsets, k)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, fingerprint string")


def _edit(data: np.ndarray, offsets: np.ndarray, share: int) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(code points, bytes and offsets of the edited texts) of all rows but the last, each edited with the next."""
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(lead[:-1], offsets)
    n = np.diff(first)
    raw, parts, sizes = data.tobytes(), [], [0]
    for i in range(len(n) - 1):
        q = n[i] // share
        keep = raw[offsets[i] : lead[first[i] + n[i] - q]]
        fill = raw[offsets[i + 1] : lead[first[i + 1] + min(q, n[i + 1])]]
        parts += [keep, fill]
        sizes.append(len(keep) + len(fill))
    return n[:-1], b"".join(parts), np.cumsum(sizes)


def _edited(k: int, share: int, ids: pa.DataType):
    """Rows come in order; a row with ghost only serves the one before it."""
    schema = pa.schema([("doc_id", ids), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None
        for batch in batches:
            for part, _, _ in K.text_blocks(batch, size=2 * K.CHUNK):
                rows = part if carry is None else pa.Table.from_batches([carry, part]).combine_chunks().to_batches()[0]
                carry = rows.slice(rows.num_rows - 1)
                if rows.num_rows < 2:
                    continue
                data, offsets, _ = clean_utf8(*K.utf8(rows.column(2)))
                n, blob, at = _edit(data, offsets, share)
                # texts and edited texts share most words, whose numbers are drawn once
                both = signatures(np.concatenate([data, np.frombuffer(blob, np.uint8)]), np.concatenate([offsets, offsets[-1] + at[1:]]), k)
                own, other = both[: rows.num_rows], both[rows.num_rows :]
                real = np.flatnonzero(~rows.column(1).to_numpy(zero_copy_only=False)[:-1])
                if len(real):
                    yield pa.RecordBatch.from_arrays([
                        rows.column(0).take(pa.array(real)), pa.array(n[real]), pa.array([hashlib.sha256(blob[at[i] : at[i + 1]]).hexdigest() for i in real], pa.string()),
                        pa.array(texts_of(own[real]), pa.string()), pa.array(texts_of(other[real]), pa.string()),
                        pa.array(likeness(own[real], other[real])), pa.array(likeness(own[real], own[real + 1])),
                    ], schema=schema)

    return run


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, share: int = 4, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last n_chars // share code points replaced by the first
    as many of the next document by ascending id (after the last: the first).

    Ids are whole numbers. The order is kept by range: quantiles of the ids cut them into parts, and the first
    document of a part is also sent, as a ghost, to the part before it, so no task sees all rows. Ties in id are
    ordered by text, null texts first; null texts count as empty. Rows with a null id have no place and are left out.
    A single document is its own next. Other columns are not read.
    """
    spark = bounded_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(read.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    part = _part(cuts)
    dealt = read.withColumn("part", part)
    heads = [(r["part"], r["head"]) for r in dealt.groupBy("part").agg(F.min("doc_id").alias("head")).orderBy("part").collect()]  # a row a part
    ghosts = [(p, heads[(i + 1) % len(heads)][1]) for i, (p, _) in enumerate(heads)]
    small = spark.createDataFrame(ghosts or [(0, 0)], "part int, doc_id long")
    ghost = read.join(F.broadcast(small), "doc_id").select("doc_id", "text", "part", F.lit(True).alias("ghost"))
    rows = dealt.select("doc_id", "text", "part", F.lit(False).alias("ghost")).union(ghost)
    slot = F.element_at(F.array(*(F.lit(k) for k in _slots(spark, parts))), F.col("part") + 1)
    rows = rows.withColumn("slot", slot).repartition(parts, "slot").sortWithinPartitions("part", "ghost", "doc_id", "text")
    return rows.select("doc_id", "ghost", "text").mapInArrow(
        _edited(k, share, pa.int64()), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _slots(spark: SparkSession, parts: int) -> list[int]:
    """A key for each part that hash partitioning deals to a partition of its own (part numbers themselves would share
    some and leave others empty)."""
    key = F.col("id").cast("int")
    found = spark.range(32 * parts).groupBy(F.pmod(F.hash(key), F.lit(parts)).alias("slot")).agg(F.min(key).alias("key")).collect()  # a row a part
    by = {r["slot"]: r["key"] for r in found}
    return [by.get(p, p) for p in range(parts)]


def _part(cuts: list[float]):
    """How many cuts are at or below the id, by halving: depth log2 of their number."""
    if not cuts:
        return F.lit(0)
    if len(cuts) == 1:
        return (F.col("doc_id") >= F.lit(int(cuts[0]))).cast("int")
    m = len(cuts) // 2
    return F.when(F.col("doc_id") < F.lit(int(cuts[m])), _part(cuts[:m])).otherwise(F.lit(m) + _part(cuts[m:]))
