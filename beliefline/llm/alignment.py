"""Alignment of two tokenizers over a corpus: where their tokens end together, and how often which pair does so.

A text's tokens of both kinds are byte ranges of one string. Offsets where both end cut them into groups; the last
tokens of a group are linked. A linked pair of ids is one int64 key. Keys are counted with ``np.unique`` within each
partition, the partial counts are dealt by ranges of keys, sorted, and runs of equal keys summed: each range becomes a
shard, a file of sorted keys and counts in the shared folder. Tasks map the shards into memory and look keys up by
binary search, so a text's links are compared with the counts of the whole corpus without a join.

Of two tokens that end together, the bytes of one are a suffix of the other's. So a vocabulary of n tokens of k bytes
on average has n * k pairs at most, whatever the corpus (under a million for the usual two, or 16 MB of shards): that
bounds what a task counts, a shard holds and a worker maps.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import bpe, pieces
from . import textkernels as K
from .common import bounded_batches, materialise, remove_at_exit, shared_path

LEFT = "byte_bpe_50k.json"
#: Bytes of text that are encoded and aligned together; a longer text alone.
BLOCK = 1 << 20
#: An id of the right tokenizer stands above this bit of a key, one of the left below.
SHIFT = 32


class ByteLevel:
    """A byte-level BPE tokenizer of the ``tokenizers`` library. Distinct pre-tokens of a block are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        if made.get("normalizer") or made["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE without a normaliser or a prefix is known")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in entries
        names = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        text = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in names for c in entry):
                text[i] = bytes(names[c] for c in entry)
        self.size = len(text)
        self.blob, self.at = np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts in UTF-8."""
        data, offsets, points = bpe.clean_utf8(data, offsets)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        starts = bpe.pre_tokens(points, np.searchsorted(lead, offsets)[:-1])
        at = lead[starts]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        ends = np.append(at[1:], len(data))
        _, index, inverse = np.unique(K.hash_spans(data, at, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(at[index].tolist(), ends[index].tolist(), strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.int64, int(counts.sum()))
        first, lengths = (np.cumsum(counts) - counts)[inverse], counts[inverse]
        return ids[K.ragged(first, lengths)], np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(at, offsets)]


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def _bytes(kind, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the tokens, length of each, offsets of the texts) by a tokenizer's table."""
    lengths = (kind.at[1:] - kind.at[:-1])[ids]
    return kind.blob[K.ragged(kind.at[ids], lengths)], lengths, np.concatenate([[0], np.cumsum(lengths)])[offsets]


def _only(keep: np.ndarray, ids: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of the texts marked, with the texts' new offsets."""
    counts = np.diff(offsets)
    mine = np.repeat(keep, counts)
    return ids[mine], lengths[mine], np.concatenate([[0], np.cumsum(np.where(keep, counts, 0))])


class Block:
    """The alignment of a block of texts (UTF-8, each with its leading blank): tokens, groups and links."""

    def __init__(self, left: ByteLevel, right: pieces.Vocabulary, data: np.ndarray, offsets: np.ndarray):
        data, offsets, _ = bpe.clean_utf8(data, offsets)
        full = np.diff(offsets) > 0
        spaced = np.insert(data, offsets[:-1][full], 0x20)
        ends = offsets + np.concatenate([[0], np.cumsum(full)])
        a, a_at = left.encode_block(spaced, ends)
        b, b_at = pieces.encode_block(right, data, offsets)
        b = b.astype(np.int64)
        a_data, a_size, a_ends = _bytes(left, a, a_at)
        b_data, b_size, b_ends = _bytes(right, b, b_at)
        whole, a_raw, b_raw = memoryview(spaced.tobytes()), memoryview(a_data.tobytes()), memoryview(b_data.tobytes())
        same = np.array([whole[i:j] == a_raw[k:m] and whole[i:j] == b_raw[p:q] for i, j, k, m, p, q in zip(*(x.tolist() for e in (ends, a_ends, b_ends) for x in (e[:-1], e[1:])), strict=True)], bool)
        a, a_size, self.a_at = _only(same, a, a_size, a_at)
        b, b_size, self.b_at = _only(same, b, b_size, b_at)
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        marks = np.zeros((2, int(a_end[-1]) + 1 if len(a_end) else 1), bool)
        marks[0][a_end] = marks[1][b_end] = True
        #: The last tokens of each group; token numbers.
        self.a_last, self.b_last = np.flatnonzero(marks[1][a_end]), np.flatnonzero(marks[0][b_end])
        self.group_at = np.searchsorted(self.a_last, self.a_at)  # the first group of each text
        self.a, self.b = a, b

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, how often, offsets): the distinct keys of each text, ascending."""
        keys = (self.b[self.b_last] << SHIFT) | self.a[self.a_last]
        row = np.repeat(np.arange(len(self.group_at) - 1), np.diff(self.group_at))
        order = np.lexsort((keys, row))
        keys, row = keys[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])[: len(keys)])
        return keys[new], np.diff(np.append(new, len(keys))), np.searchsorted(row[new], np.arange(len(self.group_at)))

    def spelled(self) -> tuple[bytes, np.ndarray]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3`` with a mark after it, and the texts' offsets."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.a_last] = last_b[self.b_last] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        begin_b = np.concatenate([[0], self.b_last + 1])
        place_a, place_b = np.arange(len(self.a)) + begin_b[group_a], np.arange(len(self.b)) + (self.a_last + 1)[group_b]
        tokens, marks = np.zeros(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.uint8)
        tokens[place_a], tokens[place_b] = self.a, self.b
        marks[place_a], marks[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        data, ends = pieces.joined(tokens, marks)
        return data.tobytes(), np.concatenate([[0], ends])[self.a_at + self.b_at]


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", left_path: str | None = None, right_path: str | None = None, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys and times (how often each key links) of each row's
    whole text; with groups, their spelling too. left: byte-level BPE on blank and text; right: SentencePiece BPE.

    Texts that are null or empty, or that one tokenizer changes (as U+2581, which becomes a blank), have no tokens:
    zeros, and '' for groups_sha256. Rows are independent: repeated rows and null ids give a row each; other columns
    are not read.
    """
    bounded_batches(docs.sparkSession)
    left_path, right_path = left_path or public_tokenizers.path(LEFT), right_path or public_tokenizers.path(pieces.MODEL)
    kind = docs.schema[id_col].dataType
    names = ["n_a", "n_b", "n_groups", "n_links"]
    more = [("groups", pa.string())] if groups else []
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *((n, pa.int64()) for n in names), ("groups_sha256", pa.string()), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level(left_path), pieces.vocabulary(right_path)
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch, size=BLOCK):
                block = Block(left, right, data, offsets)
                spelled, at = block.spelled()
                spans = [spelled[i : max(i, j - 1)] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys, times, ends = block.links()
                ends, n = pa.array(ends.astype(np.int32)), pa.array(np.diff(block.group_at))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(block.a_at)), pa.array(np.diff(block.b_at)), n, n, pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in spans], pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(keys)), pa.ListArray.from_arrays(ends, pa.array(times)), *([pa.array([s.decode() for s in spans], pa.string())] if groups else []),
                ], schema=schema)

    ddl = ", ".join([f"doc_id {kind.simpleString()}", *(f"{n} long" for n in names), "groups_sha256 string, keys array<long>, times array<long>", *(["groups string"] if groups else [])])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    keys, where = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, where, counts)
    return keys, out


def partial_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): the sums of each partition. A partition holds distinct keys only, which the vocabularies bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            waiting.append(tuple(batch.column(i).flatten().to_numpy() for i in (0, 1)))
            size += len(waiting[-1][0])
            if size > 2_000_000:
                held, waiting, size = summed(*(np.concatenate(x) for x in zip(held, *waiting, strict=True))), [], 0
        keys, counts = summed(*(np.concatenate(x) for x in zip(held, *waiting, strict=True)))
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(counts[i : i + 100_000])], names=["key", "n"])

    return aligned.select("keys", "times").mapInArrow(run, "key long, n long")


def run_sums(partials: DataFrame, shards: int) -> DataFrame:
    """(key, n) over all partitions: dealt by ranges of keys, sorted, runs of equal keys summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # the last run, which the next batch may go on with
        for batch in batches:
            keys, n = (np.concatenate([left[i], batch.column(i).to_numpy()]) for i in (0, 1))
            if not len(keys):
                continue
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.add.reduceat(n, first)
            left = keys[-1:], n[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(n[:-1])], names=["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(left[0]), pa.array(left[1])], names=["key", "n"])

    return partials.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, "key long, n long")


def _filesystem(spark: SparkSession, path: str) -> tuple[str, str]:
    """(address of its file system for pyarrow, path in it) of a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return ("" if p.getScheme() == "file" else p.toString()), p.getPath()


def _open(address: str, path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address) if address else (fs.LocalFileSystem(), path)


def write_shards(counts: DataFrame, path: str) -> None:
    """Writes each partition of (key, n), sorted by key, as one file: the keys, then their counts, as 64-bit numbers.
    A task that runs again puts the same file in the place of the first."""
    address, inside = _filesystem(counts.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(batch.column(i).to_numpy() for i in (0, 1)) for batch in batches]
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1)]
        if len(columns[0]):
            task = TaskContext.get()
            store, folder = _open(address, inside)
            store.create_dir(folder, recursive=True)
            draft = f"{folder}/.draft-{task.partitionId()}-{task.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                for column in columns:
                    out.write(np.ascontiguousarray(column.astype("<i8")).data)
            store.move(draft, f"{folder}/shard-{task.partitionId():06d}")
        yield pa.RecordBatch.from_arrays([pa.array([len(columns[0])], pa.int64())], names=["n"])

    counts.mapInArrow(run, "n long").agg(F.sum("n")).collect()


class Shards:
    """The counts of all pairs. Files of a mounted folder are mapped into memory; of another store they are read."""

    def __init__(self, address: str, inside: str):
        store, folder = _open(address, inside)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        self.shards = []
        for info in sorted((f for f in found if f.base_name.startswith("shard-")), key=lambda f: f.path):
            both = np.memmap(info.path, "<i8", "r") if not address else np.frombuffer(store.open_input_file(info.path).read(), "<i8")
            self.shards.append((both[: len(both) // 2], both[len(both) // 2 :]))
        self.first = np.array([k[0] for k, _ in self.shards], np.int64)
        ids = [(k >> SHIFT) for k, _ in self.shards]
        self.best = np.zeros(max((int(i[-1]) for i in ids), default=0) + 1, np.int64)
        for i, (_, n) in zip(ids, self.shards, strict=True):
            np.maximum.at(self.best, i, n)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; all have been counted."""
        out, shard = np.zeros(len(keys), np.int64), np.searchsorted(self.first, keys, "right") - 1
        for i in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == i)
            at, n = self.shards[i]
            out[mine] = n[np.searchsorted(at, keys[mine])]
        return out


@lru_cache(maxsize=2)
def open_shards(address: str, inside: str) -> Shards:
    return Shards(address, inside)


def with_counts(aligned: DataFrame, path: str) -> DataFrame:
    """The rows of align() with n_best (links whose count is the highest of their right id's, ties included) and
    count_sum (of all links) in the place of their keys; path: of write_shards()."""
    address, inside = _filesystem(aligned.sparkSession, path)
    names = [c for c in aligned.columns if c not in ("keys", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = open_shards(address, inside)
        for batch in batches:
            lists = batch.column(len(names))
            keys, times = lists.flatten().to_numpy(), batch.column(len(names) + 1).flatten().to_numpy()
            counts = known.counts(keys)
            best = np.where(counts == known.best[np.minimum(keys >> SHIFT, len(known.best) - 1)], times, 0)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]), pa.int64()) for x in (best, counts * times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *sums], names=[*names, "n_best", "count_sum"])

    ddl = ", ".join([*(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in names), "n_best long, count_sum long"])
    return aligned.select(*names, "keys", "times").mapInArrow(run, ddl)


def pair_counts(aligned: DataFrame, shards: int | None = None) -> DataFrame:
    """a, b, n of every pair of ids that is linked anywhere in the rows of align()."""
    counts = run_sums(partial_counts(aligned), shards or aligned.sparkSession.sparkContext.defaultParallelism)
    return counts.select(F.col("key").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("a"), F.shiftright("key", SHIFT).cast("int").alias("b"), "n")


def cross_align(docs: DataFrame, *, shards: int | None = None, **options) -> DataFrame:
    """The rows of align() with n_best and count_sum over the whole corpus. Texts are encoded once: what align() finds
    is written to the shared folder, counted there and looked up there. An empty table gives no rows."""
    spark = docs.sparkSession
    aligned = materialise(align(docs, **options), "aligned")
    path = shared_path(spark, "pair-counts")
    write_shards(run_sums(partial_counts(aligned), shards or spark.sparkContext.defaultParallelism), path)
    remove_at_exit(spark, path)
    return with_counts(aligned, path)
