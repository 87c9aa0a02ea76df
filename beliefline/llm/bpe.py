"""Byte-level BPE over a corpus: each distinct pre-token is encoded once, wherever it stands.

``encode`` splits whole texts into pre-tokens with positions. A task gathers blocks of texts; a block is its distinct
pre-tokens and, for each text, the sequence of their places in that list. One exchange carries both: the sequences to
their block's partition, the distinct pre-tokens by hash, so that equal ones meet and each is encoded once. Their ids
are then cogrouped with the sequences, which need not move again, and each text's ids are put together by position.
What moves is a pre-token once a block and some bits a position, never a row a position. A block's list depends on its
texts alone, so a task that is run again after the loss of an executor gives the same one. ``decode`` looks ids up in the table of token bytes, whose size the vocabulary fixes.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernels as K
from .common import bounded_batches

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens of a block at least, if there are so many.
BLOCK = 4_000_000
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def clean_utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, code points); bytes that are no UTF-8 become U+FFFD."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace").encode("utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        raw = b"".join(rows)
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        text = raw.decode("utf-8")
    return data, offsets, np.frombuffer(text.encode("utf-32-le"), np.uint32)


def pre_tokens(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens among code points; first: where each text starts.

    Does what the split pattern says: runs of letters, of numbers or of others, with one blank before them; of a run
    of white space before something else, the last character stands apart; English contractions after anything but
    a blank. Pre-tokens leave no gaps, so the starts tell all.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    head = np.zeros(n + 1, bool)
    head[first[first < n]] = True
    head[n] = True
    run = np.ones(n, bool)
    run[1:] = (kind[1:] != kind[:-1]) | head[1:n]
    start = run.copy()
    solid = np.flatnonzero(run & (kind != SPACE))
    after = solid[(solid > 0) & ~head[solid]]
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True  # the last of the white space
    start[after[points[after - 1] == 0x20]] = False
    quote = solid[(points[solid] == 0x27)]
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & (kind[quote + 1] == LETTER) & ~head[quote + 1]]
    blank = np.zeros(len(quote), bool)
    inner = (quote > 0) & ~head[quote]
    blank[inner] = points[quote[inner] - 1] == 0x20
    quote = quote[~blank]
    if len(quote):
        a = points[quote + 1]
        second = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~head[second], points[second], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hits, size in ((quote[one], 1), (quote[two & ~one], 2)):
            start[hits + 1] = False
            rest = hits + 1 + size
            start[rest[rest < n]] = True
    return np.flatnonzero(start)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(x.T).view("<u4").reshape(-1)


class _Block:
    """Distinct pre-tokens and the texts made of them."""

    def __init__(self, ids: pa.DataType, buckets: int):
        self.ids, self.buckets = ids, buckets
        self.uniques, self.blobs, self.sizes, self.places, self.rows = [], [], [], [], []
        self.n = self.distinct = 0

    def add(self, doc_ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        data, offsets, points = clean_utf8(data, offsets)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(lead, offsets)
        starts = pre_tokens(points, first[:-1])
        counts = np.diff(np.searchsorted(starts, first))
        at = lead[starts]
        ends = np.append(at[1:], len(data))[: len(at)]
        u, index, inverse = np.unique(K.hash_spans(data, at, ends), return_index=True, return_inverse=True)
        size = (ends - at)[index]
        self.uniques.append(u)
        self.sizes.append(size)
        self.blobs.append(data[K.ragged(at[index], size)])
        self.places.append(inverse.astype(np.int32) + self.distinct)
        self.rows.append((doc_ids, counts))
        self.n += len(starts)
        self.distinct += len(u)

    def flush(self, block: int) -> Iterator[tuple]:
        """(key, block, head, body, doc_ids, counts): words go by their bucket (keys below 0), texts by their block."""
        u, index, inverse = np.unique(np.concatenate(self.uniques), return_index=True, return_inverse=True)
        often = np.zeros(len(u), np.int64)
        for p in self.places:
            often += np.bincount(inverse[p], minlength=len(u))
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        sizes, blob = np.concatenate(self.sizes), np.concatenate(self.blobs)
        begin = np.cumsum(sizes) - sizes
        bucket = (u % np.uint64(self.buckets)).astype(np.int64)
        by = np.lexsort((rank, bucket))
        cut = np.searchsorted(bucket[by], np.arange(self.buckets + 1))
        press = zstandard.ZstdCompressor(level=3).compress
        for k in np.flatnonzero(np.diff(cut)):
            mine = by[cut[k] : cut[k + 1]]
            size = sizes[index[mine]]
            yield -1 - int(k), block, _pack(np.concatenate([np.diff(rank[mine], prepend=0), size])), press(blob[K.ragged(begin[index[mine]], size)].tobytes()), None, None
        for p, (doc_ids, counts) in zip(self.places, self.rows, strict=True):
            yield block, block, None, _pack(rank[inverse[p]]), doc_ids, counts


def _split(ids: pa.DataType, buckets: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, block = 0, _Block(ids, buckets)

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal seq, block
            if not block.rows:
                return
            number = (TaskContext.get().partitionId() << 32) + seq
            for key, b, head, body, doc_ids, counts in block.flush(number):
                lists = pa.nulls(1, pa.list_(ids)) if doc_ids is None else pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([b]), pa.array([head], pa.binary()), pa.array([body], pa.binary()), lists, pa.array([None if counts is None else counts.tolist()], pa.list_(pa.int64()))], schema=schema)
            seq, block = seq + 1, _Block(ids, buckets)

        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                block.add(part.column(0), data, offsets)
                if block.n >= BLOCK:
                    yield from rows()
        yield from rows()

    return run


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def _encode_words(path: str):
    """Each distinct word that comes to a task is encoded once; texts are passed over."""
    schema = pa.schema([("key", pa.int64()), ("places", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _encoding(path)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in np.flatnonzero(batch.column(0).to_numpy() < 0).tolist():
                head = _unpack(batch.column(2)[i].as_buffer())
                places, sizes = head[: len(head) // 2], head[len(head) // 2 :]
                blob, out, at = unpress(batch.column(3)[i].as_buffer()), [], 0
                for size in sizes.tolist():
                    word = blob[at : at + size]
                    at += size
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = piece(word)
                    out.append(ids)
                lengths = np.fromiter(map(len, out), np.uint32, len(out))
                ids = np.fromiter((t for x in out for t in x), np.uint32, int(lengths.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), pa.array([_pack(np.concatenate([places, lengths]))], pa.binary()), pa.array([_pack(ids)], pa.binary())], schema=schema)

    return run


def _assemble(ids: pa.DataType):
    """Cogroups a block's texts with the ids of its words; groups of words alone (keys below 0) give nothing."""
    schema = pa.schema([("doc_id", ids), ("ids", pa.list_(pa.int32()))])

    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        if key[0].as_py() < 0 or not texts.num_rows:
            return schema.empty_table()
        places, sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for head, body in zip(words["places"], words["ids"], strict=True):
            head = _unpack(head.as_buffer()).astype(np.int64)
            places.append(np.cumsum(head[: len(head) // 2]))
            sizes.append(head[len(head) // 2 :])
            flat.append(_unpack(body.as_buffer()).astype(np.int32))
        order = np.argsort(np.concatenate(places))
        size, flat = np.concatenate(sizes), np.concatenate(flat)
        begin, size = (np.cumsum(size) - size)[order], size[order]
        out = []
        for body, doc_ids, counts in zip(texts["body"], texts["doc_ids"], texts["counts"], strict=True):
            place, counts = _unpack(body.as_buffer()).astype(np.int64), counts.values.to_numpy()
            lengths = size[place]
            made = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
            out.append(pa.RecordBatch.from_arrays([doc_ids.values, pa.ListArray.from_arrays(pa.array(made.astype(np.int32)), pa.array(flat[K.ragged(begin[place], lengths)]))], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text, as tiktoken's encode_ordinary gives them.

    A null text counts as empty and has no ids. Rows are independent: repeated ones, null ids and ties give a row
    each. Other columns are not read. buckets: among so many groups the distinct pre-tokens are shuffled; a group's
    pre-tokens fit a worker's memory.
    """
    spark = bounded_batches(docs.sparkSession)
    path = ranks_path or public_tokenizers.path(RANKS)
    buckets = buckets or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    schema = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("head", pa.binary()), ("body", pa.binary()), ("doc_ids", pa.list_(arrow)), ("counts", pa.list_(pa.int64()))])
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _split(arrow, buckets, schema), f"key long, block long, head binary, body binary, doc_ids array<{name}>, counts array<long>"
    )
    dealt = split.repartition("key")  # both branches take all columns, so that they share this exchange
    words = dealt.mapInArrow(_encode_words(path), "key long, places binary, ids binary")
    return dealt.groupBy("key").cogroup(words.groupBy("key")).applyInArrow(_assemble(arrow), f"doc_id {name}, ids array<int>")


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by id) of the vocabulary."""
    by_id = sorted((i, b) for b, i in _ranks(path).items())
    offsets = np.zeros(by_id[-1][0] + 2, np.int64)
    for i, b in by_id:
        offsets[i + 1] = len(b)
    return np.frombuffer(b"".join(b for _, b in by_id), np.uint8), np.cumsum(offsets)


def decode_arrays(ids: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that lists of ids stand for."""
    blob, at = token_bytes(path)
    lengths = at[ids + 1] - at[ids]
    return blob[K.ragged(at[ids], lengths)], np.concatenate([[0], np.cumsum(lengths)])[offsets]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def decode(encoded: DataFrame, *, ranks_path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of each row of encode()'s result; null ids count as none."""
    path = ranks_path or public_tokenizers.path(RANKS)
    kind = encoded.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = decode_arrays(*_lists(batch.column(1)), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])], schema=schema)

    return encoded.select("doc_id", F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids")).mapInArrow(run, f"doc_id {kind.simpleString()}, text binary")


def round_trip(encoded: DataFrame, *, ranks_path: str | None = None) -> DataFrame:
    """n_tokens and the digests of each row's ids and of the bytes that they decode to."""
    path = ranks_path or public_tokenizers.path(RANKS)
    kind = encoded.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = _lists(batch.column(1))
            for i, j in K.chunks(4 * offsets):
                mine, at = ids[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                data, out = decode_arrays(mine, at, path)
                raw, data = memoryview(mine.astype("<u4").tobytes()), memoryview(data.tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(out[:-1], out[1:], strict=True)], pa.string()),
                ], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
