"""SentencePiece BPE over a corpus, as rounds of merges on flat numpy arrays.

A block's texts are cut before each run of blanks, where no piece of the vocabulary reaches across. Each distinct word
of the block is encoded once: all symbols of all words lie in one array, and in a round each word finds its best pair
(the least rank of a segment) and merges it, at its first place, or at all places where that is surely the same; the
array is then compacted, and finished words leave it. Blocks depend on their texts alone, so tasks need no exchange
and can be run again anywhere.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernels as K
from .bpe import clean_utf8
from .common import bounded_batches

MODEL = "piece_bpe_32k.model"
BLANK, BLANK_UTF8 = "▁", "▁".encode()
#: Bytes of text whose distinct words are encoded together.
BLOCK = 2 << 20
#: Words of more symbols are merged with a heap: rounds would cost the square of their length.
LONG = 256
#: No rank: beyond all ranks.
NONE = np.int32(2**31 - 1)
SHIFT = np.int64(21)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def message(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed 32-bit and nested ones as bytes."""
    out, at = [], 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}[tag & 7] if tag & 7 != 2 else _varint(data, at)
            value, at = data[at : at + size], at + size
        out.append((tag >> 3, value))
    return out


class Vocabulary:
    """Pieces, the pairs that make them, and tables of their bytes.

    A symbol is the id of its piece or, for a character without one, the vocabulary's size and the code point.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = message(f.read())
        trainer = dict(next((message(v) for k, v in model if k == 2), []))
        normal = dict(next((message(v) for k, v in model if k == 3), []))
        rows = [dict(message(v)) for k, v in model if k == 1]
        self.pieces = [r.get(1, b"").decode() for r in rows]
        score = np.array([np.frombuffer(r.get(2, bytes(4)), "<f4")[0] for r in rows], np.float32)
        kind = np.array([r.get(3, 1) for r in rows])  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or ((kind == 4) | (kind == 5)).any():
            raise ValueError("only BPE models with byte fallback, an identity normaliser and a leading blank are known")
        self.size = len(rows)
        self.end = self.pieces.index("</s>")
        self.control, self.unknown, self.byte = kind == 3, kind == 2, kind == 6
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.byte):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        ids = {self.pieces[i]: int(i) for i in np.flatnonzero(kind == 1)}
        self.ids = ids
        if any(BLANK in p.lstrip(BLANK) for p in ids):
            raise ValueError("a piece has a blank after other characters")
        symbol = lambda s: ids.get(s, self.size + ord(s) if len(s) == 1 else None)
        rank_of = {s: r for r, s in enumerate(sorted({float(x) for x in score[kind == 1]}, reverse=True))}
        rank = {i: rank_of[float(score[i])] for i in ids.values()}
        pairs, grows = {}, {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[(a << int(SHIFT)) | b] = i
                    for part in (a, b):
                        grows[part] = min(grows.get(part, int(NONE)), rank[i])
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = np.array([rank[i] for i in self.made.tolist()], np.int32)
        # merging a pair everywhere is the same as from the left if its piece grows only by worse pairs and no other pair is as good
        often = np.bincount([rank[i] for i in set(pairs.values())], minlength=len(rank_of))
        self.safe = np.zeros(len(rank_of), bool)
        for i in set(pairs.values()):
            self.safe[rank[i]] = often[rank[i]] == 1 and grows.get(i, int(NONE)) > rank[i]
        text = [b"" if self.control[i] else " ⁇ ".encode() if self.unknown[i] else bytes([int(p[3:5], 16)]) if self.byte[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.blob, self.at = np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])
        self.blank_first = np.array([kind[i] == 1 and p.startswith(BLANK) for i, p in enumerate(self.pieces)])

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of symbols; NONE where they make no piece."""
        key = (left.astype(np.int64) << SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rounds(v: Vocabulary, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges words, which lie one after the other in symbols; sizes: of each word, 1 at least. The same of the result."""
    out_symbols, out_words = [], []
    word = np.repeat(np.arange(len(sizes)), sizes)
    symbols = symbols.astype(np.int32)

    def ranked(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pair that begins at each of left; the last symbol of a word begins none."""
        last = np.minimum(left + 1, len(symbols) - 1)
        rank, made = v.lookup(symbols[left], symbols[last])
        return np.where((word[last] == word[left]) & (last > left), rank, NONE), made

    rank, made = ranked(np.arange(len(symbols)))
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        span = np.diff(np.append(first, len(symbols)))
        best = np.minimum.reduceat(rank, first)
        if (best == NONE).any():
            done = np.repeat(best == NONE, span)
            out_symbols.append(symbols[done])
            out_words.append(word[done])
            symbols, word, rank, made = symbols[~done], word[~done], rank[~done], made[~done]
            continue
        at = np.flatnonzero(rank == np.repeat(best, span))
        lead = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        # places that touch the one before merge in turn: every other one of such a run
        run = np.concatenate([[True], at[1:] != at[:-1] + 1]) | lead
        start = np.flatnonzero(run)
        turn = (np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0
        at = at[lead | (v.safe[rank[at]] & turn)]
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
        at = place[at]
        near = np.zeros(len(symbols), bool)
        near[at] = near[np.maximum(at - 1, 0)] = True
        near = np.flatnonzero(near)
        rank[near], made[near] = ranked(near)
    if not out_symbols:
        return np.zeros(0, np.int32), sizes.copy()
    symbols, word = np.concatenate(out_symbols), np.concatenate(out_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=len(sizes))


def merge_heap(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Merges one long word: a heap of pairs by rank and place, over a linked list."""
    symbol = symbols.tolist()
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known = dict(zip(v.keys.tolist(), zip(v.rank.tolist(), v.made.tolist(), strict=True), strict=True)) if n > 10 * LONG else None
    shift = int(SHIFT)

    def pair(i: int) -> tuple[int, int] | None:
        key = (symbol[i] << shift) | symbol[after[i]]
        if known is not None:
            return known.get(key)
        at = int(np.searchsorted(v.keys, key))
        return (int(v.rank[at]), int(v.made[at])) if at < len(v.keys) and v.keys[at] == key else None

    heap = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < n and (found := pair(i)):
            heapq.heappush(heap, (found[0], i, symbol[i], symbol[after[i]], found[1]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, left, right, made = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != left or j >= n or symbol[j] != right:  # one of them has merged since (a symbol merged away is -1)
            continue
        symbol[i], symbol[j] = made, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(before[i])
        push(i)
    return np.array([s for s in symbol if s >= 0], np.int32)


def encode_words(v: Vocabulary, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each word) of words of code points."""
    table = _symbols(v)
    symbols = table[points]
    long = np.flatnonzero(sizes > LONG)
    begin = np.cumsum(sizes) - sizes
    if len(long):
        usual = np.flatnonzero((sizes <= LONG) & (sizes > 0))
        made, counts = merge_rounds(v, symbols[K.ragged(begin[usual], sizes[usual])], sizes[usual])
        parts = [merge_heap(v, symbols[begin[w] : begin[w] + sizes[w]]) for w in long.tolist()]
        words = np.concatenate([np.repeat(usual, counts), np.repeat(long, [len(p) for p in parts])])
        order = np.argsort(words, kind="stable")
        symbols, counts = np.concatenate([made, *parts])[order], np.bincount(words, minlength=len(sizes))
    else:
        symbols, counts = merge_rounds(v, symbols, sizes)
    strange = np.flatnonzero(symbols >= v.size)
    if not len(strange):
        return symbols, counts
    # characters without a piece: a piece for each byte
    parts = [chr(c).encode() for c in (symbols[strange] - v.size).tolist()]
    times = np.ones(len(symbols), np.int64)
    times[strange] = [len(p) for p in parts]
    ids = np.repeat(symbols, times)
    ids[K.ragged((np.cumsum(times) - times)[strange], times[strange])] = v.byte_ids[np.frombuffer(b"".join(parts), np.uint8)]
    words = np.repeat(np.arange(len(counts)), counts)
    return ids, np.bincount(words, weights=times, minlength=len(counts)).astype(np.int64)


_TABLES: dict[int, np.ndarray] = {}


def _symbols(v: Vocabulary) -> np.ndarray:
    """The symbol of every code point; blanks are pieces' blanks."""
    if id(v) not in _TABLES:
        table = np.arange(0x110000, dtype=np.int32) + v.size
        for piece, i in v.ids.items():
            if len(piece) == 1:
                table[ord(piece)] = i
        table[0x20] = table[ord(BLANK)]
        _TABLES.clear()
        _TABLES[id(v)] = table
    return _TABLES[id(v)]


def encode_block(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of the texts' ids) of a block of texts in UTF-8, without an end id."""
    data, offsets, _ = clean_utf8(data, offsets)
    raw = data.tobytes()
    if BLANK_UTF8 in raw:  # a blank either way
        rows = [raw[a:b].replace(BLANK_UTF8, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    full = np.diff(offsets) > 0
    heads = offsets[:-1][full]
    data = np.insert(data, heads, 0x20)  # each text that is not empty begins with a blank
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    blank = data == 0x20
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[offsets[:-1][full]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    _, index, inverse = np.unique(K.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    begin, size = starts[index], (ends - starts)[index]
    words = data[K.ragged(begin, size)]
    lead = (words & 0xC0) != 0x80
    points = np.frombuffer(words.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.add.reduceat(lead, np.cumsum(size) - size, dtype=np.int64)
    ids, counts = encode_words(v, points, chars)
    first = np.cumsum(counts) - counts
    lengths = counts[inverse]
    made = np.concatenate([[0], np.cumsum(lengths)])
    return ids[K.ragged(first[inverse], lengths)], made[np.searchsorted(starts, offsets)]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, end: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text, as the sentencepiece library encodes it; end: with the
    end id after each text.

    A null text counts as empty and has the end id alone. Rows are independent: repeated ones, null ids and ties give
    a row each. Other columns are not read. Bytes that are no UTF-8 count as U+FFFD.
    """
    bounded_batches(docs.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch, size=BLOCK):
                ids, at = encode_block(v, data, offsets)
                if end:
                    ids, at = np.insert(ids, at[1:], v.end), at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], schema=schema)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>")


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    """A replacement character for each byte that is no UTF-8."""
    return "�" * (error.end - error.start), error.end


def decode_block(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that lists of ids stand for: control ids give nothing, a blank that leads the
    first piece goes, and bytes that are no UTF-8 give U+FFFD each."""
    lengths = (v.at[1:] - v.at[:-1])[ids]
    data = v.blob[K.ragged(v.at[ids], lengths)]
    at = np.concatenate([[0], np.cumsum(lengths)])
    seen = np.flatnonzero(~v.control[ids])
    first = np.searchsorted(seen, offsets[:-1])
    some = first < np.searchsorted(seen, offsets[1:])
    leads = seen[first[some]]
    leads = leads[v.blank_first[ids[leads]]]
    keep = np.ones(len(data), bool)
    keep[at[leads]] = False
    data, at = data[keep], np.concatenate([[0], np.cumsum(keep)])[at]
    raw = data.tobytes()
    parts = np.flatnonzero(v.control[ids[1:-1]] & v.byte[ids[2:]]) + 1 if len(ids) > 2 else np.zeros(0, np.int64)
    try:
        raw.decode()
        if not len(parts):
            return data, at[offsets]
    except UnicodeDecodeError:
        pass
    # bytes on both sides of a control id make no character together
    cuts = np.unique(np.concatenate([at[offsets], at[parts]]))
    pieces = [raw[a:b].decode(errors="beliefline.one_each").encode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    ends = np.cumsum([0, *map(len, pieces)])
    return np.frombuffer(b"".join(pieces), np.uint8), ends[np.searchsorted(cuts, at[offsets])]


def _register() -> None:
    import codecs

    codecs.register_error("beliefline.one_each", _one_each)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets; null lists are empty."""
    lengths = np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def decode(encoded: DataFrame, *, model_path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of each row of encode()'s result; null lists count as empty."""
    path = model_path or public_tokenizers.path(MODEL)
    kind = encoded.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _register()
        v = vocabulary(path)
        for batch in batches:
            data, at = decode_block(v, *_lists(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind.simpleString()}, text string")


def round_trip(encoded: DataFrame, *, model_path: str | None = None) -> DataFrame:
    """n_tokens and the digests of each row's ids, as decimals with blanks between, and of the text they decode to."""
    path = model_path or public_tokenizers.path(MODEL)
    kind = encoded.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _register()
        v = vocabulary(path)
        for batch in batches:
            ids, offsets = _lists(batch.column(1))
            for i, j in K.chunks(4 * offsets):
                mine, at = ids[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                data, out = decode_block(v, mine, at)
                digits, ends = joined(mine, np.full(len(mine), ord(" "), np.uint8))
                ends = np.concatenate([[0], ends])
                raw, text = memoryview(digits.tobytes()), memoryview(data.tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist(), strict=True)], pa.string()),
                    pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True)], pa.string()),
                ], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@lru_cache(maxsize=1)
def _decimals() -> np.ndarray:
    """The decimal digits of 0 to 99,999 in ASCII, zeros after them; a row has room for a separator."""
    return np.array([b"%d" % i for i in range(100_000)], "S6").view(np.uint8).reshape(-1, 6)


def joined(numbers: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each number's) of numbers below 100,000 in decimals, each with its separator after it."""
    rows = _decimals()[numbers]
    size = (rows != 0).sum(axis=1)
    rows[np.arange(len(rows)), size] = separators
    return rows[rows != 0], np.cumsum(size + 1)
