"""Chat formatting by columnar byte assembly, and reading the format back.

A turn is ``<turn "role">``, a line feed, the text, a line feed, ``</turn>`` and a line feed; the role is a JSON string
or null. A backslash stands before each backslash, ``<turn`` and ``</turn>`` of a text, so what the template writes
cannot be mistaken for text and unescaping gives the text back. For a batch of turns, lengths of headers and contents
give cumulative offsets and scatter indices, with which numpy copies all bytes into one preallocated buffer.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernels as K
from .common import bounded_batches

OPEN, CLOSE, ESCAPE = "<turn", "</turn>", "\\"
LEARNT = "assistant"
_TURN = re.compile(r'<turn (null|"(?:[^"\\]|\\.)*")>\n(.*?)\n</turn>\n', re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(texts: pa.Array) -> pa.Array:
    """Texts with a backslash before what the template could be confused with; null becomes empty."""
    out = pc.replace_substring(pc.fill_null(texts, ""), ESCAPE, 2 * ESCAPE)
    for control in (OPEN, CLOSE):
        out = pc.replace_substring(out, control, ESCAPE + control)
    return out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets of turns, starts and ends of the contents) of formatted turns."""
    codes = pc.dictionary_encode(roles, null_encoding="encode")
    heads = [f"{OPEN} {json.dumps(r, ensure_ascii=False)}>\n".encode() for r in codes.dictionary.to_pylist()]
    tail = np.frombuffer(f"\n{CLOSE}\n".encode(), np.uint8)
    blob, size = np.frombuffer(b"".join(heads), np.uint8), np.array([len(h) for h in heads], np.int64)
    code = codes.indices.to_numpy()
    content, at = K.utf8(escape(texts))
    head, body = size[code], np.diff(at)
    offsets = np.concatenate([[0], np.cumsum(head + body + len(tail))])
    out = np.empty(offsets[-1], np.uint8)
    begin = offsets[:-1] + head
    out[K.ragged(offsets[:-1], head)] = blob[K.ragged((np.cumsum(size) - size)[code], head)]
    out[K.ragged(begin, body)] = content
    out[K.ragged(begin + body, np.full(len(body), len(tail)))] = np.tile(tail, len(body))
    return out, offsets, begin, begin + body


def _format(conv: pa.DataType, learnt: str):
    schema = pa.schema([("conv_id", conv), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            conv_ids = batch.column(0)
            out, offsets, begin, end = assemble(batch.column(1), batch.column(2))
            codes = pc.dictionary_encode(conv_ids, null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            edges = np.append(first, len(codes))
            learn = np.flatnonzero(pc.fill_null(pc.equal(batch.column(1), learnt), False).to_numpy(zero_copy_only=False))
            owner = np.searchsorted(first, learn, "right") - 1
            base = offsets[first]
            lists = pa.array(np.searchsorted(learn, edges).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                conv_ids.take(pa.array(first)), pa.array(piece + np.arange(len(first))), pa.array(np.diff(edges)),
                pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets[edges].astype(np.int32)), pa.py_buffer(out)]),
                pa.ListArray.from_arrays(lists, pa.array(begin[learn] - base[owner])), pa.ListArray.from_arrays(lists, pa.array(end[learn] - base[owner])),
            ], schema=schema)
            piece += len(first)

    return run


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learnt: str = LEARNT) -> DataFrame:
    """conv_id, piece, n_turns, formatted, loss_starts, loss_ends (byte ranges of the learnt role's escaped texts).

    A conversation is the concatenation of its pieces by ``piece``. Turns are dealt by ranges of (conversation, turn),
    so a conversation of any length is formatted by many tasks, each with a bounded batch at a time. Ties in turn are
    ordered by role, then text; nulls come first. Rows with a null conversation form one of their own; null texts are
    empty, null roles stay null and are not learnt; repeated rows are turns of their own. Other columns are not read.
    """
    spark = bounded_batches(turns.sparkSession)
    kind = turns.schema[conv_col].dataType
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    name = kind.simpleString()
    return rows.select("conv_id", "role", "text").mapInArrow(_format(to_arrow_type(kind), learnt), f"conv_id {name}, piece long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>")


def read_turns(formatted: str) -> list[tuple[str | None, str]]:
    """(role, text) of each turn of a formatted piece."""
    return [(json.loads(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.n, self.learnt, self.chars = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text in read_turns(formatted):
            self.turns.update(f"{role or ''}\n{text}\n".encode())
            self.n += 1
        raw = formatted.encode()
        for a, b in zip(starts, ends, strict=True):
            text = unescape(raw[a:b].decode())
            self.loss.update(text.encode())
            self.learnt += len(text)
        self.chars += len(formatted)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its pieces."""
    kind = formatted.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        done: list[_Digest] = []

        def out() -> pa.RecordBatch:
            rows = [(d.conv_id, d.n, d.turns.hexdigest(), d.learnt, d.loss.hexdigest(), d.chars) for d in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        done.append(now)
                    now = _Digest(row["conv_id"])
                now.add(row["formatted"], row["loss_starts"], row["loss_ends"])
            if done:
                yield out()
        if now is not None:
            done.append(now)
            yield out()

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss_starts", "loss_ends")
    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The same in DuckDB's SQL.
ORACLE = r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn, role nulls first, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<turn ' || coalesce('"' || role || '"', 'null') || '>' || chr(10)
                  || replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn>', '\</turn>') || chr(10) || '</turn>' || chr(10)))::bigint as formatted_chars
from turns group by conv_id
"""
