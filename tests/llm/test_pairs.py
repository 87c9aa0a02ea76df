"""Passages of many pairs at once: equal to those of plain loops over each pair, and cheap for each."""

import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa

from beliefline.llm import substrings
from beliefline.llm import textkernels as K

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("source_doc_id", pa.int64()), ("side", pa.int32()), ("diagonals", pa.list_(pa.int64())), ("digest", pa.int64()), ("first_word", pa.int64()), ("first_byte", pa.int64()), ("text", pa.string())]
)


def plain(a, b, diagonals, k=5, min_words=50):
    """passages() with a loop for each step up to the chains."""
    if len(a) < min_words or len(b) < min_words:
        return []
    if a == b:
        return [(0, len(a), 0, len(b), 1.0)]
    where, seen, met = defaultdict(list), defaultdict(int), []
    for y in range(len(b) - k + 1):
        where[tuple(b[y : y + k])].append(y)
    for x in range(len(a) - k + 1):
        key = tuple(a[x : x + k])
        if key in where:
            met.append((x, where[key][min(seen[key], len(where[key]) - 1)]))
            seen[key] += 1
    parts = set()
    for i, (x, y) in enumerate(met):
        if not i or (x - 1, y - 1) != met[i - 1]:
            n = 1
            while i + n < len(met) and met[i + n] == (x + n, y + n):
                n += 1
            parts.add((x, y, n - 1 + k))
    for d in diagonals:
        run = 0
        for x in range(max(0, d), min(len(a), len(b) + d) + 1):
            if x < min(len(a), len(b) + d) and a[x] == b[x - d]:
                run += 1
            else:
                if run >= k:
                    parts.add((x - run, x - run - d, run))
                run = 0
    return substrings._chained(np.array(a, np.uint64), np.array(b, np.uint64), sorted(parts), min_words, 0.75, 24) if parts else []


def drawn(rng, n):
    """Texts that share, repeat, lose and change passages, some shorter than any passage."""
    stock = [rng.integers(0, 400, int(m)).tolist() for m in rng.integers(20, 120, 6)]
    texts = []
    for _ in range(n):
        text = []
        for p in rng.choice(len(stock), int(rng.integers(0, 4))):
            copy = [w for w in stock[p] if rng.random() > 0.03]
            text += [*copy, *rng.integers(0, 400, int(rng.integers(0, 40))).tolist()]
        texts.append(text)
    return [*texts, stock[0] * 3, stock[0] * 3, [7] * 90, [7] * 60, []]


def test_many_pairs_against_plain_loops():
    rng, found = np.random.default_rng(11), 0
    for _ in range(6):
        texts = drawn(rng, 20)
        first = np.cumsum([0, *map(len, texts)])
        a, b = rng.integers(0, len(texts), 60), rng.integers(0, len(texts), 60)
        lines = [rng.integers(-80, 80, int(rng.integers(0, 4))).tolist() for _ in a]
        of = np.repeat(np.arange(len(a)), [len(x) for x in lines])
        hashed = np.array(sum(texts, []), np.uint64)
        got = substrings.passages_of_pairs(hashed, first, a, b, of, np.array(sum(lines, []), np.int64))
        want = [(i, *p) for i in range(len(a)) for p in plain(texts[a[i]], texts[b[i]], lines[i])]
        assert sorted(got) == sorted(want)
        found += len(want)
        for i in range(10):
            assert [(i, *p) for p in substrings.passages(hashed[first[a[i]] : first[a[i] + 1]], hashed[first[b[i]] : first[b[i] + 1]], diagonals=tuple(lines[i]))] == [w for w in want if w[0] == i]
    assert found > 50


def rows_of(rng, pairs):
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows = []
    for i in range(pairs):
        shared = word(60)
        rows.append((2 * i + 1, 2 * i, 0, [0, 3], 2**62 + 2 * i + 1, 5, 40, f"{word(8)} {shared} {word(9)}"))
        rows.append((2 * i + 1, 2 * i, 1, None, 2**62 + 2 * i, 2, 17, f"{word(5)} {shared} {word(3)}"))
    return rows


def batch_of(rows):
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def aligned(*batches):
    return sorted(tuple(r.values()) for b in substrings._align(pa.int64(), {})(iter(batches)) for r in b.to_pylist())


def test_a_pair_over_blocks_and_batches(monkeypatch):
    rows = rows_of(np.random.default_rng(12), 12)
    rows.insert(1, (*rows[0][:4], rows[0][4] + 2, *rows[0][5:7], "more " + rows[0][7]))  # a row that repeats its id
    whole = aligned(batch_of(rows))
    assert len(whole) == 13 and {r[2] for r in whole} == {r[4] for r in rows if not r[2]}
    text = rows[-2][7].encode()
    last = next(r for r in whole if r[0] == rows[-2][0])
    assert last[3:7] == (13, 73, 7, 67) and text[last[7] - 40 : last[8] - 40].decode().split() == rows[-2][7].split()[8:68]
    assert aligned(*(batch_of([r]) for r in rows)) == whole
    monkeypatch.setattr(K.text_blocks, "__defaults__", ("text", 1000))
    assert aligned(batch_of(rows)) == whole


def test_calls_a_pair():
    batch = batch_of(rows_of(np.random.default_rng(13), 400))
    aligned(batch)
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = aligned(batch)
    finally:
        sys.setprofile(None)
    assert len(found) == 400 and calls[0] < 75 * 400, calls[0] / 400
