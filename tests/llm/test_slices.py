"""Cuts of texts for the alignment of passages, and how far two sequences run on alike."""

import numpy as np
import pyarrow as pa

from beliefline.llm import substrings
from beliefline.llm import textkernels as K


def test_a_text_asked_for_by_many_pairs_is_split_once(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(400)), "é a B c", " ".join(f"W{i}" for i in range(300))]
    asked = [(0, 100, 160), (0, 0, 50), (0, 390, 400), (1, 0, 4), (1, 3, 9), (2, 5, 60), (0, 20, 30)]
    columns = [pa.array(range(len(asked))), pa.array([9] * len(asked)), pa.array([0] * len(asked), pa.int32()), pa.array([None] * len(asked), pa.list_(pa.int64())), pa.array([t for t, _, _ in asked]), pa.array([x for _, x, _ in asked], pa.int32()), pa.array([x for _, _, x in asked], pa.int32()), pa.array([texts[t] for t, _, _ in asked])]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "source_doc_id", "side", "diagonals", "digest", "low", "high", "text"])
    seen, words = [], K.Words
    monkeypatch.setattr(K, "Words", lambda data, offsets, lower=False: seen.append(len(offsets) - 1) or words(data, offsets, lower))
    rows = [r for b in substrings._slices(pa.int64(), 10)(iter([batch])) for r in b.to_pylist()]
    assert sum(seen) == 4  # each text once where it stands together
    for r, (t, low, high) in zip(rows, asked, strict=True):
        split = texts[t].split()
        assert r["text"].split() == split[max(low - 10, 0) : high + 10] and r["first_word"] == max(low - 10, 0)
        assert texts[t].encode()[r["first_byte"] :].startswith(r["text"].encode())


def test_minimisers_against_plain_groups():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 3, n))) for n in (0, 1, 4, 5, 8, 9, 60, 500)]
    data = "".join(texts).encode()
    words = K.Words(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), lower=True)
    want: dict = {}
    for h, row, place in zip(*(x.tolist() for x in substrings.occurrences(words)), strict=True):
        low, high = want.get((row, h), (place, place))
        want[row, h] = (min(low, place), max(high, place))
    got = list(zip(*(x.tolist() for x in substrings.minimisers(words)), strict=True))
    assert {(row, h): (low, high) for h, row, low, high in got} == want and len(got) == len(want)


def test_extension_ends_at_the_first_best_score():
    rng = np.random.default_rng(5)
    for _ in range(500):
        n = int(rng.integers(0, 300))
        a = rng.integers(0, 4, n)
        b = np.where(rng.random(n) < rng.random() * 0.5, 9, a)
        score = top = words = 0
        for i in range(n):
            score += 1 if a[i] == b[i] else -1
            if score > top:
                top, words = score, i + 1
            if score <= top - 3:
                break
        assert substrings._extend(a, b) == (words, int((a[:words] != b[:words]).sum()))


def test_short_gaps_need_no_table():
    rng = np.random.default_rng(6)

    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(plain(a[1:], b) + 1, plain(a, b[1:]) + 1, plain(a[1:], b[1:]) + (a[0] != b[0]))

    for _ in range(300):
        a, b = (rng.integers(0, 3, int(rng.integers(0, 5))).tolist() for _ in range(2))
        assert substrings.edit_distance(a, b) == plain(a, b)
