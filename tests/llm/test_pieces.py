"""SentencePiece encoding and decoding against the library, and the alignment of two tokenizers against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beliefline.llm import alignment, pieces
from beliefline.llm.common import table

MODEL = public_tokenizers.path(pieces.MODEL)
AWKWARD = [
    None, "", " ", "  ", "a", " a", "a  b ", "a\x00b", "▁x ▁▁", "<s>hi</s> <0x41> <unk> <|endoftext|>", "日本語の文字 \U0001F600 é é", "\n\n\tx\r\n", "﻿x", "it's we'll 'tis ''s 'S", "7 77 7²",
    "   lots     of      spaces                                     end ", " " * 1000, "a" * 5000, "the" * 2000, "\t" * 300 + " " * 300, "日本" * 3000, "long text " * 60_000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def noise(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    parts = ["a", "b", "th", "e", " ", "  ", "ing", "\n", "é", "日", "x", "😀", "ab", "'", "s", "1", ".", "͸"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 300))) for _ in range(n)]


def frame(spark, texts):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]  # ids repeat, one is null
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)


def encode_all(texts):
    rows = [t.encode() for t in texts]
    return pieces.encode_block(pieces.vocabulary(MODEL), np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))


def test_encodes_as_the_library(spark, sf_dir, library):
    texts = [t or "" for t in AWKWARD] + noise(300) + [r[0] or "" for r in table(spark, sf_dir, "documents").select("text").collect()]
    ids, at = encode_all(texts)
    for i, want in enumerate(library.encode(texts)):
        assert ids[at[i] : at[i + 1]].tolist() == want, texts[i][:60]


def test_rounds_and_heap_agree():
    v = pieces.vocabulary(MODEL)
    for text in [t for t in AWKWARD if t and len(t) < 3000] + noise(60, 9):
        points = np.frombuffer(("▁" + text).encode("utf-32-le"), np.uint32)
        symbols = pieces._symbols(v)[points]
        made, counts = pieces.merge_rounds(v, symbols, np.array([len(symbols)]))
        assert made.tolist() == pieces.merge_heap(v, symbols).tolist() and counts.tolist() == [len(made)]


def test_decodes_any_ids_as_the_library(spark, library):
    rng = random.Random(5)
    pick = [lambda: rng.randrange(32000), lambda: rng.randrange(3, 259), lambda: rng.choice([0, 1, 2, 259, 28705]), lambda: rng.choice([196, 197, 229]), lambda: rng.randrange(131, 195)]
    lists = [[rng.choice(pick)() for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    rows = [(i, x) for i, x in enumerate(lists)] + [(None, None), (7, [])]
    got = Counter((r["doc_id"], r["text"]) for r in pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect())
    assert got == Counter((i, library.decode(x or [])) for i, x in rows)


def test_round_trip_of_awkward_rows(spark, library):
    texts = AWKWARD + noise(20)
    got = Counter(tuple(r) for r in pieces.round_trip(pieces.encode(frame(spark, texts))).collect())
    want = Counter()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want[(None if i == 3 else i // 2, len(ids), *digest)] += 1
    assert got == want
    assert pieces.round_trip(pieces.encode(frame(spark, AWKWARD).limit(0))).count() == 0


def test_other_models_are_refused(tmp_path):
    bad = tmp_path / "other.model"
    bad.write_bytes(bytes([10, 7, 10, 5]) + b"</s>x")
    with pytest.raises(ValueError):
        pieces.Vocabulary(str(bad))


def plain_alignment(library, texts):
    left = Tokenizer.from_file(public_tokenizers.path(alignment.LEFT))
    left.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    a_bytes = {i: bytes(names.get(c, 63) for c in t) for t, i in left.get_vocab().items()}
    b_bytes = lambda i: bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()
    rows = []
    for t in texts:
        a = left.encode(" " + t, add_special_tokens=False).ids if t else []
        b = library.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        ends = []
        for ids, size in ((a, a_bytes.get), (b, b_bytes)):
            at, mine = 0, []
            for i in ids:
                at += len(size(i))
                mine.append(at)
            ends.append(mine)
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            left_ids, right_ids = [], []
            while i < len(a) and ends[0][i] <= cut:
                left_ids.append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                right_ids.append(b[j])
                j += 1
            groups.append((left_ids, right_ids))
            links.append((left_ids[-1], right_ids[-1]))
        rows.append((len(a), len(b), groups, links))
    counts = Counter(x for *_, links in rows for x in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for n_a, n_b, groups, links in rows:
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""))
    return out, counts


@pytest.mark.parametrize("shards", [1, 5])
def test_alignment_against_plain_loops(spark, library, shards):
    texts = AWKWARD[:-1] + ["long text " * 6000] + noise(80, 3)
    want, counts = plain_alignment(library, texts)
    got = alignment.cross_align(frame(spark, texts), shards=shards)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got.collect()) == Counter((None if i == 3 else i // 2, *w) for i, w in enumerate(want))
    pairs = alignment.pair_counts(alignment.align(frame(spark, texts)))
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(counts)


def test_alignment_of_the_documents(spark, sf_dir, library):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want, _ = plain_alignment(library, [r["text"] for r in rows])
    got = alignment.cross_align(table(spark, sf_dir, "documents"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got.collect()} == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}


def test_alignment_spells_groups_and_takes_no_rows(spark):
    one = alignment.align(spark.createDataFrame([("x", "a b", 1)], "doc_id string, text string, keys int"), groups=True).first()
    assert hashlib.sha256(one["groups"].encode()).hexdigest() == one["groups_sha256"] and one["groups"].count(";") == one["n_groups"] - 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.cross_align(none).count() == 0
    assert alignment.cross_align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).agg(F.sum("n_a"), F.sum("count_sum")).first()[:] == (0, 0)


def test_every_character_splits_as_the_library():
    left = alignment.byte_level(public_tokenizers.path(alignment.LEFT))
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(1, 0x3000, 64)]
    rows = [t.encode() for t in texts]
    ids, at = left.encode_block(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))
    for i, e in enumerate(left.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, hex(1 + 64 * i)
