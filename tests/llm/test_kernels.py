"""Word, shingle and pre-token kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from beliefline.llm import bpe, cws, minhash, substrings
from beliefline.llm import textkernels as K

TEXTS = st.lists(st.text(alphabet=st.one_of(st.sampled_from("abAB \t\n\x0b\x1c\x85 é中"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=8)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(texts, lower=False):
    return K.Words(*K.utf8(pa.array(texts, pa.string())), lower=lower)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    w = words_of(texts)
    assert w.counts.tolist() == [len(WORD.findall(t.encode())) for t in texts]
    seen = {}
    for word, h in zip([m for t in texts for m in WORD.findall(t.encode())], w.hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    _, o = K.shingle_sets(words_of(texts, lower=True))
    want = []
    for t in texts:
        w = WORD.findall(t.encode().lower())
        want.append(len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    assert np.diff(o).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZé1٣ \t\n 'strevmld-!中"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), max_size=5))
def test_pre_tokens_as_the_pattern_has_them(texts):
    import public_tokenizers
    import regex

    data, offsets = K.utf8(pa.array(texts, pa.string()))
    data, offsets, points = bpe.clean_utf8(data, offsets)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, offsets)
    starts = bpe.pre_tokens(points, first[:-1])
    pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}"))
    want = [f + m.start() for f, t in zip(first[:-1].tolist(), texts, strict=True) for m in pattern.finditer(t)]
    assert starts.tolist() == want


def test_densified_bins_collide_like_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(1, 2**63, 60).astype(np.uint64))
    b = np.unique(np.concatenate([a[:48], rng.integers(1, 2**63, 12).astype(np.uint64)]))
    both = np.concatenate([a, b])
    sig = minhash.densified(both, np.array([0, len(a), len(both)]), 2048)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12
    assert (minhash.densified(np.array([7], np.uint64), np.array([0, 1]), 128) == 7).all()


def test_weighted_samples_estimate_generalised_jaccard():
    a, b = "x " * 6 + "y " * 3 + "z w v", "x " * 3 + "y " * 3 + "z q r s"
    sig = cws.signatures(*K.utf8(pa.array([a, b, a, "", " \n"])), 4096)
    true = (3 + 3 + 1) / (6 + 3 + 1 + 1 + 1 + 3)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03
    assert (sig[0] == sig[2]).all() and (sig[3] == 0).all() and (sig[4] == 0).all()


def test_chains_follow_both_texts():
    parts = [(0, 0, 10), (12, 11, 10), (5, 40, 8), (30, 30, 10)]
    best = substrings.chains(parts)[0]
    assert best == [(0, 0, 10), (12, 11, 10), (30, 30, 10)]
    assert sorted(p for c in substrings.chains(parts) for p in c) == sorted(parts)


def test_chain_scores_match_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        parts = [(int(x), int(y), int(n)) for x, y, n in zip(rng.integers(0, 60, 9), rng.integers(0, 60, 9), rng.integers(5, 9, 9), strict=True)]
        score = {}
        for p in sorted(parts):
            before = [score[q] - 0.2 * (p[0] - q[0] - q[2] + p[1] - q[1] - q[2]) for q in score if q[0] + q[2] <= p[0] and q[1] + q[2] <= p[1]]
            score[p] = max(score.get(p, 0), p[2] + max([0.0, *before]))
        chain = substrings.chains(parts)[0]
        total = chain[0][2] + sum(b[2] - 0.2 * (b[0] - a[0] - a[2] + b[1] - a[1] - a[2]) for a, b in zip(chain, chain[1:], strict=False))
        assert abs(total - max(score.values())) < 1e-9


def test_fuzzy_passages():
    rng = np.random.default_rng(4)
    p = rng.integers(1, 2**63, 80).astype(np.uint64)
    q = p.copy()
    q[[20, 45, 60]] = 1
    a = np.concatenate([rng.integers(1, 2**63, 30).astype(np.uint64), p, rng.integers(1, 2**63, 20).astype(np.uint64)])
    b = np.concatenate([rng.integers(1, 2**63, 7).astype(np.uint64), q, rng.integers(1, 2**63, 40).astype(np.uint64)])
    (found,) = substrings.passages(a, b)
    assert found[:4] == (30, 110, 7, 87) and found[4] > 0.95
    assert substrings.passages(a, rng.integers(1, 2**63, 200).astype(np.uint64)) == []
    assert substrings.passages(a, a) == [(0, len(a), 0, len(a), 1.0)]
