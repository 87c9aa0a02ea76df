"""Components of texts of one template against all pairs, and the candidates of the exact join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beliefline.llm import minhash, substrings


def template(n: int, words: int, changed: int, pool: int, seed: int = 3) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    base, slots = [f"t{i}" for i in range(words)], sorted(rng.sample(range(words), changed))
    rows = []
    for i in range(n):
        text = list(base)
        for s in slots:
            text[s] = f"v{rng.randrange(pool)}"
        rows.append((i, " ".join(text)))
    return rows


def shingled(text: str) -> set:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked(a: set, b: set) -> bool:
    both = len(a & b)
    return 100 * both >= 75 * (len(a) + len(b) - both)


def components(sets: list[set]) -> list[int]:
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if root(i) != root(j) and linked(sets[i], sets[j]):
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("changed,pool", [(8, 10**9), (10, 50), (12, 4)])
def test_templates_against_all_pairs(spark, changed, pool):
    rows = template(250, 200, changed, pool)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i, _ in rows] == components([shingled(t) for _, t in rows])


def test_no_link_is_ruled_out(spark):
    rng = random.Random(8)
    rows = template(60, 120, 6, 9) + [(100 + i, " ".join(t.split()[: rng.randint(70, 120)])) for i, t in template(60, 120, 3, 3, 5)] + [(200, "t1 t2 t3"), (201, "t1 t2 t3 t4")]
    sets = {i: shingled(t) or {tuple(t.split())} for i, t in rows}
    texts = spark.createDataFrame(rows, "set_id long, text string")
    for component in ("set_id", "set_id % 2"):
        sized = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "set_id long, n_shingles long").withColumn("component", F.expr(component))
        got = {frozenset(r[:]) for r in minhash.candidates(sized, texts).select("a", "b").collect()}
        of = (lambda x: x) if component == "set_id" else (lambda x: x % 2)
        pairs = {frozenset((i, j)) for i in sets for j in sets if i < j and of(i) != of(j)}
        links = {p for p in pairs if linked(*(sets[x] for x in p))}
        assert links and links <= got <= pairs and len(got) < len(pairs)
    assert minhash.candidates(sized.limit(0), texts.limit(0)).count() == 0


def _text(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def _changed(rng, words, share):
    at = set(rng.sample(range(len(words)), round(share * len(words))))
    return [f"x{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]


@pytest.mark.parametrize("length,share", [(50, 0.05), (50, 0.15), (50, 0.2), (50, 0.24), (60, 0.24), (80, 0.24), (120, 0.24)])
def test_fuzzy_passages_by_length_and_share(spark, length, share):
    rng, rows = random.Random(length + round(100 * share)), []
    groups = 60 if (length, share) != (50, 0.24) else 250  # hardly any is still a passage there
    for g in range(groups):
        p = _text(rng, length)
        rows += [(2 * g, _text(rng, 30) + p + _text(rng, 30)), (2 * g + 1, _text(rng, 30) + _changed(rng, p, share) + _text(rng, 30))]
    hashed = [np.array([hash(w) & 0xFFFFFFFFFFFF for w in t], np.uint64) for _, t in rows]
    there = {2 * g + 1 for g in range(groups) if substrings.passages(hashed[2 * g + 1], hashed[2 * g])}
    found = substrings.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"))
    got = {r["doc_id"] for r in found.select("doc_id").collect()}
    assert len(there) > 10 and len(there & got) >= 0.9 * len(there), (len(there), len(there & got))


def test_short_pieces_do_not_hide_a_fuzzy_passage(spark):
    rng, rows = random.Random(5), []
    for g in range(30):
        p = _text(rng, 100)
        rows += [(10 * g, p[:40] + _text(rng, 60) + p[60:]), (10 * g + 1, _text(rng, 30) + p + _text(rng, 30)), (10 * g + 2, _text(rng, 30) + _changed(rng, p, 0.1) + _text(rng, 30))]
    found = substrings.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"))
    got = {(r["doc_id"], r["source_doc_id"]) for r in found.select("doc_id", "source_doc_id").collect()}
    assert sum((10 * g + 2, 10 * g + 1) in got for g in range(30)) >= 28
