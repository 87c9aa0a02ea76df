"""Importance resampling against a plain count of runs of words, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from beliefline.llm import resampling

COLUMNS = ["n_words", "n_features", "weight", "score", "rank"]


def plain(docs, target, n, buckets, seed, min_words, percent):
    def scan(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        runs = [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r) % buckets for r in runs]

    rows = [(i, *scan(t)) for i, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in scan(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, w, f in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, w, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=str)


AWKWARD = [(1, None), (2, ""), (3, "one two three"), (4, "one two three"), (5, "Ünïcode wörter, Ünïcode 日本 7up"), (6, "a" * 300_000), (7, "x y " * 400_000), (None, "two three four"), (None, "null id " * 5), (9, "\x00 \n ;;"), (3, "one two three")]


@pytest.mark.parametrize("n", [1, 3])
def test_against_plain_counts(spark, n):
    docs = AWKWARD + [(100 + i, " ".join(f"w{(i * k) % 37}" for k in range(i))) for i in range(60)]
    target = ["w1 w2 w3 w4", "one two", None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("weight", F.lit("x")).withColumn("buckets", F.lit(1)).repartition(3)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=500, seed=7, min_words=2, percent=40)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target, n, 500, 7, 2, 40)


def test_no_rows_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    rows = resampling.resample(spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string"), none, percent=100).collect()
    assert [(r["n_features"], r["rank"]) for r in rows] == [(30, 1)]


def test_words_that_cross_pieces(spark, monkeypatch):
    text = b" ".join(b"w%d" % (i % 11) for i in range(500))
    whole = [x.tolist() for _, x in resampling.ring_scan(resampling.word_pieces(text), 3)]
    monkeypatch.setattr(resampling, "PIECE", 16)
    parts = [x.tolist() for _, x in resampling.ring_scan(resampling.word_pieces(text), 3)]
    assert len(parts) > 50 and sum(parts, []) == whole[0]


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 25, i % 3) for i in range(40)], "doc_id long, text string, rank int")
    drawn = resampling.resample(docs, docs.where("doc_id < 5"), percent=50)
    kept = resampling.drawn_documents(docs, drawn)
    assert kept.columns == docs.columns and kept.count() == 20
    assert {r[0] for r in kept.select("doc_id").collect()} >= set(range(5)), "the target's own documents are likeliest"


def test_places_of_ties(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(1000)], "score long, id long").repartition(7)
    placed = resampling.with_places(rows, F.col("score").desc(), F.col("id"))
    got = [(r["score"], r["id"]) for r in sorted(placed.collect(), key=lambda r: r["place"])]
    assert got == sorted(((i % 3, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert sorted(r[0] for r in placed.select("place").collect()) == list(range(1, 1001))
