"""Operators that SQL cannot express, against plain Python over whole small tables; awkward rows through every stage."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from beliefline.llm import ann, cws, langid, minhash, mixing, quality, substrings, warc
from beliefline.llm import textkernels as K
from beliefline.llm.common import shared_dir

RNG = np.random.default_rng(21)
VOCABULARY = ["".join(RNG.choice(list("abcdefghij"), int(RNG.integers(2, 8)))) for _ in range(3000)]


def words(n):
    return list(RNG.choice(VOCABULARY, n))


def covered_windows(texts, n=50):
    """(id, start) of each run of n words that a text with a lesser id holds."""
    seen, out = set(), []
    for i, t in sorted(texts):
        w = t.split()
        own = {tuple(w[a : a + n]): a for a in range(len(w) - n, -1, -1)}
        out += [(i, a) for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in seen]
        seen |= set(own)
    return out


def test_every_exact_run_of_fifty_words_is_covered(spark):
    passages = [words(int(n)) for n in RNG.integers(50, 120, 25)]
    passages += [passages[0][:30] + passages[1][-30:], [*passages[2][:25], *passages[2]], [VOCABULARY[0]] * 60, words(7) * 9]
    rows = []
    for i in range(200):
        parts = [words(int(RNG.integers(5, 80)))]
        for p in RNG.choice(len(passages), int(RNG.integers(0, 4)), replace=False):
            a = int(RNG.integers(0, 12)) if RNG.random() < 0.4 else 0  # often a part of it alone
            parts += [passages[p][a : a + int(RNG.integers(40, 130))], words(int(RNG.integers(0, 60)))]
        rows.append((i, " ".join(w for p in parts for w in p)))
    found = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
        a, b = dict(rows)[r["doc_id"]].split(), dict(rows)[r["source_doc_id"]].split()
        assert r["source_doc_id"] < r["doc_id"] and r["n_words"] >= 50
        if r["identity"] == 1.0:
            assert a[r["start_word"] : r["end_word"]] == b[r["source_start_word"] : r["source_end_word"]]
    want = covered_windows(rows)
    assert len(want) > 500
    lost = []
    for i, start in want:
        words_in = set()
        for a, b in spans.get(i, ()):
            words_in.update(range(a, b))
        if len(set(range(start, start + 50)) - words_in) > 14:  # less than a window before the first seed and after the last
            lost.append((i, start))
    assert lost == []


def test_cuts_of_repeated_ids_keep_to_their_own_text(spark):
    p, other = words(80), words(200)
    rows = [(1, " ".join(words(20) + p)), (2, " ".join(p + words(30))), (2, " ".join(other)), (None, " ".join(p)), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r["doc_id"], len((r["text"] or "").split())) for r in substrings.cut(docs, substrings.repeated_passages(docs)).collect()]
    assert sorted(left, key=str) == sorted([(1, 100), (2, 30), (2, 200), (None, 80), (3, 0)], key=str)


def test_word_vectors_and_pooling(spark):
    texts = [" ".join(words(40)) + " Abc ABC 12 中文字 éà!! x" for _ in range(6)] + ["", " \n ", "A", "interest internal интерес интервал"]
    run = re.compile(r"[A-Za-z\u0080-⿿]+|[　-퟿]|[0-9]+|[^\sA-Za-z0-9\u0080-￿]+")

    def entry(r):
        data = np.frombuffer(r.encode(), np.uint8)
        letters = data[0] >= 128 or chr(data[0]).isalpha()
        upper = [65 <= x <= 90 for x in data]
        case = (upper[0] + 2 * upper[min(1, len(upper) - 1)]) if letters else 0
        h = K.hash_spans(data, np.array([0]), np.array([len(data)]), K._LOWER_BYTE)
        return int(K.mix(h + np.uint64(case + 1))[0] % np.uint64(quality.ENTRIES))

    rows = [[entry(r) for r in run.findall(t)] for t in texts]
    table = np.zeros((quality.ENTRIES, quality.DIMS))
    for es in rows:
        for i, e in enumerate(es):
            for j in range(max(0, i - quality.REACH), min(len(es), i + quality.REACH + 1)):
                if i != j:
                    for at, sign in zip(quality._PLACES[es[j]], quality._SIGNS[es[j]], strict=True):
                        table[e, at] += sign
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"))
    assert np.allclose(got, table, atol=1e-6)
    whole = pa.array(texts)
    x = quality.document_vectors(*K.utf8(whole), got)
    for i, es in enumerate(rows):
        if es:
            v = table[es]
            assert np.allclose(x[i, : quality.DIMS], v.mean(axis=0), atol=1e-5) and np.allclose(x[i, quality.DIMS : 2 * quality.DIMS], v.std(axis=0), atol=1e-3)
        else:
            assert not x[i].any()
    assert len({entry(w) for w in ("interest", "internal", "интерес", "интервал")}) == 4


def test_network_is_the_stated_one():
    x, rng = np.random.default_rng(4).normal(size=(400, 6)), np.random.default_rng(5)
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    net = quality.fit(x, y)
    w1, b1, w2, b2 = net.weights
    by_hand = [1 / (1 + np.exp(-(sum(np.tanh(sum((r[i] - net.mean[i]) / net.scale[i] * w1[i, j] for i in range(6)) + b1[j]) * w2[j] for j in range(len(w2))) + b2[0]) / net.temperature)) for r in x[:20]]
    assert np.allclose(net.score(x[:20]), by_hand) and ((net.score(x) > 0.5) == (y > 0)).mean() > 0.85


def test_edits_of_whole_texts(spark):
    texts = {i: " ".join(words(int(RNG.integers(0, 60)))) + "é" * (i % 4) for i in range(60)}
    texts |= {70: "", 71: "x"}
    got = {r["doc_id"]: r for r in cws.edited_likeness(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), parts=7).collect()}
    import hashlib

    order = sorted(texts)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[a], len(texts[a]) // 4
        edited = t[: len(t) - n] + texts[b][:n]
        assert got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[a]["n_chars"] == len(t)
        x, y = Counter(t.split()), Counter(edited.split())
        true = sum((x & y).values()) / max(sum((x | y).values()), 1) if x or y else 1.0
        assert abs(got[a]["near_edited"] - true) < 0.35
    assert got[70]["near_edited"] == 1.0


def test_weights_of_a_column(spark):
    rows = [(i, " ".join(words(10)), "a" if i % 2 else None, 9.0 if i % 3 == 0 else 0.5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    taken = {r["doc_id"]: r["times"] for r in mixing.mix(docs, weight_col="w", weights=(1, 9)).collect()}
    more = lambda heavy: np.mean([taken[i] for i, _, s, w in rows if s == "a" and (w > 1) == heavy])
    assert more(True) > more(False)


def test_a_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_paths_without_a_scheme_get_that_of_the_default_file_system(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)).startswith("file:")


LONG = " ".join(words(25_000))
ROWS = [(1, None), (2, ""), (3, " \n"), (4, LONG), (5, LONG), (6, LONG + " end"), (7, " ".join(words(90))), (7, " ".join(words(90))), (8, "same text twice"), (8, "same text twice"), (None, "no id " * 30), (None, None), (9, "é中 x")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __id long, key string, seed string, digest string, set_id string, label string, __set string"


def awkward(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if n % 3 else "s", len(t or ""), 1, "k", "s", "d", "x", "l", "y") for n, (i, t) in enumerate(rows)], COLUMNS)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_awkward_rows_pass_through_each_stage(spark, sf_dir, tmp_path, name, stage):
    docs = awkward(spark, ROWS)
    stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
    out = spark.read.parquet(str(tmp_path / name))
    if name != "tokens":
        assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    if name == "near_dedup":
        assert ids[4] == 1 and not ids[5] and not ids[6] and ids[7] == 2 and ids[8] == 1 and ids[None] == 2 and all(ids[i] for i in (1, 2, 3, 9))
    elif name == "substring_dedup":
        assert not ids[5] and ids[7] == 2 and ids[8] == 2 and ids[None] == 2 and ids[1] == 1
    elif name == "tokens":
        assert sum(ids.values()) == len(ROWS) and out.where("doc_id = 1").first()["n_tokens"] == 0
    none = stage(spark, docs.limit(0), sf_dir)
    assert none.count() == 0


def test_empty_and_repeated_tables_of_models(spark):
    docs = awkward(spark, ROWS)
    model = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (None, 1)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    assert quality.score(docs, net).count() == len(ROWS) and quality.score(docs.limit(0), net).count() == 0
    assert minhash.with_set_ids(docs, "own").where("text is null and own is null").count() == 2
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(docs.limit(0)).count() == 0
    assert docs.where(F.col("__id") == 1).count() == len(ROWS)


def test_rows_that_a_search_reranks_fall_as_a_share_of_the_table(spark, monkeypatch):
    asked, measure = [], ann.needed_rows
    monkeypatch.setattr(ann, "needed_rows", lambda *a: asked.append(measure(*a)) or asked[-1])
    rng, shares = np.random.default_rng(3), []
    for n in (1500, 15000):
        centres = rng.normal(size=(n // 20, 32))
        x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, 32))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        found = {}
        for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = [len(found[i] & set(np.argsort(np.where(np.arange(n) == i, np.inf, ((x - x[i]) ** 2).sum(axis=1)))[:10].tolist())) / 10 for i in range(0, n, 100)]
        assert np.mean(hits) >= 0.9
        shares.append(asked[-1] / n)
    assert shares[1] < 0.5 * shares[0] < 0.1
