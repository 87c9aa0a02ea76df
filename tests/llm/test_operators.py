"""Each operator on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import gzip
import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from beliefline.llm import ann, bpe, chat, cws, langid, minhash, mixing, quality, substrings, warc
from beliefline.llm.common import connected_components, shared_path

DOCS = "doc_id long, text string, lang string, source string, rank int, score double, component_id string, seed string, node string"
RNG = np.random.default_rng(11)
VOCABULARY = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(400)]


def words(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "x", "y", "z") for i, t in rows], DOCS)


LONG = words(30_000)
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, LONG), (6, "é中 ' don't   x"), (None, "no id here at all"), (None, None), (7, "one")]


def test_components(spark):
    rng = np.random.default_rng(0)
    for n, m in ((1, 0), (60, 45), (200, 260)):
        pairs = [tuple(map(int, rng.integers(0, n, 2))) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1030)]
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        parent = {}
        for a, b in pairs:
            parent.setdefault(a, a), parent.setdefault(b, b)

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        touched = {x for p in pairs if p[0] != p[1] for x in p}
        assert got == {x: find(x) for x in touched}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_truth(rows):
    ids = [i for i, _ in rows if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    rows = list(AWKWARD)
    for g in range(12):
        base = words(int(RNG.integers(5, 200))).split()
        for c in range(int(RNG.integers(2, 7))):
            w = list(base)
            for _ in range(int(RNG.integers(0, 1 + len(w) // 20))):
                w[int(RNG.integers(len(w)))] = "edited"
            rows.append((100 * (g + 1) + c, " ".join(w)))
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    truth = near_truth(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == truth[r["doc_id"]] and r["kept"] == (r["doc_id"] == truth[r["doc_id"]])
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_links_inside_a_large_bucket_of_unlinked_texts(spark):
    rng, rows = np.random.default_rng(5), []
    base = rng.choice(VOCABULARY, 400)

    def edited(w, n, tag):
        w = np.array(w, dtype=object)
        for j, at in enumerate(rng.choice(len(w), n, replace=False)):
            w[at] = f"{tag}x{j}"
        return w

    for g in range(150):  # any two about two thirds alike, each with a partner at about 0.78
        one = edited(base, 8, f"a{g}")
        rows += [(g, " ".join(one)), (1000 + g, " ".join(edited(one, 10, f"b{g}")))]
    truth = near_truth(rows)
    assert 50 < sum(truth[1000 + g] == g for g in range(150)) and len(set(truth.values())) > 100
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == truth


def test_repeated_passages(spark):
    p, q = words(70), words(55)
    fuzzy = p.split()
    fuzzy[30] = "changed"
    rows = [*AWKWARD, (20, f"{words(40)} {p} {words(30)}"), (21, f"{words(10)} {p} {q}"), (22, f"{q} {words(90)}"), (23, f"{words(5)} {' '.join(fuzzy)}"), (24, words(200)), (25, f"{words(60)} {p.upper()}")]
    found = substrings.repeated_passages(frame(spark, rows))
    got = {(r["doc_id"], r["source_doc_id"]) for r in found.collect()}
    assert {(21, 20), (22, 21), (23, 20), (25, 20)} <= got and not {d for d, _ in got} & {20, 24, 4, 5, 6}
    by = {r["doc_id"]: r for r in substrings.by_document(found).collect()}
    assert by[23]["longest"] >= 68 and by[21]["source_doc_ids"] == [20]
    rest = {r["doc_id"]: r["text"] for r in substrings.cut(frame(spark, [r for r in rows if r[0] not in (4, None)]), found).collect()}
    assert rest[20] == dict(rows)[20] and p.split()[10] not in rest[21].split() or len(rest[21].split()) == 65
    assert len(rest[22].split()) == 90 and rest[24] == dict(rows)[24]
    assert substrings.repeated_passages(frame(spark, rows).limit(0)).count() == 0


def test_passages_that_earlier_holders_hide(spark):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join("".join(x) for x in rng.choice(list("abcdefghij"), (n, 6)))
    rows, want = [], set()
    for g in range(20):  # the second holds the first 45 words of a passage that the first, third and last hold
        p, i = text(60), 10 * g
        part = " ".join(p.split()[:45])
        rows += [(i, f"{text(30)} {part} {text(30)}"), (i + 1, f"{text(30)} {p} {text(30)}"), (i + 2, f"{text(30)} {part} {text(30)}"), (i + 3, f"{text(30)} {p} {text(30)}")]
        want.add((i + 3, i + 1))
    for g in range(20):  # every five words of a passage stand in other documents before and after it
        p, i = text(60).split(), 1000 * (g + 1)
        quotes = [" ".join(x for j in range(0, 56, 8) for x in [*p[j + m : j + m + 8 + 4], *text(10).split()]) for m in (0, 4)]
        rows += [(i, quotes[0]), (i + 1, f"{text(20)} {' '.join(p)} {text(20)}"), (i + 2, quotes[1]), (i + 3, quotes[0] + " end"), (i + 4, f"{text(20)} {' '.join(p)} {text(20)}")]
        want.add((i + 4, i + 1))
    for g in range(20):  # a phrase that repeats
        p, i = " ".join([text(6)] * 14), 100_000 + 10 * g
        rows += [(i, f"{text(30)} {p} {text(30)}"), (i + 1, f"{text(30)} {p} {text(30)}")]
        want.add((i + 1, i))
    got = {(r["doc_id"], r["source_doc_id"]) for r in substrings.repeated_passages(frame(spark, rows)).collect()}
    assert want <= got, sorted(want - got)


def test_fuzzy_passages_are_proposed(spark):
    rng, rows = np.random.default_rng(9), []
    text = lambda n: ["".join(x) for x in rng.choice(list("abcdefghij"), (n, 6))]
    for g in range(100):  # 80 words of which a fifth is changed
        p = text(80)
        q = [x if i else "changed" for x, i in zip(p, rng.permutation(80) >= 16, strict=True)]
        rows += [(2 * g, " ".join([*text(30), *p, *text(30)])), (2 * g + 1, " ".join([*text(30), *q, *text(30)]))]
    texts = [np.array([hash(w) & 0xFFFFFFFFFFFF for w in t.split()], np.uint64) for _, t in rows]
    there = {2 * g + 1 for g in range(100) if substrings.passages(texts[2 * g + 1], texts[2 * g])}
    got = {r["doc_id"] for r in substrings.repeated_passages(frame(spark, rows)).collect()}
    assert len(there) > 20 and len(there & got) >= 0.9 * len(there), (len(there), len(there & got))


def test_a_passage_in_many_documents_gives_a_row_each(spark):
    p = words(80)
    rows = [(i, f"{words(20)} {p} {words(20)}") for i in range(300)]
    assert sorted(r["doc_id"] for r in substrings.by_document(substrings.repeated_passages(frame(spark, rows))).collect()) == list(range(1, 300))


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, encoding):
    rows = [*AWKWARD, (30, "<|endoftext|> I'll we've it's'd 'tis  x\n\n y"), (31, "\U0001f600" * 50 + "　  a")]
    encoded = bpe.encode(frame(spark, rows))
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect())
    assert got == Counter((i, tuple(encoding.encode_ordinary(t or ""))) for i, t in rows)
    assert Counter((r["doc_id"], bytes(r["text"])) for r in bpe.decode(encoded).collect()) == Counter((i, (t or "").encode()) for i, t in rows)
    assert bpe.encode(frame(spark, rows).limit(0)).count() == 0


def test_edited_likeness(spark):
    rows = [(i, t) for i, t in AWKWARD if i not in (None, 4)] + [(i, words(60)) for i in range(10, 60)] + [(4, "one"), (2**40, "last é中é中")]
    got = {r["doc_id"]: r for r in cws.edited_likeness(frame(spark, rows + [(None, "x")])).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(order)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()
    assert got[4]["fingerprint"] == got[7]["fingerprint"] != got[10]["fingerprint"]
    assert np.mean([got[i]["near_edited"] - got[i]["near_next"] for i in range(10, 60)]) > 0.3
    assert cws.edited_likeness(frame(spark, [(1, "only one row")])).first()["near_next"] == 1.0
    assert cws.edited_likeness(frame(spark, rows).limit(0)).count() == 0
    prints = {r["fingerprint"] for r in cws.fingerprints(frame(spark, [(1, "a b"), (2, "a b"), (None, "a b")])).collect()}
    assert len(prints) == 1


def test_language_model_matches_brute_force(spark):
    texts = {"aa": ["abab baba", "ab ba ab"], "bb": ["xyz zyx", "zzz xxy É"]}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)] + [(9, None, "aa"), (10, "abc", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb"]

    def grams(t):
        c = [x if x.isalpha() else " " for x in t.lower()]
        return Counter("".join(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1) if any(x != " " for x in c[i : i + n]))

    counts = {lang: sum((grams(t) for t in ts), Counter()) for lang, ts in texts.items()}
    size = 1 << langid.BITS
    total = {lang: sum(c.values()) + langid.SMOOTHING * size for lang, c in counts.items()}
    asked = [(1, "ab zz"), (2, None), (3, "123 !"), (4, "xyz"), (None, "bab")]
    got = langid.predict(frame(spark, asked), model).collect()
    assert len(got) == 5
    for r in got:
        t = dict(asked)[r["doc_id"]]
        if not t or not any(x.isalpha() for x in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = {lang: math.log(0.5) + sum(n * math.log((counts[lang][g] + langid.SMOOTHING) / total[lang]) for g, n in grams(t).items()) for lang in counts}
        best = max(logs, key=logs.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-4)
    empty = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(frame(spark, [(1, "abc")]), empty).first()["lang_pred"] == "und"


def test_quality(spark):
    good, bad = [words(80) + "." for _ in range(150)], [(RNG.choice(VOCABULARY).upper() + "!! ") * 30 for _ in range(60)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 150)) for i, _ in rows] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    docs = frame(spark, rows + [(i, t) for i, t in AWKWARD if i is None or i in (2, 5)])
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    sure = Counter((r["doc_id"] < 150, r["predicted"]) for r in got if r["doc_id"] is not None and r["doc_id"] > 9)
    assert sure[(True, 1)] == 140 and sure[(False, 0)] == 60
    assert quality.keep(docs, model).columns == docs.columns
    none = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(frame(spark, [(1, None)]), none).first()["score"] == pytest.approx(0.5)


def test_mixing(spark):
    rows = [(i, words(int(RNG.integers(1, 60))), s) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 5 + [None] * 20)] + [(None, None, "a"), (7, "twice", "b"), (7, "twice", "b"), (8, "", "empty")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(9)).withColumn("target", F.lit("x"))).collect()
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", "empty", None)}
    weights = {"a": 5, "b": 2, "c": 1, "empty": 5, None: 2}
    cap, goal, left = {s: 3 * n for s, n in sizes.items()}, {}, sum(sizes.values())
    open_ = set(sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = cap[s]
            left -= cap[s]
        open_ -= over
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]} and mine[0]["target"] == pytest.approx(goal[s])
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= 30
        assert all(r["taken"] == r["size"] * r["times"] and r["times"] <= 3 for r in mine)
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 200_000), (6, "u", "a\r\n\r\nWARC/1.1\r\n"), (None, "n", "lone")]
    path = shared_path(spark, "warc-test")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sum", F.lit("z"))
    warc.write(warc.with_revisits(df), path)
    got = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    assert len(got) == 7 and got["1"]["record_type"] == "revisit" and got["1"]["refers_to"] == "2" and got["3"]["refers_to"] == "4"
    for i, _, html in pages:
        raw = (html or "").encode()
        r = got["" if i is None else str(i)] if i is not None else next(r for k, r in got.items() if k not in set("123456"))
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == raw and r["computed_digest"] == r["payload_digest"]
    responses = warc.read(spark, path, payload=False).where("record_type = 'response'")
    assert responses.count() == 5 and responses.where("payload is not null").count() == 0
    assert [r["record_id"] for r in warc.read(spark, path).where("record_id in ('5') and record_type = 'response'").collect()] == ["5"]
    all_responses = warc.with_revisits(df, least=10**6)
    assert all_responses.where("record_type <> 'response'").count() == 0


def test_foreign_archives(spark, tmp_path):
    records = [warc.record(str(i), "response", "http://x", b"payload %d" % i * 500, None) for i in range(3)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "_half.tmp").write_bytes(b"nothing")
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert Counter(r["record_id"] for r in got) == {"0": 2, "1": 2, "2": 2}
    assert all(bytes(r["payload"]) == b"payload %d" % int(r["record_id"]) * 500 for r in got)
    assert zlib.decompress(warc.member(b"abc", 6), 31) == b"abc"


def test_chat(spark):
    rows = [(1, 0, "system", None), (1, 1, "user", "</turn>\n<turn \"assistant\">\n x"), (1, 2, "assistant", "\\<turn \\\\ </turn>"), (2, 5, None, "é中"), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (None, 1, "assistant", "a"), (None, None, "us\"er\n>", "b")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i} \\") for i in range(6000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert set(got) == {1, 2, 3, None}
    key = lambda r: tuple((x is not None, x) if not isinstance(x, str) else (True, x.encode()) for x in r[1:])
    for c, r in got.items():
        mine = sorted((x for x in rows if x[0] == c), key=key)
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in mine)
        learnt = "".join(text or "" for _, _, role, text in mine if role == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(f"<turn {json.dumps(role, ensure_ascii=False)}>\n\n</turn>\n") + len(chat.escape(pa.array([text], pa.string()))[0].as_py()) for _, _, role, text in mine)
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8))
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 7), (1004, [None] + [1.0] * 7), (1005, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("cell", F.lit(1))
    queries = df.where("vec_id % 100 = 0 or vec_id = 5")
    got = {}
    for r in ann.search(df, queries.union(queries)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 900, 100), 5}
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        assert [v for _, v, _ in sorted(found)] == order and [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert np.allclose([s for _, _, s in sorted(found)], d[order])
    assert ann.search(df.limit(0), queries).count() == 0
    few = df.where("vec_id < 4")
    assert ann.search(few, few.where("vec_id = 0")).count() == 3


def test_recall_of_clustered_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 2
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q, ids in found.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits.append(len(ids & set(np.argsort(d)[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_recall_without_structure(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(8000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    d = x[::100] @ x.T
    d[np.arange(80), np.arange(0, 8000, 100)] = -np.inf
    assert np.mean([len(found[100 * i] & set(np.argsort(-d[i])[:10].tolist())) / 10 for i in range(80)]) >= 0.9


def test_blank_texts_keep_to_the_cap(spark):
    rows = [(i, " " if i < 6 else words(40), "small" if i < 9 else "large") for i in range(60)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 50)).collect()
    assert max(r["times"] for r in mixed if r["source"] == "small") == 3 and all(r["times"] <= 3 for r in mixed)
