"""The queries and the pipeline on the smallest tables."""

import re
from collections import defaultdict

import numpy as np
import pytest
from compare import difference

import corpus_pipeline
from beliefline.llm import queries as llm
from beliefline.llm.common import table

ORACLES = llm.oracle_sql()
COLUMNS = {
    "op1_inverted_multi_index": {"query_id", "rank", "vec_id", "score"},
    "op2_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op3_source_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op5_substring_dedup": {"doc_id", "source_doc_ids", "passages"},
    "op6_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op8_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op9_minhash_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op11_importance_resampling": {"doc_id", "n_features", "weight", "score", "rank"},
    "op12_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op13_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op10_chat_formatting": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    assert COLUMNS[name] <= set(df.columns)
    if name in ORACLES:
        assert difference(df, ORACLES[name], sf_dir) == []
    elif name not in ("op1_inverted_multi_index", "op5_substring_dedup"):
        assert df.count() == table(spark, sf_dir, "documents").count()
    else:
        assert df.count() > 0


def test_recall_of_the_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = defaultdict(set)
    for r in llm.op1_inverted_multi_index(spark, sf_dir).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        hits.append(len(found[ids[i]] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    got = [r for r in llm.op2_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.95
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    got = [r for r in llm.op4_quality_classifier(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([labels[r["doc_id"]] == r["predicted"] for r in got]) > 0.85


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        texts = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        kept = {r["doc_id"]: r for r in docs.collect()}
        assert set(kept) <= set(texts)
        if name == "near_dedup":  # nothing that stays is a near-duplicate of another
            sets = {i: set(zip(*(w[j:] for j in range(5)), strict=False)) for i, r in kept.items() if len(w := re.split(r"[\x20\x09-\x0D]+", r["text"].lower().strip())) >= 5}
            ids = list(sets)
            for a, x in enumerate(ids):
                for y in ids[:a]:
                    assert 100 * len(sets[x] & sets[y]) < 75 * len(sets[x] | sets[y])
        if name == "substring_dedup":
            assert all(len(r["text"]) <= len(texts[i]) and r["n_chars"] == len(r["text"]) for i, r in kept.items())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[5] == sizes[4]
