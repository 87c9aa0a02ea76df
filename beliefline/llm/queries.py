"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, chat, cws, langid, minhash, mixing, pieces, quality, resampling, warc
from .common import crc_mod, remove_at_exit, shared_path, table
from .substrings import by_document, repeated_passages


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's ten nearest other vectors. Vectors that are null, zero or hold null or non-finite components take no part; ties go to the smaller id; no vectors give no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; null texts and texts without a letter are und, ties go to the first language by name."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return langid.predict(docs, langid.train(docs.where(~out))).withColumn("held_out", out)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes; null texts have size 0, null is a source of its own, no documents give no rows."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, null and empty texts among them; without labels every score is the same."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return quality.score(docs, quality.train(docs, labels.where(~out))).withColumn("held_out", out)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that repeats passages of earlier ones; null ids and texts take no part, no documents give no rows."""
    return by_document(repeated_passages(table(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the bytes they decode to, as digests; null texts count as empty."""
    return bpe.round_trip(bpe.encode(table(spark, sf_dir, "documents")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and that of its edited text; null texts count as empty, equal texts have equal ones."""
    return cws.edited_likeness(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives give it back; a null page is empty, no pages give no rows."""
    path = shared_path(spark, "warc")
    warc.write(warc.with_revisits(table(spark, sf_dir, "pages")), path)
    remove_at_exit(spark, path)
    back = warc.read(spark, path)
    page = F.col("record_id").cast("long").alias("page_id")
    return back.select(page, "payload_bytes", F.coalesce("computed_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component; texts without words are alone, repeated rows count by their texts."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as read back from its formatted text; null texts count as empty."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chats(turns.union(more)))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance towards the benchmark, and its rank if drawn; null texts weigh nothing."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, seed=2024, min_words=20, percent=10)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoded text, as digests; null texts count as empty and have the end id alone."""
    return pieces.round_trip(pieces.encode(table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between two tokenizers; null, empty and changed texts have none."""
    aligned = alignment.cross_align(table(spark, sf_dir, "documents"))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.ORACLE, "op8_warc": warc.ORACLE, "op9_minhash_near_dedup": minhash.ORACLE, "op10_chat_formatting": chat.ORACLE, "op11_importance_resampling": resampling.ORACLE}
