"""A corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefline.llm import bpe, mixing, quality
from beliefline.llm.common import as_documents, crc_mod, materialise, table, unused
from beliefline.llm.minhash import near_duplicates, with_set_ids
from beliefline.llm.substrings import cut, repeated_passages


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels outside the held-out fifth.

    Rows count alone: repeated ids, null ids and columns with other names change nothing. Null and empty texts are
    scored as texts without a word. Without labels, or with one class alone, every text has that class's share.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return quality.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id. Rows without an id stay.

    Rows that repeat an id count by their texts: each stays if its own set of shingles does, and of those with equal
    sets (exact repeats, blank texts) one stays. Blank texts of different ids are not alike, so they all stay.
    """
    found = materialise(near_duplicates(docs).where("doc_id is not null").select("doc_id", "set_id", "kept"), "kept")
    id_, n, kept, set_, kept_set = unused(docs, "__id", "__n", "__kept", "__set", "__kept_set")
    ids = found.groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(n), F.max("kept").alias(kept))
    same = F.col("doc_id") == F.col(id_)
    stay = docs.join(ids.where((F.col(n) == 1) & F.col(kept)), same, "left_semi").union(docs.where("doc_id is null"))
    repeated = ids.where(F.col(n) > 1).select(id_)
    if not repeated.isEmpty():
        sets = found.where("kept").select(F.col("doc_id").alias(id_), F.col("set_id").alias(kept_set)).distinct()
        rows = with_set_ids(docs.join(repeated, same, "left_semi"), set_)
        rows = rows.join(sets, same & F.col(set_).eqNullSafe(F.col(kept_set)), "left_semi")
        stay = stay.union(as_documents(rows.dropDuplicates(["doc_id", set_]), docs))
    return as_documents(stay, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; the rest of each document stays.

    A document of which nothing is left goes. Rows that repeat an id are one document, each cut in its own text; rows
    with a null id or text stay as they are.
    """
    return as_documents(cut(docs, repeated_passages(docs)), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken. Documents whose source has its budget spent go.

    Rows are told apart by id (null is one) and text; of rows that agree in both, one stands for all that the mix
    takes of them. Texts without words weigh nothing.
    """
    id_, digest, times, n, copy = unused(docs, "__id", "__digest", "__times", "__n", "__copy")
    by_row = mixing.mix(docs).groupBy(F.col("doc_id").alias(id_), F.col("digest").alias(digest))
    plan = by_row.agg(F.sum("times").alias(times), F.count("*").alias(n)).where(F.col(times) > 0)
    taken = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(id_)) & (mixing.digest(F.col("text")) == F.col(digest)))
    taken = taken.where(F.col(n) == 1).union(taken.where(F.col(n) > 1).dropDuplicates([id_, digest]))
    return as_documents(taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each row of the mix, repeated rows and null ids among them; null and empty texts
    have no ids. Rows of an empty table give none."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", source_mix), ("tokens", tokens)]

#: A trained network, chains of seeds and BPE are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
