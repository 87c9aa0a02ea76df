"""Evidence of the four modalities as set-based sources, their fusion into a ranking, and the comparison operators."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import fusion, graph, metrics

#: Weights of effect and response.
DEPENDENCY, DRUG = 0.6, 0.4


def dependency_evidence(candidates: DataFrame, table: DataFrame, *, require_drug: bool = False) -> DataFrame:
    """candidate, modality, score from effects and optional responses (gene, effect, response); a miss is NULL."""
    rows = candidates.select("candidate").join(table.withColumnRenamed("gene", "candidate"), "candidate", "left")
    base = C.dependency_score(F.col("effect"))
    both = DEPENDENCY * base + DRUG * C.drug_score(F.col("response"))
    score = F.when(F.col("response").isNotNull(), both).otherwise(F.lit(None).cast("double") if require_drug else base)
    return rows.select("candidate", F.lit("DEP").alias("modality"), F.when(F.col("effect").isNotNull(), score).alias("score"))


def path_evidence(candidates: DataFrame, edges: DataFrame, kinds: DataFrame, target: str, *, hops: int = 3, min_paths: int = 1) -> DataFrame:
    """candidate, modality, score: support by simple paths; NULL under min_paths."""
    sources = candidates.select(F.col("candidate").alias("source"))
    found = graph.path_support(graph.simple_paths(edges, sources, target, hops), kinds)
    rows = candidates.select("candidate").join(found.withColumnRenamed("source", "candidate"), "candidate", "left")
    return rows.select("candidate", F.lit("KG").alias("modality"), F.when(F.coalesce("paths", F.lit(0)) >= min_paths, F.col("support")).alias("score"))


def association_evidence(candidates: DataFrame, expression: DataFrame, labels: DataFrame) -> DataFrame:
    """candidate, modality, score: the strength of a gene's correlation with the label (record_id, gene, value)."""
    found = metrics.point_biserial(expression.join(labels, "record_id"), "gene", "value", "label").select(F.col("gene").alias("candidate"), "strength")
    return candidates.select("candidate").join(found, "candidate", "left").select("candidate", F.lit("CLIN").alias("modality"), F.col("strength").alias("score"))


def capacity_evidence(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidate, modality, score from a table of flux scores (gene, score)."""
    return candidates.select("candidate").join(scores.withColumnRenamed("gene", "candidate"), "candidate", "left").select("candidate", F.lit("FLUX").alias("modality"), "score")


def wide(*evidence: DataFrame) -> DataFrame:
    """A row for each candidate with the four scores; a modality without evidence is NULL."""
    long = None
    for e in evidence:
        long = e if long is None else long.unionByName(e)
    return long.groupBy("candidate").agg(*(F.max(F.when(F.col("modality") == m, F.col("score"))).alias(c) for m, c in fusion.SCORES.items()))


def discover(candidates: DataFrame, rates: dict[str, float], *evidence: DataFrame) -> DataFrame:
    """The ranking of candidates by their fused evidence, as one plan."""
    return fusion.rank_reports(fusion.reports(wide(*evidence), rates))


def shift(seed: int, number: int, scale: float) -> float:
    """A row's seeded noise, the same for every candidate."""
    if scale == 0:
        return 0.0
    key = int(hashlib.sha256(f"{seed}:{number}".encode()).hexdigest()[:16], 16) % (2**31 - 1)
    return float(np.random.default_rng(key).normal(0.0, scale))


def operator_scores(reports: DataFrame, plan: list[tuple], seed: int = 1) -> DataFrame:
    """number, family, candidate, score of every operator of the plan; one scan, a column an operator."""

    def scored(number: int, family: str, modalities: list[str], aggregation: str, noise: float, calibrated: bool, hops: int) -> Column:
        value = metrics.row_aggregates(F.array(*(F.col(f"betp_{fusion.SCORES[m]}") for m in modalities)))[aggregation]
        if not calibrated:
            value = value * (1.0 - F.col("absent_modalities") / 5.0)
        if hops:
            value = C.clip(value * (1.0 - 0.1 * hops))
        return F.struct(F.lit(number).alias("number"), F.lit(family).alias("family"), C.clip(value + shift(seed, number, noise)).alias("score"))

    rows = reports.select("candidate", "vulnerable", F.explode(F.array(*(scored(*p) for p in plan))).alias("o"))
    return rows.select("o.number", "o.family", "candidate", "vulnerable", "o.score")

