"""Simulated candidate pools, seed metrics over a grid of cells and contrasts between levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fusion

#: Fixed values of the evidence design.
SUPPORT, CONTRADICT, PREVALENCE = (4.0, 1.5), (1.5, 2.5), 0.15


def draw_pool(seed: int, candidates: int, conflict: float, absent: float, prevalence: float = PREVALENCE) -> pd.DataFrame:
    """One pool from one stream: labels are shuffled, then each candidate's modalities draw absence, agreement, score."""
    rng = np.random.default_rng(seed)
    labels = np.arange(candidates) < int(round(candidates * prevalence))
    rng.shuffle(labels)
    scores = np.full((candidates, 4), np.nan)
    for i, j in np.ndindex(scores.shape):
        if rng.random() >= absent:
            agrees = rng.random() >= conflict
            scores[i, j] = rng.beta(*(SUPPORT if labels[i] == agrees else CONTRADICT))
    out = pd.DataFrame(scores, columns=list(fusion.SCORES.values()))
    return out.assign(candidate=[f"G{i:05d}" for i in range(candidates)], vulnerable=labels)


def pools(spark: SparkSession, *, conflicts: tuple[float, ...], absents: tuple[float, ...], seeds: tuple[int, ...], candidates: int) -> DataFrame:
    """conflict, absent, seed, candidate, scores, vulnerable of the whole grid; a task draws the pools of its runs."""
    grid = spark.createDataFrame([(c, a, s) for c in conflicts for a in absents for s in seeds], "conflict double, absent double, seed long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        return draw_pool(int(r.seed), candidates, r.conflict, r.absent).assign(conflict=r.conflict, absent=r.absent, seed=int(r.seed))

    schema = "conflict double, absent double, seed long, candidate string, kg double, dep double, flux double, clin double, vulnerable boolean"
    drawn = grid.groupBy("conflict", "absent", "seed").applyInPandas(lambda pdf: run(pdf)[[c.split()[0] for c in schema.split(", ")]], schema)
    return drawn.select("conflict", "absent", "seed", "candidate", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in fusion.SCORES.values()), "vulnerable")


def run_design(spark: SparkSession, rates: dict[str, float], *, conflicts: tuple[float, ...], absents: tuple[float, ...], seeds: tuple[int, ...], candidates: int, k: int = 10) -> DataFrame:
    """A row of metrics for each (conflict, absent, seed): recall, best single recall, parity gap, mean conflict, mean
    width, brier. Ranks are windows of a run, whose size the design fixes."""
    key = ["conflict", "absent", "seed"]
    rows = fusion.reports(pools(spark, conflicts=conflicts, absents=absents, seeds=seeds, candidates=candidates), rates)
    singles = [f"betp_{c}" for c in fusion.SCORES.values()]
    rank = lambda c: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(c), "candidate"))
    rows = rows.select("*", *(rank(c).alias(f"r_{c}") for c in ("betp", *singles)))
    y = F.col("vulnerable").cast("double")
    recall = lambda c: F.sum(F.when(F.col(f"r_{c}") <= k, y).otherwise(0.0)) / F.sum(y)
    out = rows.groupBy(*key).agg(
        recall("betp").alias("recall_at_k"), F.greatest(*(recall(c) for c in singles)).alias("best_single_recall"), F.avg("total_conflict").alias("mean_conflict"),
        F.avg("width").alias("mean_width"), F.avg((F.col("betp") - y) ** 2).alias("brier"), F.coalesce(F.avg(F.when(F.col("absent_modalities") == 4, F.col("width"))), F.lit(0.0)).alias("absent_only_width"),
    )
    return out.withColumn("parity_gap", F.col("recall_at_k") - F.col("best_single_recall"))


def level_contrasts(runs: DataFrame, level: str, value: str) -> DataFrame:
    """level, mean, sd, n, previous, non_decreasing: means by level and whether each is at least the one before."""
    by = runs.groupBy(level).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    before = F.lag("mean").over(Window.orderBy(level))  # a row a level
    return by.select(level, "mean", "sd", "n", before.alias("previous"), F.coalesce(F.col("mean") >= before - 1e-12, F.lit(True)).alias("non_decreasing"))
