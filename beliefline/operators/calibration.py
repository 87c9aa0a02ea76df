"""Reliability rates from labelled scores: least squares in closed form, per fold and pooled; scaling helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .fusion import SCORES


def long_scores(wide: DataFrame, label: str = "vulnerable") -> DataFrame:
    """candidate, modality, score, y of the scores that are there."""
    names = F.create_map(*(x for m, c in SCORES.items() for x in (F.lit(c), F.lit(m))))
    rows = wide.unpivot(["candidate", label], list(SCORES.values()), "column", "score").where("score is not null")
    return rows.select("candidate", names[F.col("column")].alias("modality"), C.clip(F.col("score")).alias("score"), F.col(label).cast("double").alias("y"))


def fit_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, modality, rate, loss, n: the rate in [0, 1] of least Brier loss of rate * score + (1 - rate) / 2.

    The loss is a parabola of the rate, so three sums give its least point; flat ones have rate 1. Interior, 0 and 1
    are compared by loss, the first on ties."""
    a, b = F.col("score") - 0.5, 0.5 - F.col("y")
    s = rows.groupBy(*by, "modality").agg(F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.count("*").alias("n"))
    inner = F.when(F.col("aa") <= 1e-15, 1.0).otherwise(C.clip(-F.col("ab") / F.nullif("aa", F.lit(0.0))))

    def loss(r: Column) -> Column:
        return (r * r * F.col("aa") + 2.0 * r * F.col("ab") + F.col("bb")) / F.col("n")

    best = F.when((loss(inner) <= loss(F.lit(0.0))) & (loss(inner) <= loss(F.lit(1.0))), inner).when(loss(F.lit(0.0)) <= loss(F.lit(1.0)), 0.0).otherwise(1.0)
    s = s.withColumn("rate", best)
    return s.select(*by, "modality", "rate", loss(F.col("rate")).alias("loss"), "n")


def fit_folds(rows: DataFrame, part: str) -> DataFrame:
    """fold, modality, rate, loss, n with each part withheld in turn, and fold -1 over all. The sums of a part are taken
    once; a fold is the total less its part."""
    a, b = F.col("score") - 0.5, 0.5 - F.col("y")
    s = rows.groupBy(part, "modality").agg(F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.count("*").alias("n"))
    whole = s.groupBy("modality").agg(*(F.sum(c).alias(c) for c in ("aa", "ab", "bb", "n")))
    folds = whole.select(F.lit(-1).alias("fold"), "modality", "aa", "ab", "bb", "n").unionByName(
        s.select(F.col(part).alias("fold"), "modality", *(F.col(c).alias(f"_{c}") for c in ("aa", "ab", "bb", "n"))).join(whole, "modality").select("fold", "modality", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in ("aa", "ab", "bb", "n")))
    )
    inner = F.when(F.col("aa") <= 1e-15, 1.0).otherwise(C.clip(-F.col("ab") / F.nullif("aa", F.lit(0.0))))
    folds = folds.withColumn("rate", inner)
    return folds.select("fold", "modality", "rate", ((F.col("rate") ** 2 * F.col("aa") + 2.0 * F.col("rate") * F.col("ab") + F.col("bb")) / F.col("n")).alias("loss"), "n")


def rate_stability(folds: DataFrame) -> DataFrame:
    return folds.where("fold >= 0").groupBy("modality").agg((F.max("rate") - F.min("rate")).alias("spread"))


def scaled(rows: DataFrame, value: str, temperature: float = 1.0) -> DataFrame:
    """min_max, zscore and softmax of a column; its moments are one broadcast row."""
    x = F.col(value)
    s = rows.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"), F.avg(x).alias("__m"), F.stddev_pop(x).alias("__sd"))
    total = rows.crossJoin(F.broadcast(s)).agg(F.sum(F.exp((x - F.col("__hi")) / temperature)).alias("__e"))
    out = rows.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(total))  # one row each
    span = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    return out.select(
        *rows.columns, F.coalesce((x - F.col("__lo")) / span, F.lit(0.0)).alias("min_max"),
        F.when(F.col("__sd") <= 1e-15, 0.0).otherwise((x - F.col("__m")) / F.nullif("__sd", F.lit(0.0))).alias("zscore"), (F.exp((x - F.col("__hi")) / temperature) / F.col("__e")).alias("softmax"),
    )


def leave_one_out(controls: DataFrame, key: str = "symbol") -> DataFrame:
    """fold, withheld, member: fold i withholds control i (a handful of controls)."""
    numbered = controls.select(F.col(key).alias("withheld"), F.col("ordinal").alias("fold"))
    return numbered.join(controls.select(F.col(key).alias("member")), F.col("withheld") != F.col("member"))
