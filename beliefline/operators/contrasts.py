"""Contrasts of simulated runs and hypotheses about them: a verdict is a row name, passed, statistic, threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fusion, stats
from .pinned import pinned
from .simulation import level_contrasts

#: Metrics of a cell and the seed offsets of their bootstraps, seeds of the two inequalities, the margin.
CELL_METRICS = ("recall_at_k", "parity_gap", "mean_conflict", "width_separability", "brier")
PARITY_SEED, SATURATED_SEED, CELL_SEED, PARITY_MARGIN = 17, 23, 100, 0.15
VERDICTS = ("pass", "fail", "not_tested")
REDUCED, TRACE = ("total_conflict", "absent_modalities"), ("flagged_steps", "trace_steps", "trace_flagged")


def verdict(spark: SparkSession, name: str, passed: bool, statistic: float, threshold: float) -> DataFrame:
    return spark.createDataFrame([(name, "pass" if passed else "fail", float(statistic), float(threshold))], "name string, verdict string, statistic double, threshold double")


def design_matrix(reports: DataFrame, *, with_trace: bool = True) -> DataFrame:
    """candidate, width and the features of the trace regression: total conflict and absent modalities, with the trace
    also its flagged steps, all steps and whether any is flagged."""
    flagged = F.size(F.filter("trace", lambda t: t["flagged"]))
    more = (flagged.cast("double").alias("flagged_steps"), F.size("trace").cast("double").alias("trace_steps"), (flagged > 0).cast("double").alias("trace_flagged")) if with_trace else ()
    return reports.select("candidate", "width", "total_conflict", F.col("absent_modalities").cast("double").alias("absent_modalities"), *more)


def trace_r2(reports: DataFrame) -> DataFrame:
    """r2_reduced, r2_full, partial: what the conflict trace adds to the variance of widths that is explained. One scan
    gives the moments of both regressions."""
    rows = design_matrix(reports)
    full, reduced = (stats.linear_r2(rows, list(f), "width") for f in ((*REDUCED, *TRACE), REDUCED))
    partial = (full - reduced) / (1 - reduced) if 1 - reduced > 1e-12 else 0.0
    return reports.sparkSession.createDataFrame([(reduced, full, partial)], "r2_reduced double, r2_full double, partial double")


def conflict_trace_hypothesis(reports: DataFrame) -> DataFrame:
    """Passes if the trace explains width beyond conflict and absence."""
    added = trace_r2(reports).first()["partial"]
    return verdict(reports.sparkSession, "conflict_trace_partial_r2", added > 0.0, added, 0.0)


def recall_of(rows: DataFrame, score: str, k: int, *, label: str = "vulnerable", name: str = "candidate") -> DataFrame:
    """Recall of the k best by a score, as one row: only each task's k best move."""
    best = rows.orderBy(F.col(score).desc_nulls_last(), name).limit(k).agg(F.count_if(label).alias("hits"))
    return best.crossJoin(rows.agg(F.count_if(label).alias("positives"))).select((F.col("hits") / F.nullif("positives", F.lit(0))).alias("recall"))


def fusion_rule_contrast(candidates: DataFrame, rates: dict[str, float], *, k: int = 10) -> DataFrame:
    """full_recall, naive_recall, loss: the fold against plain averages on one pool."""
    cells = fusion.ablation_scores(candidates, rates).where("label in ('full', 'average')").groupBy("candidate", "vulnerable")
    wide = cells.agg(*(F.round(F.max(F.when(F.col("label") == n, F.col("score"))), 6).alias(n) for n in ("full", "average")))
    both = recall_of(wide, "full", k).withColumnRenamed("recall", "full_recall").crossJoin(recall_of(wide, "average", k).withColumnRenamed("recall", "naive_recall"))  # a row each
    return both.withColumn("loss", F.col("full_recall") - F.col("naive_recall"))


def fusion_rule_hypothesis(candidates: DataFrame, rates: dict[str, float], *, k: int = 10, margin: float = 0.0) -> DataFrame:
    loss = fusion_rule_contrast(candidates, rates, k=k).first()["loss"]
    return verdict(candidates.sparkSession, "fusion_rule_recall_loss", loss > margin, loss, margin)


def single_modality_recall(reports: DataFrame, *, k: int = 10) -> DataFrame:
    """modality, recall of each modality's own ranking of the reports."""
    out = None
    for m, c in fusion.SCORES.items():
        one = recall_of(reports.withColumn("__s", F.round(f"betp_{c}", 6)), "__s", k).select(F.lit(m).alias("modality"), "recall")
        out = one if out is None else out.unionByName(one)
    return out


def cell_contrasts(runs: DataFrame, *, resamples: int = 2000, seed: int = CELL_SEED) -> DataFrame:
    """conflict, absent, metric, mean, sd, n, lower, upper: a bootstrap over the seeds of each cell and metric."""
    metrics = [m for m in CELL_METRICS if m in runs.columns]
    long = runs.unpivot(["conflict", "absent"], metrics, "metric", "value")
    return stats.bootstrap_mean(long, ["conflict", "absent", "metric"], "value", resamples=resamples, seed=seed)


def parity_inequality(runs: DataFrame, *, column: str = "parity_gap", margin: float = PARITY_MARGIN, resamples: int = 2000, seed: int = PARITY_SEED) -> DataFrame:
    """The verdict on the lower bound of the mean gap over all runs; the saturated one names another column and seed."""
    found = stats.bootstrap_mean(runs.select(F.lit(1).alias("all"), column), ["all"], column, resamples=resamples, seed=seed).first()
    return verdict(runs.sparkSession, f"{column}_inequality", found["lower"] >= margin, found["mean"], margin)


def cutoff_reachability(spark: SparkSession, *, candidates: int = 2000, prevalence: float = 0.15, cutoff: int = 10, margin: float = PARITY_MARGIN) -> DataFrame:
    """positives, ceiling (greatest recall at the cutoff), reachable, first_reachable (least cutoff that allows the margin)."""
    n = candidates * prevalence
    return spark.createDataFrame([(float(n), cutoff / n, cutoff / n >= margin, int(math.ceil(margin * n - 1e-9)))], "positives double, ceiling double, reachable boolean, first_reachable long")


def monotone_verdict(runs: DataFrame, level: str, value: str, name: str) -> DataFrame:
    """Whether means by level never fall; the statistic is the last mean less the first."""
    by = level_contrasts(runs, level, value)
    r = by.agg(F.bool_and("non_decreasing").alias("ok"), (F.max_by("mean", level) - F.min_by("mean", level)).alias("rise")).first()
    return verdict(runs.sparkSession, name, r["ok"], r["rise"], 0.0)


def hypothesis_report(runs: DataFrame, reports: DataFrame, candidates: DataFrame, rates: dict[str, float]) -> DataFrame:
    """All verdicts, a row each."""
    out = [
        monotone_verdict(runs, "conflict", "mean_conflict", "conflict_rises_with_level"), monotone_verdict(runs, "absent", "mean_width", "absence_widens_intervals"),
        parity_inequality(runs), conflict_trace_hypothesis(reports), fusion_rule_hypothesis(candidates, rates),
    ]
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    return rows


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """verdict, n with zeros for those that no row has."""
    dims = verdicts.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return dims.join(verdicts.groupBy("verdict").agg(F.count("*").alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def seed_means(runs: DataFrame) -> DataFrame:
    """The mean of every numeric column of the runs, and their number, as one row."""
    return runs.agg(F.count("*").alias("runs"), *(F.avg(c).alias(c) for c, t in runs.dtypes if t == "double"))


def grouped_trace_r2(reports: DataFrame, by: list[str]) -> DataFrame:
    """by, n, r2_reduced, r2_full, partial of the trace regression in every group, in one plan."""
    flagged = F.size(F.filter("trace", lambda t: t["flagged"]))
    rows = reports.withColumns({"__f0": F.col("total_conflict"), "__f1": F.col("absent_modalities"), "__f2": flagged, "__f3": F.size("trace"), "__f4": flagged > 0})
    rows = rows.select(*by, "width", F.col("__f0"), F.col("__f1"), F.col("__f2"), F.col("__f3"), F.col("__f4").cast("int").alias("__f4"))
    names = [f"__f{i}" for i in range(5)]
    out = stats.grouped_r2(pinned(rows, "design"), by, {"r2_reduced": names[:2], "r2_full": names}, "width")
    rest = 1.0 - F.col("r2_reduced")
    return out.withColumn("partial", F.when(rest > 1e-12, (F.col("r2_full") - F.col("r2_reduced")) / rest).otherwise(0.0))


def pooled_trace_analysis(pools: DataFrame, rates: dict[str, float], *, k: int = 10, seeds: int = 5, threshold: float = 0.05) -> DataFrame:
    """One row on the pooled candidates of the first ``seeds`` seeds of every cell (conflict, absent): candidates,
    flag_threshold, full_recall, naive_recall, loss, fusion_verdict, r2_reduced, r2_full, partial, trace_verdict, recall_kg, recall_dep,
    recall_flux, recall_clin. pools: conflict, absent, seed, candidate, scores, vulnerable. Candidates of the same name in two runs
    are two candidates."""
    runs = pools.select("conflict", "absent", "seed").distinct()  # a row a run
    first = runs.withColumn("__r", F.row_number().over(Window.partitionBy("conflict", "absent").orderBy("seed"))).where(F.col("__r") <= seeds).drop("__r")
    rows = pools.join(F.broadcast(first), ["conflict", "absent", "seed"])
    rows = pinned(rows.withColumn("candidate", F.concat_ws("|", F.col("candidate").cast("string"), "conflict", "absent", "seed")), "pooled")
    reports = pinned(fusion.reports(rows, rates, threshold), "reports")
    fused = fusion_rule_contrast(rows.drop("conflict", "absent", "seed"), rates, k=k)
    trace = grouped_trace_r2(reports, []).withColumnRenamed("n", "candidates")
    singles = single_modality_recall(reports, k=k).groupBy().agg(*(F.max(F.when(F.col("modality") == m, F.col("recall"))).alias(f"recall_{c}") for m, c in fusion.SCORES.items()))
    word = lambda ok: F.when(ok, "pass").otherwise("fail")
    out = trace.crossJoin(fused).crossJoin(singles)  # a row each
    return out.select(
        "candidates", F.lit(threshold).alias("flag_threshold"), "full_recall", "naive_recall", "loss", word(F.col("loss") > 0.0).alias("fusion_verdict"),
        "r2_reduced", "r2_full", "partial", word(F.col("partial") > 0.0).alias("trace_verdict"), *(f"recall_{c}" for c in fusion.SCORES.values()),
    )


def paired_difference(rows: DataFrame, by: list[str], first: str, second: str, key: str, **options) -> DataFrame:
    """by, mean_difference, lower, upper of paired values, at any scale."""
    d = rows.select(*by, key, (F.col(first) - F.col(second)).alias("__d")).where("__d is not null")
    mean = d.groupBy(*by).agg(F.avg("__d").alias("mean_difference"))
    return mean.join(stats.poisson_bootstrap(d, by, "__d", key, **options), by)


def cluster_difference(rows: DataFrame, by: list[str], cluster: str, first: str, second: str, **options) -> DataFrame:
    """The same with whole clusters resampled: their mean differences are the sample."""
    means = rows.groupBy(*by, cluster).agg(F.avg(first).alias("__a"), F.avg(second).alias("__b"))
    return paired_difference(means, by, "__a", "__b", cluster, **options)


def site_gap(sites: DataFrame, *, value: str = "auc", threshold: float = 0.10) -> DataFrame:
    """gap, flagged: how far the sites' values lie apart."""
    return sites.agg((F.max(value) - F.min(value)).alias("gap")).withColumn("flagged", F.col("gap") > threshold)


def recall_by(scores: DataFrame, by: str, *, k: int = 10, score: str = "score", name: str = "candidate", label: str = "vulnerable") -> DataFrame:
    """by, recall of the k best of each group: the rank filter keeps k rows a task and group."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), name)
    top = scores.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).groupBy(by).agg(F.count_if(label).alias("hits"))
    all_ = scores.groupBy(by).agg(F.count_if(label).alias("positives"))
    return all_.join(top, by).select(by, (F.col("hits") / F.nullif("positives", F.lit(0))).alias("recall"))


def fold_recall(scores: DataFrame, *, fold: str = "fold", **options) -> DataFrame:
    """recall of the k best averaged over folds, folds."""
    return recall_by(scores, fold, **options).agg(F.avg("recall").alias("recall"), F.count("*").alias("folds"))


def ranks_of(scores: DataFrame, names: list[str], *, k: int = 10, score: str = "score", name: str = "candidate") -> DataFrame:
    """name, rank (NULL if absent), hit (rank <= k) of a few names: rows that come before them are counted, none sorted."""
    spark = scores.sparkSession
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    own = asked.join(scores.select(F.col(name).cast("string").alias("name"), F.col(score).alias("__own"), F.col(name).alias("__key")), "name", "left")
    before = scores.select(F.col(score).alias("__s"), F.col(name).alias("__n")).crossJoin(F.broadcast(own.where("__key is not null")))  # as many rows as names
    ahead = before.groupBy("name").agg(F.count_if((F.col("__s") > F.col("__own")) | ((F.col("__s") == F.col("__own")) & (F.col("__n") < F.col("__key")))).alias("__ahead"))
    return own.join(ahead, "name", "left").select("name", (F.col("__ahead") + 1).alias("rank"), F.coalesce(F.col("__ahead") < k, F.lit(False)).alias("hit"))
