"""Ranking and calibration metrics, provenance audits, agreement and heterogeneity statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import best_first, midranks, placed, ranked, running


def _hit(label: str) -> Column:
    return F.col(label).cast("int")


def ranking_metrics(scores: DataFrame, *, k: int = 10, score: str = "score", name: str = "candidate", label: str = "vulnerable") -> DataFrame:
    """recall_at_k, precision_at_k, mrr (of the first positive) and average_precision of one ranking.

    NULL recall and average precision without positives.
    """
    rows = placed(scores, *best_first(score, name), into="__place")
    size = rows.agg(F.count("*").alias("n"))
    hits = running(rows.where(F.col(label)), {"hits": F.lit(1)}, place="__place").withColumn("rank", F.col("__place") + 1)
    positives, top = F.nullif(F.count("*"), F.lit(0)).cast("double"), F.count_if(F.col("rank") <= k)
    found = hits.agg((top / positives).alias("recall_at_k"), top.alias("__top"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"), (F.sum(F.col("hits") / F.col("rank").cast("double")) / positives).alias("average_precision"))
    return found.crossJoin(size).select("recall_at_k", (F.col("__top") / F.least(F.lit(k), F.col("n")).cast("double")).alias("precision_at_k"), "mrr", "average_precision")  # a row each


def recall_curve(scores: DataFrame, cutoffs: list[int], *, score: str = "score", name: str = "candidate", label: str = "vulnerable") -> DataFrame:
    """cutoff, recall: one pass, a conditional sum a cutoff."""
    rows = ranked(scores, score, name)
    wide = rows.agg(F.sum(_hit(label)).alias("p"), *(F.sum(F.when(F.col("rank") <= c, _hit(label)).otherwise(0)).alias(f"c{c}") for c in cutoffs))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).cast("long").alias("cutoff"), (F.col(f"c{c}") / F.nullif("p", F.lit(0))).alias("recall")) for c in cutoffs))))


def top_k(scores: DataFrame, k: int, *, score: str = "score", name: str = "candidate") -> DataFrame:
    """The first k names, as a bounded top-k in each task."""
    return scores.orderBy(F.col(score).desc_nulls_last(), F.col(name).asc()).limit(k).select(name, score)


def best_single(long: DataFrame, *, k: int, label: str = "vulnerable") -> DataFrame:
    """modality and recall at k of each modality's own ranking (modality, ordinal, candidate, betp, label); the best one
    (first in order on ties) is flagged. One order of all rows holds the rankings one after the other."""
    rows = placed(long, F.col("modality").asc(), *best_first("betp", "candidate"), into="__place")
    first = rows.groupBy("modality").agg(F.min("__place").alias("__first"), F.max("ordinal").alias("ordinal"), F.sum(_hit(label)).alias("p"))  # a row a modality
    top = rows.join(F.broadcast(first.select("modality", "__first")), "modality").where(F.col("__place") < F.col("__first") + k).groupBy("modality").agg(F.sum(_hit(label)).alias("hits"))
    parts = first.join(top, "modality").select("modality", "ordinal", (F.col("hits") / F.col("p")).alias("recall"))
    best = parts.agg(F.max_by("modality", F.struct("recall", -F.col("ordinal"))).alias("best"))
    return parts.crossJoin(best).select("modality", "recall", (F.col("modality") == F.col("best")).alias("best"))  # one row


def auroc(rows: DataFrame, value: str, positive: str) -> DataFrame:
    """auroc of value for a boolean column by midranks, 0 if a class is empty."""
    r = midranks(rows, value).agg(F.sum(F.when(F.col(positive), F.col("midrank"))).alias("s"), F.sum(_hit(positive)).cast("double").alias("p"), F.sum(1 - _hit(positive)).cast("double").alias("n"))
    return r.select(F.coalesce((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("n"), F.lit(0.0)), F.lit(0.0)).alias("auroc"))


def concordant(rows: DataFrame, ceiling: float, width: str = "width") -> DataFrame:
    """Rows no wider than the ceiling."""
    return rows.where(F.col(width) <= ceiling)


def discordant(rows: DataFrame, floor: float, width: str = "width") -> DataFrame:
    """Rows as wide as the floor or wider; those at it are in both groups."""
    return rows.where(F.col(width) >= floor)


def separability(rows: DataFrame, ceiling: float, width: str = "width") -> DataFrame:
    """auroc of narrow widths for the concordant group against the discordant one, sizes and mean widths of both; 0 if
    either is empty."""
    both = concordant(rows, ceiling, width).select((-F.col(width)).alias("w"), F.lit(True).alias("g")).unionByName(discordant(rows, ceiling, width).select((-F.col(width)).alias("w"), F.lit(False).alias("g")))
    means = both.agg(F.count_if("g").alias("concordant"), F.count_if(~F.col("g")).alias("discordant"), (-F.avg(F.when(F.col("g"), F.col("w")))).alias("mean_width_concordant"), (-F.avg(F.when(~F.col("g"), F.col("w")))).alias("mean_width_discordant"))
    return auroc(both, "w", "g").crossJoin(means)  # a row each


def linspace(bins: int) -> list[float]:
    """Edges of equal bins as numpy gives them."""
    import numpy as np

    return np.linspace(0.0, 1.0, bins + 1).tolist()


def bin_of(p: Column, bins: int) -> Column:
    """The bin of p among explicit edges; the last bin is closed."""
    out = F.lit(0)
    for i, e in enumerate(linspace(bins)[1:-1], 1):
        out = F.when(p >= e, F.lit(i)).otherwise(out) if i == 1 else F.when(p >= e, F.lit(i)).otherwise(out)
    return out


def reliability_curve(rows: DataFrame, *, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """bin, n, mean_p, mean_y, gap of the bins that hold rows."""
    out = rows.groupBy(bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def calibration_summary(rows: DataFrame, *, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """brier, ece, n, mean_p, base_rate, overconfidence, all from the sums of the bins."""
    d = F.col(p) - F.col(y)
    by = rows.groupBy(bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(d * d).alias("ss"))
    n = F.sum("n").cast("double")
    return by.agg(
        (F.sum("ss") / n).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"), F.sum("n").alias("n"),
        (F.sum("sp") / n).alias("mean_p"), (F.sum("sy") / n).alias("base_rate"), ((F.sum("sp") - F.sum("sy")) / n).alias("overconfidence"),
    )


def cohens_kappa(rows: DataFrame, first: str, second: str) -> DataFrame:
    """kappa of two binary columns; 0 where chance agreement is complete."""
    a, b = F.col(first).cast("double"), F.col(second).cast("double")
    s = rows.agg(F.avg((F.col(first) == F.col(second)).cast("double")).alias("po"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select(F.when(F.abs(1 - pe) <= 1e-12, 0.0).otherwise((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def cochran_q(effects: DataFrame, *, effect: str = "effect", variance: str = "variance") -> DataFrame:
    """pooled effect, q, i2, heterogeneous (i2 > 0.5), max_gap: from weighted moments in one pass."""
    w, x = 1.0 / F.col(variance), F.col(effect)
    s = effects.agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.count("*").alias("n"), F.max(x).alias("hi"), F.min(x).alias("lo"))
    q = F.greatest(F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w"), F.lit(0.0))
    out = s.select((F.col("wx") / F.col("w")).alias("pooled"), q.alias("q"), F.col("n"), (F.col("hi") - F.col("lo")).alias("max_gap"))
    i2 = F.when(F.col("q") <= 0, 0.0).otherwise(F.greatest((F.col("q") - (F.col("n") - 1)) / F.nullif("q", F.lit(0.0)), F.lit(0.0)))
    return out.select("pooled", "q", i2.alias("i2"), (i2 > 0.5).alias("heterogeneous"), "max_gap")


def audit_citations(citations: DataFrame, ledger: DataFrame) -> DataFrame:
    """candidate, cited, grounded: citations whose key is in the ledger. Keys are made distinct before the join."""
    known = ledger.select("key").distinct().withColumn("known", F.lit(1))
    return citations.join(known, "key", "left").groupBy("candidate").agg(F.count("*").alias("cited"), F.count("known").alias("grounded"))


def grounding(audits: DataFrame) -> DataFrame:
    rate = F.coalesce(F.sum("grounded") / F.nullif(F.sum("cited"), F.lit(0)), F.lit(0.0))
    return audits.agg(rate.alias("grounding_rate"), (1 - rate).alias("hallucinated_rate"), F.count("*").alias("candidates"))


def null_fields(entries: DataFrame, fields: list[str]) -> DataFrame:
    """field, missing of the fields with NULLs; one aggregation, then a row a field."""
    wide = entries.agg(*(F.count_if(F.col(f).isNull()).alias(f) for f in fields))
    return wide.unpivot([], fields, "field", "missing").where("missing > 0")


def complete_entries(entries: DataFrame, fields: list[str]) -> DataFrame:
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.col(f).isNotNull()
    return entries.agg(F.count_if(ok).alias("complete"), F.count("*").alias("entries"))


def entries_of(entries: DataFrame, candidate) -> DataFrame:
    """The ledger's entries of one candidate."""
    return entries.where(F.col("candidate") == candidate)


def provenance_summary(audits: DataFrame, entries: DataFrame, fields: list[str]) -> DataFrame:
    """candidates, cited, grounded, grounded_rate, hallucinated_rate and complete_entries (those with all fields), one row."""
    rate = F.coalesce(F.sum("grounded") / F.nullif(F.sum("cited"), F.lit(0)), F.lit(0.0))
    out = audits.agg(F.count("*").alias("candidates"), F.coalesce(F.sum("cited"), F.lit(0)).alias("cited"), F.coalesce(F.sum("grounded"), F.lit(0)).alias("grounded"), rate.alias("grounded_rate"), (1 - rate).alias("hallucinated_rate"))
    return out.crossJoin(complete_entries(entries, fields).select(F.col("complete").alias("complete_entries")))  # a row each


def latest_by_key(entries: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key, as an aggregation (no sort of a key's rows)."""
    return entries.groupBy(key).agg(F.max_by(F.struct(*(c for c in entries.columns if c != key)), order).alias("e")).select(key, "e.*")


def point_biserial(rows: DataFrame, by: str, value: str, label: str, least: int = 12) -> DataFrame:
    """by, pairs, r and strength (|r| / 0.6, clipped; NULL under ``least`` pairs), 0 where a side is constant."""
    x, y = F.col(value), F.col(label).cast("double")
    s = rows.where(x.isNotNull() & y.isNotNull()).groupBy(by).agg(F.count("*").alias("pairs"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    r = F.when((F.col("sx") <= 1e-12) | (F.col("sy") <= 1e-12), 0.0).otherwise(F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0)))
    strength = F.when(F.col("pairs") >= least, F.least(F.abs(r) / 0.6, F.lit(1.0)))
    return s.select(by, "pairs", r.alias("r"), strength.alias("strength"))


def row_aggregates(values: Column) -> dict[str, Column]:
    """The ten row-wise aggregations over an array of scores."""
    n = F.size(values).cast("double")
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    mean, ordered = total / n, F.array_sort(values)
    top, low = F.element_at(ordered, -1), F.element_at(ordered, 1)
    half = F.size(values) / 2
    median = (F.element_at(ordered, F.ceil(half).cast("int")) + F.element_at(ordered, (F.floor(half) + 1).cast("int"))) / 2.0
    rest = F.nullif(n - 1.0, F.lit(0.0))
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    second = F.when(F.size(values) > 1, (top + F.element_at(ordered, -2)) / 2.0).otherwise(top)
    return {
        "mean": mean, "max": top, "min": low, "median": median,
        "product": F.exp(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.ln(F.greatest(x, F.lit(1e-6)))) / n),
        "rank_mean": (n + 1.0) / 2.0,
        "tournament": 0.6 * top + 0.4 * F.coalesce((total - top) / rest, top), "reviewer": 0.6 * low + 0.4 * F.coalesce((total - low) / rest, low),
        "dual_mode": second * (1.0 - spread / 2.0), "provenance_gated": mean * (1.0 - low),
    }
