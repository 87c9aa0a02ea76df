"""ROC areas with DeLong variances, multiplicity, survival, clustered logistic models, bootstrap and sizing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import paired_variance
from .ordering import placed, prefix_sums, running
from .pinned import pinned


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """The complementary error function, which Spark SQL lacks: a continued fraction from 2 on, a series below."""
    z = x.to_numpy(float)
    a = np.abs(z)
    term = total = np.where(a < 2, a, 0.0)
    for n in range(1, 60):
        term = np.where(a < 2, term * (2 * a * a) / (2 * n + 1), 0.0)
        total = total + term
    small = 1.0 - 2.0 / math.sqrt(math.pi) * np.exp(-a * a) * total
    tail = np.full_like(a, 0.0)
    safe = np.where(a < 2, 2.0, a)
    for n in range(60, 0, -1):
        tail = (n / 2.0) / (safe + tail)
    large = np.exp(-safe * safe) / (math.sqrt(math.pi) * (safe + tail))
    out = np.where(a < 2, small, large)
    return pd.Series(np.where(z < 0, 2.0 - out, out))


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2.0))


def _placement_table(rows: DataFrame, score: str, label: str) -> DataFrame:
    """A row for each distinct score: __v, __pos and __neg (rows of each class), the placement of a positive there (the
    share of negatives below it, ties half) and of a negative (the share of positives above it)."""
    by = rows.where(F.col(label).isNotNull()).groupBy(F.col(score).alias("__v")).agg(F.count_if(F.col(label)).alias("__pos"), F.count_if(~F.col(label)).alias("__neg"))
    total = by.agg(F.sum("__pos").cast("double").alias("__p"), F.sum("__neg").cast("double").alias("__q"))
    by = prefix_sums(by, "__v", [F.col("__v").asc_nulls_first()], {"__pb": F.col("__pos"), "__nb": F.col("__neg")}, inclusive=False).crossJoin(F.broadcast(total))  # one row
    up = (F.col("__nb") + F.col("__neg") / 2.0) / F.nullif("__q", F.lit(0.0))
    down = 1.0 - (F.col("__pb") + F.col("__pos") / 2.0) / F.nullif("__p", F.lit(0.0))
    return by.select("__v", "__pos", "__neg", up.alias("__up"), down.alias("__down"))


def placements(rows: DataFrame, score: str, label: str) -> DataFrame:
    """rows with ``placement``: for a positive, the share of negatives below it (ties half); for a negative, the share
    of positives above it. Counts by distinct score give it without comparing pairs."""
    by = _placement_table(rows, score, label).drop("__pos", "__neg")
    out = rows.where(F.col(label).isNotNull()).join(by, F.col(score).eqNullSafe(F.col("__v")))
    return out.select(*rows.columns, F.when(F.col(label), F.col("__up")).otherwise(F.col("__down")).alias("placement"))


def roc_estimate(rows: DataFrame, score: str, label: str) -> DataFrame:
    """auc, variance (DeLong), positives, negatives; moments of the placements, weighted by the rows of each score."""
    by = pinned(_placement_table(rows, score, label), "placements")
    p, q = F.sum("__pos").cast("double"), F.sum("__neg").cast("double")
    mean = by.agg((F.sum(F.col("__pos") * F.col("__up")) / F.nullif(p, F.lit(0.0))).alias("auc"), (F.sum(F.col("__neg") * F.col("__down")) / F.nullif(q, F.lit(0.0))).alias("__m"))
    rows = by.crossJoin(F.broadcast(mean))  # one row
    spread = lambda n, x, m, size: F.coalesce(F.sum(F.col(n) * (F.col(x) - F.col(m)) ** 2) / F.nullif(size - 1.0, F.lit(0.0)), F.lit(0.0)) / size
    return rows.agg(F.max("auc").alias("auc"), (spread("__pos", "__up", "auc", p) + spread("__neg", "__down", "__m", q)).alias("variance"), F.sum("__pos").alias("positives"), F.sum("__neg").alias("negatives"))


def paired_roc(rows: DataFrame, first: str, second: str, label: str, key: str) -> DataFrame:
    """first_auc, second_auc, difference, variance of two correlated areas; z and p are 0 and 1 without variance."""
    a = placements(rows.select(key, label, first), first, label).select(key, label, F.col("placement").alias("a"))
    b = placements(rows.select(key, second, label), second, label).select(key, F.col("placement").alias("b"))
    j = a.join(b, key)
    d = F.col("a") - F.col("b")
    pos, neg = F.when(F.col(label), d), F.when(~F.col(label), d)
    s = j.agg(F.avg(F.when(F.col(label), F.col("a"))).alias("first_auc"), F.avg(F.when(F.col(label), F.col("b"))).alias("second_auc"), (F.var_samp(pos) / F.count(pos) + F.var_samp(neg) / F.count(neg)).alias("variance"))
    z = F.when(F.col("variance") > 0, (F.col("first_auc") - F.col("second_auc")) / F.sqrt(F.col("variance"))).otherwise(0.0)
    s = s.select("first_auc", "second_auc", (F.col("first_auc") - F.col("second_auc")).alias("difference"), "variance", z.alias("z"))
    return s.withColumn("p", F.when(F.col("variance") > 0, erfc(F.abs("z") / math.sqrt(2.0))).otherwise(1.0))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """name, p, adjusted, rejected: running maxima of (m - i) p over one family of tests, of any size."""
    rows = placed(tests.select("name", "p"), F.col("p").asc(), F.col("name").asc()).crossJoin(F.broadcast(tests.agg(F.count("*").alias("__m"))))  # one row
    rows = running(rows, {"adjusted": F.least(F.lit(1.0), (F.col("__m") - F.col("place")) * F.col("p"))}, by=F.max)
    return rows.select("name", "p", "adjusted", (F.col("adjusted") <= alpha).alias("rejected"))


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """name, p, adjusted, rejected: running minima of p m / rank from the largest p, over one family of any size."""
    rows = placed(tests.select("name", "p"), F.col("p").desc(), F.col("name").desc()).crossJoin(F.broadcast(tests.agg(F.count("*").alias("__m"))))  # one row
    rows = running(rows, {"adjusted": F.least(F.lit(1.0), F.col("p") * F.col("__m") / (F.col("__m") - F.col("place")))}, by=F.min)
    return rows.select("name", "p", "adjusted", (F.col("adjusted") <= alpha).alias("rejected"))


def inversions(rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
    """The sum of left[i] * right[j] over all i before j with rank[i] > rank[j]; ranks are distinct.

    Two such ranks part at one bit, where i has a 1 and j a 0 behind equal higher bits: a level a bit, and in a level one
    running sum over all groups of equal higher bits.
    """
    n = len(rank)
    if n < 2:
        return 0.0
    dense = np.empty(n, np.int64)
    dense[np.argsort(rank, kind="stable")] = np.arange(n)
    total = 0.0
    for bit in range(n.bit_length()):
        high = dense >> (bit + 1)
        order = np.argsort(high, kind="stable")
        one = (dense[order] >> bit) & 1 == 1
        seen = np.cumsum(np.where(one, left[order], 0.0))
        first = np.searchsorted(high[order], high[order])
        base = np.where(first > 0, seen[np.maximum(first - 1, 0)], 0.0)
        total += float(np.sum(np.where(one, 0.0, right[order] * (seen - base))))
    return total


def concordance_index(rows: DataFrame, time: str, event: str, risk: str, *, ranges: int | None = None) -> DataFrame:
    """concordance, pairs: pairs (i, j) with an event of i before j's time, concordant if i's risk is the greater, half if
    they are equal.

    Rows are counted by (time, risk). Each count has a place in the order (time, risk) and one in the order (risk, time);
    i dominates j strictly in both time and risk exactly if its first place is less and its second greater, so ties
    need no care, and ranges of places hold equally many counts whatever ties there are. Pairs of different ranges in
    both orders come from sums over the grid of ranges; pairs within a range of either are inversions that its task
    counts. Ties in risk are running sums in the second order, all pairs one running sum over times.
    """
    v = rows.where(F.col(time).isNotNull() & F.col(risk).isNotNull()).groupBy(F.col(time).cast("double").alias("t"), F.col(risk).cast("double").alias("r"))
    v = v.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(event) == 1).cast("double").alias("e"))
    v = placed(v, F.col("t").asc(), F.col("r").asc(), into="pt").drop("__p")
    v = placed(v, F.col("r").asc(), F.col("t").asc(), into="pr")
    sizes = v.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
    if not sizes["c"]:
        return rows.sparkSession.createDataFrame([(0.5, 0)], "concordance double, pairs long")
    ranges = ranges or min(1024, max(8, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    span = -(-sizes["c"] // ranges)
    v = v.withColumns({"a": F.floor(F.col("pt") / span), "b": F.floor(F.col("pr") / span)})
    cells = v.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    # a row a pair of ranges, with zeros, so that sums run over all of them
    grid = cells.select("a").distinct().crossJoin(cells.select("b").distinct()).join(cells, ["a", "b"], "left").na.fill(0.0)
    later = Window.partitionBy("b").orderBy(F.desc("a")).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0.0))).select("e", F.coalesce(F.sum("later").over(lower), F.lit(0.0)).alias("below"))
    far = grid.agg(F.sum(F.col("e") * F.col("below")).alias("good"))

    def near(by: str, first: str) -> DataFrame:
        """Inversions within the ranges ``by``, rows in the order of ``first``; equal ones of it are no inversion."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([first, "pr"])
            return pd.DataFrame({"good": [inversions(pdf["pr"].to_numpy(), pdf["e"].to_numpy(), pdf["n"].to_numpy())]})

        return v.select(F.col(by).alias("__by"), *dict.fromkeys((first, "pr", "n", "e"))).groupBy("__by").applyInPandas(run, "good double")

    # an event's ties in risk at later times: the sum up to the last of its risk less that up to itself
    sums = running(v, {"s": F.col("n")}, place="pr")
    ties = sums.groupBy("r").agg((F.sum("e") * F.max("s") - F.sum(F.col("e") * F.col("s"))).alias("x")).agg((F.sum("x") / 2.0).alias("good"))
    good = far.unionByName(near("a", "pt")).unionByName(near("b", "a")).unionByName(ties).agg(F.sum("good").alias("good"))
    by = v.groupBy("t").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    pairs = prefix_sums(by, "t", [F.desc("t")], {"after": F.col("n")}, descending=True, inclusive=False).agg(F.sum(F.col("e") * F.col("after")).alias("pairs"))
    return good.crossJoin(pairs).select(F.coalesce(F.col("good") / F.nullif("pairs", F.lit(0.0)), F.lit(0.5)).alias("concordance"), F.col("pairs").cast("long").alias("pairs"))  # a row each


def cumulative_incidence(rows: DataFrame, time: str, kind: str, of_interest: int = 1) -> DataFrame:
    """time, at_risk, survival, incidence (Aalen-Johansen) at each distinct time. Rows are counted by time first; running
    sums go over ranges of times."""
    by = rows.groupBy(F.col(time).alias("time")).agg(F.count("*").alias("n"), F.count_if(F.col(kind) == of_interest).alias("d"), F.count_if(F.col(kind) > 0).alias("any"))
    up, total = [F.col("time").asc()], by.agg(F.sum("n").alias("__all"))
    by = prefix_sums(by, "time", up, {"__gone": F.col("n")}, inclusive=False).crossJoin(F.broadcast(total))  # one row
    by = by.withColumn("at_risk", F.col("__all") - F.col("__gone"))
    hazard = F.col("any") / F.col("at_risk").cast("double")
    by = by.withColumn("__l", F.when(hazard >= 1, F.lit(-745.0)).otherwise(F.ln(1 - F.least(hazard, F.lit(1 - 1e-16)))))
    by = prefix_sums(by, "time", up, {"__log": F.col("__l")}, inclusive=False).withColumn("before", F.exp("__log"))
    by = by.withColumn("__i", F.col("before") * F.col("d") / F.col("at_risk").cast("double"))
    by = prefix_sums(by, "time", up, {"incidence": F.col("__i")})
    return by.select("time", "at_risk", (F.col("before") * (1 - hazard)).alias("survival"), "incidence")


def cox_terms(rows: DataFrame, time: str, event: str, covariates: list[str], beta: list[float], stratum: str | None) -> DataFrame:
    """loglik, gradient and information of the Breslow partial likelihood at beta, as one row.

    Risk sets are suffix sums over the distinct times of a stratum: rows are summed by (stratum, time) first, and only
    those sums are windowed; without strata they run over ranges of times."""
    p = len(covariates)
    eta = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, covariates, strict=True)), F.lit(0.0))
    w = F.exp(eta)
    moments = [("s0", w), *((f"s1_{i}", w * F.col(c)) for i, c in enumerate(covariates)), *((f"s2_{i}_{j}", w * F.col(covariates[i]) * F.col(covariates[j])) for i in range(p) for j in range(i, p))]
    hit = F.when(F.col(event) == 1, 1.0).otherwise(0.0)
    by = rows.groupBy((F.col(stratum) if stratum else F.lit(0)).alias("__s"), F.col(time).alias("__t")).agg(*(F.sum(e).alias(n) for n, e in moments), F.sum(hit).alias("d"), F.sum(hit * eta).alias("de"), *(F.sum(hit * F.col(c)).alias(f"dx{i}") for i, c in enumerate(covariates)))
    rest = ["d", "de", *(f"dx{i}" for i in range(p))]
    if stratum:
        over = Window.partitionBy("__s").orderBy(F.desc("__t")).rowsBetween(Window.unboundedPreceding, 0)
        by = by.select(*rest, *(F.sum(n).over(over).alias(n) for n, _ in moments))
    else:
        by = prefix_sums(by, "__t", [F.desc("__t")], {f"__{n}": F.col(n) for n, _ in moments}, descending=True)
        by = by.select(*rest, *(F.col(f"__{n}").alias(n) for n, _ in moments))
    by = by.where("d > 0")
    m = [F.col(f"s1_{i}") / F.col("s0") for i in range(p)]
    return by.agg(
        F.sum(F.col("de") - F.col("d") * F.ln("s0")).alias("loglik"),
        *(F.sum(F.col(f"dx{i}") - F.col("d") * m[i]).alias(f"g{i}") for i in range(p)),
        *(F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - m[i] * m[j])).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)),
    )


def fit_cox(rows: DataFrame, time: str, event: str, covariates: list[str], *, stratum: str | None = None, iterations: int = 50, tolerance: float = 1e-9, ridge: float = 1e-8) -> dict:
    """Newton-Raphson; each iteration is one aggregation, and only its sums reach the driver."""
    p, beta, last = len(covariates), np.zeros(len(covariates)), -math.inf
    for step in range(1, iterations + 1):
        r = cox_terms(rows, time, event, covariates, beta.tolist(), stratum).first()
        if r is None or r["loglik"] is None:
            raise ValueError("no events")
        h = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        if abs(r["loglik"] - last) < tolerance:
            break
        last = r["loglik"]
        beta = beta + np.linalg.solve(h + ridge * np.eye(p), np.array([r[f"g{i}"] for i in range(p)]))
    return {"coefficients": beta.tolist(), "loglik": float(r["loglik"]), "errors": np.sqrt(np.diag(np.linalg.inv(h + ridge * np.eye(p)))).tolist(), "iterations": step}


def competing_risks(rows: DataFrame, time: str, kind: str, covariates: list[str], *, of_interest: int = 1, stratum: str | None = None) -> dict:
    """Cause-specific fits; the other cause counts as censored."""
    fit = lambda c: fit_cox(rows.withColumn("__e", c.cast("int")), time, "__e", covariates, stratum=stratum)
    return {"interest": fit(F.col(kind) == of_interest), "competing": fit((F.col(kind) > 0) & (F.col(kind) != of_interest))}


def cluster_pair_sums(rows: DataFrame, cluster: str, residual: str) -> DataFrame:
    """pairs, cross: number and sum of products of ordered pairs within clusters, from sums and squares alone."""
    by = rows.groupBy(cluster).agg(F.count("*").alias("m"), F.sum(residual).alias("s"), F.sum(F.col(residual) * F.col(residual)).alias("ss"))
    return by.agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"), F.sum(F.col("s") * F.col("s") - F.col("ss")).alias("cross"))


def fit_gee(rows: DataFrame, response: str, covariates: list[str], cluster: str, *, iterations: int = 100, tolerance: float = 1e-8) -> dict:
    """Logistic GEE with exchangeable correlation. The inverse of a cluster's working matrix is closed-form, so an
    iteration is a sum a cluster and their total; covariates include the intercept."""
    p, beta, rho = len(covariates), np.zeros(len(covariates)), 0.0
    for step in range(1, iterations + 1):
        eta = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, covariates, strict=True)), F.lit(0.0))
        mu = 1.0 / (1.0 + F.exp(-eta))
        sd = F.sqrt(F.greatest(mu * (1 - mu), F.lit(1e-12)))
        data = rows.select(F.col(cluster).alias("__c"), ((F.col(response) - mu) / sd).alias("__e"), (F.col(response) - mu).alias("__r"), sd.alias("__sd"), *covariates)
        by = data.groupBy("__c").agg(
            F.count("*").cast("double").alias("m"), F.sum("__e").alias("e"), F.sum(F.col("__e") ** 2).alias("ee"),
            *(F.sum(F.col(c) * F.col("__sd")).alias(f"x{i}") for i, c in enumerate(covariates)),
            *(F.sum(F.col(c) * F.col("__sd") * F.col("__e")).alias(f"xe{i}") for i, c in enumerate(covariates)),
            *(F.sum(F.col(covariates[i]) * F.col(covariates[j]) * F.col("__sd") ** 2).alias(f"xx{i}_{j}") for i in range(p) for j in range(i, p)),
        )
        f = F.lit(rho) / (1.0 + (F.col("m") - 1.0) * rho)
        scale = 1.0 / (1.0 - rho)
        total = by.agg(
            F.sum("m").alias("n"), F.sum("ee").alias("ee"), F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"), F.sum(F.col("e") ** 2 - F.col("ee")).alias("cross"),
            *(F.sum(scale * (F.col(f"xe{i}") - f * F.col(f"x{i}") * F.col("e"))).alias(f"u{i}") for i in range(p)),
            *(F.sum(scale * (F.col(f"xx{i}_{j}") - f * F.col(f"x{i}") * F.col(f"x{j}"))).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)),
            *(F.sum(F.col(f"xe{i}") * F.col(f"xe{j}")).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)),
        ).first()
        h, q = np.zeros((p, p)), np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                h[i, j] = h[j, i] = total[f"h{i}_{j}"]
                q[i, j] = q[j, i] = total[f"q{i}_{j}"]
        move = np.linalg.solve(h, np.array([total[f"u{i}"] for i in range(p)]))
        phi = total["ee"] / max(total["n"] - p, 1.0)
        rho = float(np.clip(total["cross"] / max(total["pairs"], 1.0) / max(phi, 1e-12), 0.0, 0.95))
        beta = beta + move
        if np.abs(move).max() < tolerance:
            break
    bread = np.linalg.inv(h)
    return {"coefficients": beta.tolist(), "errors": np.sqrt(np.diag(bread @ q @ bread)).tolist(), "correlation": rho, "iterations": step}


def bootstrap_mean(rows: DataFrame, by: list[str], value: str, *, resamples: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """by, mean, sd, n, lower, upper with numpy's PCG64 resamples of each group; a group fits a task (groups of runs)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy(float))
        draws = x[np.random.default_rng(seed).integers(0, len(x), (resamples, len(x)))].mean(axis=1)
        lo, hi = np.quantile(draws, [(1 - level) / 2, 1 - (1 - level) / 2])
        return pdf[by].head(1).assign(mean=x.mean(), sd=x.std(ddof=1) if len(x) > 1 else 0.0, n=len(x), lower=lo, upper=hi)

    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.select(*by, value).groupBy(*by).applyInPandas(run, f"{keys}, mean double, sd double, n long, lower double, upper double")


def poisson_weight(key: Column, replicate: Column, seed: int = 0) -> Column:
    """The Poisson(1) weight of a row in a replicate, from a hash of its key alone; weights of 8 and more are 8."""
    cuts, total = [], 0.0
    for n in range(8):
        total += math.exp(-1) / math.factorial(n)
        cuts.append((n, total))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), replicate.cast("string"), F.lit(":"), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = F.lit(8.0)
    for n, c in reversed(cuts):
        out = F.when(u < c, F.lit(float(n))).otherwise(out)
    return out


def replicates(rows: DataFrame, by: list[str], key: str, states: dict[str, Column], *, more: tuple[str, ...] = (), resamples: int = 200, seed: int = 0) -> DataFrame:
    """by, ``replicate``, further keys and the states: for each replicate the sum of every state's column, each row as
    often as its weight says. A state is what merges: a row is never copied beyond its task, which sums its rows by
    group and replicate before anything is shuffled."""
    spread = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("__w", poisson_weight(F.col(key), F.col("replicate"), seed))
    return spread.where("__w > 0").groupBy(*by, "replicate", *more).agg(*(F.sum(F.col("__w") * c).alias(n) for n, c in states.items()))


def interval(values: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """by, lower, upper: the central share of a statistic over its replicates, as many values a group as those."""
    ends = [F.percentile(value, F.lit(p)).alias(n) for n, p in (("lower", (1 - level) / 2), ("upper", 1 - (1 - level) / 2))]
    return values.groupBy(*by).agg(*ends)


def poisson_bootstrap(rows: DataFrame, by: list[str], value: str, key: str, *, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """by, lower, upper of a mean at any scale."""
    sums = replicates(rows, by, key, {"n": F.when(F.col(value).isNotNull(), 1.0), "s": F.col(value)}, resamples=resamples, seed=seed)
    return interval(sums.withColumn("x", F.col("s") / F.nullif("n", F.lit(0.0))), by, "x", level)


def bootstrap_spread(rows: DataFrame, by: list[str], value: str, key: str, *, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """by, point, lower, upper of a sample standard deviation, from weighted sums and squares about the group's mean."""
    v = F.col(value).cast("double")
    mean = rows.where(v.isNotNull()).groupBy(*by).agg(F.avg(v).alias("__m"), F.stddev_samp(v).alias("point"))  # a row a group
    d = rows.join(mean.drop("point"), by).withColumn("__d", v - F.col("__m"))
    sums = replicates(d.where("__d is not null"), by, key, {"n": F.lit(1.0), "s": F.col("__d"), "ss": F.col("__d") * F.col("__d")}, resamples=resamples, seed=seed)
    x = F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.nullif("n", F.lit(0.0)), F.lit(0.0)) / F.nullif(F.col("n") - 1.0, F.lit(0.0)))
    return mean.drop("__m").join(interval(sums.withColumn("x", x), by, "x", level), by)


def _binned(value: str, low: float, high: float, bins: int) -> Column:
    return F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def _quantile(states: DataFrame, keys: list[str], share: float, low: float, high: float, bins: int) -> DataFrame:
    """keys, x: the quantile of weighted histograms (keys, bin, n), linear within the bin that reaches the share."""
    over = Window.partitionBy(*keys).orderBy("bin")  # as many rows as bins
    rows = states.select("*", F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("__c"), F.sum("n").over(Window.partitionBy(*keys)).alias("__all"))
    inside = (F.lit(share) * F.col("__all") - (F.col("__c") - F.col("n"))) / F.col("n")
    x = F.lit(low) + (F.col("bin") + inside) * F.lit((high - low) / bins)
    return rows.where((F.col("__c") >= share * F.col("__all")) & (F.col("n") > 0)).groupBy(*keys).agg(F.min_by(x, "bin").alias("x"))


def bootstrap_quantile(rows: DataFrame, by: list[str], value: str, key: str, *, share: float = 0.5, low: float = 0.0, high: float = 1.0, bins: int = 256, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """by, point, lower, upper of a quantile, read from histograms of equal bins from low to high (values beyond count in
    the end bins): as exact as a bin, and ``bins`` sums a group and replicate whatever the rows."""
    held = rows.where(F.col(value).isNotNull()).withColumn("bin", _binned(value, low, high, bins))
    point = _quantile(held.groupBy(*by, "bin").agg(F.count("*").cast("double").alias("n")), by, share, low, high, bins).withColumnRenamed("x", "point")
    drawn = replicates(held, by, key, {"n": F.lit(1.0)}, more=("bin",), resamples=resamples, seed=seed)
    return point.join(interval(_quantile(drawn, [*by, "replicate"], share, low, high, bins), by, "x", level), by)


def _area(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x: the ROC area of weighted counts (keys, bin, pos, neg), ties within a bin half; NULL without a class."""
    over = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bins
    rows = states.withColumn("__below", F.coalesce(F.sum("neg").over(over), F.lit(0.0)))
    good = F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2.0))
    return rows.groupBy(*keys).agg((good / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("x"))


def bootstrap_area(rows: DataFrame, by: list[str], score: str, label: str, key: str, *, low: float = 0.0, high: float = 1.0, bins: int = 256, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """by, point, lower, upper of the area under the ROC curve of scores in bins; scores of one bin tie."""
    held = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("bin", _binned(score, low, high, bins))
    y = F.col(label).cast("int").cast("double")
    point = _area(held.groupBy(*by, "bin").agg(F.sum(y).alias("pos"), F.sum(1.0 - y).alias("neg")), by).withColumnRenamed("x", "point")
    drawn = replicates(held, by, key, {"pos": y, "neg": 1.0 - y}, more=("bin",), resamples=resamples, seed=seed)
    return point.join(interval(_area(drawn, [*by, "replicate"]), by, "x", level), by)


def sizing(spark: SparkSession, *, baseline: float = 0.70, margin: float = 0.081, prevalence: float = 0.25, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143, correlations: tuple[float, ...] = (0.3, 0.4, 0.5), ceiling: int = 20_000) -> DataFrame:
    """correlation, records: the first even size whose paired difference is detected; NULL beyond the ceiling."""
    n = F.col("records").cast("double")
    rows = spark.range(20, ceiling + 1, 2).withColumnRenamed("id", "records")
    rows = rows.select("records", F.explode(F.array(*(F.lit(float(c)) for c in correlations))).alias("correlation"))
    var = paired_variance(F.lit(baseline), F.lit(baseline + margin), n * prevalence, n * (1 - prevalence), F.col("correlation"))
    ok = F.lit(margin) / F.sqrt(var) >= z_alpha + z_power
    return rows.groupBy("correlation").agg(F.min(F.when(ok, F.col("records"))).alias("records"))


def power_curve(spark: SparkSession, sizes: list[int], *, baseline: float = 0.70, margin: float = 0.081, prevalence: float = 0.25, z_alpha: float = 1.959963984540054, correlation: float = 0.4) -> DataFrame:
    """records, power of the two-sided paired comparison at each size."""
    n = F.col("records").cast("double")
    var = paired_variance(F.lit(baseline), F.lit(baseline + margin), n * prevalence, n * (1 - prevalence), F.lit(correlation))
    rows = spark.createDataFrame([(s,) for s in sizes], "records long").withColumn("shift", F.lit(margin) / F.sqrt(var))
    return rows.select("records", (normal_cdf(F.col("shift") - z_alpha) + normal_cdf(-F.col("shift") - z_alpha)).alias("power"))


def linear_r2(rows: DataFrame, features: list[str], target: str) -> float:
    """R2 of least squares with an intercept, from one aggregation of moments; rank deficiency is pseudo-inverted."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y, p = F.col(target).cast("double"), len(features) + 1
    r = rows.agg(*(F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(cols[i] * y).alias(f"v{i}") for i in range(p)), F.sum(y * y).alias("yy"), F.sum(y).alias("sy"), F.count("*").alias("n")).first()
    m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    v = np.array([r[f"v{i}"] for i in range(p)])
    total = r["yy"] - r["sy"] ** 2 / r["n"]
    return 0.0 if total <= 1e-15 else float(1 - (r["yy"] - v @ np.linalg.pinv(m) @ v) / total)


def grouped_r2(rows: DataFrame, by: list[str], nested: dict[str, list[str]], target: str, *, tolerance: float = 1e-10) -> DataFrame:
    """by, n and for each name of ``nested`` the R2 of least squares of the target on its features, with an intercept, in
    every group at once: one aggregation gives all groups' moments, and sweeps of the features, a projection each, solve
    all groups' normal equations as arithmetic of their rows.

    A list of features must begin with those of the list before. A feature that the ones before it explain (up to
    ``tolerance`` of its own variance) adds nothing, which gives the R2 of the pseudo-inverse. Rows with a null in the
    target or a feature take no part; a target without variance has R2 0.
    """
    features = max(nested.values(), key=len)
    if any(features[: len(f)] != f for f in nested.values()):
        raise ValueError("the lists of features are not nested")
    p = len(features)
    named = [F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate([*features, target])]
    data = rows.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(by)), *named).dropna(subset=[f"__x{i}" for i in range(p + 1)])
    keys = [f"__k{i}" for i in range(len(by))]
    # moments about each group's means: sums of products cancel
    mean = data.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.avg(f"__x{i}").alias(f"__m{i}") for i in range(p + 1)))  # a row a group
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    about = data.join(mean.withColumnsRenamed({k: f"{k}_" for k in keys}), same) if keys else data.crossJoin(F.broadcast(mean))
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    d = lambda i: F.col(f"__x{i}") - F.col(f"__m{i}")
    out = about.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.sum(d(i) * d(j)).alias(f"s{i}_{j}") for i, j in pairs))
    out = out.withColumns({**{f"v{i}": F.col(f"s{i}_{i}") for i in range(p + 1)}, "gain": F.lit(0.0), "r2_0": F.lit(0.0)})
    for i in range(p):
        # the feature goes out of what is left of the later ones
        out = out.withColumn("pivot", F.when(F.col(f"s{i}_{i}") > tolerance * F.col(f"v{i}"), F.col(f"s{i}_{i}")))
        gone = {f"s{a}_{b}": F.coalesce(F.col(f"s{a}_{b}") - F.col(f"s{i}_{a}") * F.col(f"s{i}_{b}") / F.col("pivot"), F.col(f"s{a}_{b}")) for a, b in pairs if a > i}
        out = out.withColumns({**gone, "gain": F.col("gain") + F.coalesce(F.col(f"s{i}_{p}") * F.col(f"s{i}_{p}") / F.col("pivot"), F.lit(0.0))})
        out = out.withColumn(f"r2_{i + 1}", F.when(F.col(f"v{p}") > 1e-15, F.col("gain") / F.col(f"v{p}")).otherwise(0.0))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), F.col("__n").alias("n"), *(F.col(f"r2_{len(f)}").alias(name) for name, f in nested.items()))


def reader_design(rows: DataFrame, reader: str, arm: str) -> tuple[DataFrame, list[str]]:
    """rows with intercept, assisted_arm and an indicator for each reader but the first (by text), and their names."""
    readers = sorted(str(r[0]) for r in rows.select(reader).distinct().collect())  # a row a reader
    flags = {f"reader_{r}": (F.col(reader).cast("string") == r).cast("double") for r in readers[1:]}
    out = rows.withColumns({"intercept": F.lit(1.0), "assisted_arm": F.col(arm).cast("double"), **flags})
    return out, ["intercept", "assisted_arm", *flags]


def arm_gain(fit: dict, names: list[str], arm: str = "assisted_arm", z: float = 1.959963984540054) -> dict:
    """coefficient, lower, upper, odds_ratio, p of the arm in a fit."""
    b, e = fit["coefficients"][names.index(arm)], fit["errors"][names.index(arm)]
    return {"coefficient": b, "lower": b - z * e, "upper": b + z * e, "odds_ratio": math.exp(b), "p": two_sided_p(b / e) if e > 0 else 1.0}


def accrual_covers(minima: DataFrame, low: int = 750) -> DataFrame:
    """covered, total, all_covered: how many sizing assumptions the low end of accrual meets."""
    return minima.agg(F.count_if(F.col("records") <= low).alias("covered"), F.count("*").alias("total")).withColumn("all_covered", F.col("covered") == F.col("total"))


