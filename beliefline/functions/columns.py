"""Column builders of the evidence algebra. Masses are structs (v, n, theta): support, denial and ignorance.

Everything stays a Catalyst expression; NULL stands for absent evidence and maps to the vacuous mass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modalities in their declared order, commitments of the default map, tolerances.
MODALITIES = ("KG", "DEP", "FLUX", "CLIN")
COMMITMENT = {"KG": 0.88, "DEP": 0.92, "FLUX": 0.80, "CLIN": 0.72}
SLOPE, OFFSET = 6.0, -3.0
SUM_TOLERANCE, SIGN_TOLERANCE = 1e-7, 1e-9
MASS = "struct<v: double, n: double, theta: double>"


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamped x; NULL stays NULL, which least and greatest alone would not give."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    q = clip(p, 1e-12, 1.0 - 1e-12)
    return F.ln(q / (1.0 - q))


def absent(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def mass(v, n, theta) -> Column:
    return F.struct(num(v).alias("v"), num(n).alias("n"), num(theta).alias("theta"))


def vacuous() -> Column:
    return mass(0, 0, 1)


def certain() -> Column:
    return mass(1, 0, 0)


def denied() -> Column:
    return mass(0, 1, 0)


def is_simplex(m: Column) -> Column:
    parts = (m["v"], m["n"], m["theta"])
    low = [p >= -SIGN_TOLERANCE for p in parts]
    return low[0] & low[1] & low[2] & (F.abs(parts[0] + parts[1] + parts[2] - 1.0) <= SUM_TOLERANCE)


def is_vacuous(m: Column, tolerance: float = SIGN_TOLERANCE) -> Column:
    return F.abs(m["theta"] - 1.0) <= tolerance


def belief(m: Column) -> Column:
    return m["v"]


def plausibility(m: Column) -> Column:
    return m["v"] + m["theta"]


def pignistic(m: Column) -> Column:
    return m["v"] + m["theta"] / 2.0


def width(m: Column) -> Column:
    return m["theta"]


def from_posterior(p: Column, ignorance=0.0) -> Column:
    """(1 - ignorance) split by p."""
    q, free = clip(p), num(ignorance)
    return mass((1.0 - free) * q, (1.0 - free) * (1.0 - q), free)


def posterior(score: Column, slope=SLOPE, offset=OFFSET) -> Column:
    return sigmoid(num(slope) * clip(score) + num(offset))


def map_score(score: Column, commitment, slope=SLOPE, offset=OFFSET) -> Column:
    """A score's mass; an absent one has the vacuous mass."""
    c = F.greatest(num(commitment), F.lit(1e-6))
    return F.when(absent(score), vacuous()).otherwise(from_posterior(posterior(score, slope, offset), 1.0 - c))


def discount(m: Column, rate) -> Column:
    """Shafer's discounting: what the rate takes from support and denial becomes ignorance."""
    a = num(rate)
    return mass(a * m["v"], a * m["n"], 1.0 - a + a * m["theta"])


def undiscount(m: Column, rate) -> Column:
    """The inverse; NULL where ignorance is below the floor of the rate or the rate is 0."""
    a = num(rate)
    theta = (m["theta"] - (1.0 - a)) / F.nullif(a, F.lit(0.0))
    return F.when((a > 0) & (theta >= -SIGN_TOLERANCE), mass(m["v"] / F.nullif(a, F.lit(0.0)), m["n"] / F.nullif(a, F.lit(0.0)), F.greatest(theta, F.lit(0.0))))


def discount_floor(rate) -> Column:
    return 1.0 - num(rate)


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """(mass, conflict) of the pair rule that turns conflict into ignorance."""
    k = a["v"] * b["n"] + a["n"] * b["v"]
    v = a["v"] * b["v"] + a["v"] * b["theta"] + a["theta"] * b["v"]
    n = a["n"] * b["n"] + a["n"] * b["theta"] + a["theta"] * b["n"]
    return mass(v, n, a["theta"] * b["theta"] + k), k


def dempster_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """(mass, conflict) of Dempster's rule; the mass is NULL where conflict is total."""
    k = a["v"] * b["n"] + a["n"] * b["v"]
    rest = F.nullif(1.0 - k, F.lit(0.0))
    v = a["v"] * b["v"] + a["v"] * b["theta"] + a["theta"] * b["v"]
    n = a["n"] * b["n"] + a["n"] * b["theta"] + a["theta"] * b["n"]
    return F.when(k < 1.0 - 1e-15, mass(v / rest, n / rest, a["theta"] * b["theta"] / rest)), k


def fold(masses: Column, rule=pair) -> Column:
    """The ordered left fold of an array of masses: struct (m, ks) with the conflict of each step.

    The rule is not associative, so this is a higher-order fold over an array in a given order, never an aggregate.
    """
    start = F.struct(F.element_at(masses, 1).cast(MASS).alias("m"), F.array().cast("array<double>").alias("ks"))

    def step(acc: Column, m: Column) -> Column:
        out, k = rule(acc["m"], m)
        return F.struct(out.cast(MASS).alias("m"), F.concat(acc["ks"], F.array(k)).alias("ks"))

    return F.aggregate(F.slice(masses, F.lit(2), F.greatest(F.size(masses) - 1, F.lit(0))), start, step)


def _total(masses: Column, field: str) -> Column:
    return F.aggregate(masses, F.lit(0.0), lambda s, m: s + m[field])


def average(masses: Column) -> Column:
    """Component means."""
    n = F.size(masses).cast("double")
    return mass(*(_total(masses, f) / n for f in ("v", "n", "theta")))


def normalised_sum(masses: Column) -> Column:
    """Component sums over their total."""
    v, n, t = (_total(masses, f) for f in ("v", "n", "theta"))
    total = F.nullif(v + n + t, F.lit(0.0))
    return mass(v / total, n / total, t / total)


def log_odds(probabilities: Column, prior: float = 0.5) -> Column:
    """The posterior from an array of probabilities that are taken as independent."""
    base = math.log(prior / (1 - prior))
    total = F.aggregate(probabilities, F.lit(0.0), lambda s, p: s + logit(p) - base) + base
    return clip(sigmoid(clip(total, -1e6, 1e6)))


def trace(ks: Column, labels: list[str], threshold: float) -> Column:
    """An entry for each fold step: step, pair, k_mass, flagged (k_mass >= threshold)."""
    names = F.array(*(F.lit("|".join(labels[: i + 1]) + "+" + labels[i + 1]) for i in range(len(labels) - 1)))
    return F.transform(ks, lambda k, i: F.struct((i + 1).alias("step"), F.get(names, i).alias("pair"), k.alias("k_mass"), (k >= threshold).alias("flagged")))


def hanley_mcneil(auc: Column, positives: Column, negatives: Column) -> Column:
    q1, q2 = auc / (2.0 - auc), 2.0 * auc * auc / (1.0 + auc)
    return (auc * (1.0 - auc) + (positives - 1.0) * (q1 - auc * auc) + (negatives - 1.0) * (q2 - auc * auc)) / (positives * negatives)


def paired_variance(base: Column, other: Column, positives: Column, negatives: Column, correlation: Column) -> Column:
    a, b = hanley_mcneil(base, positives, negatives), hanley_mcneil(other, positives, negatives)
    return a + b - 2.0 * correlation * F.sqrt(a * b)


def dependency_score(effect: Column, floor: float = -0.1, span: float = 1.2) -> Column:
    return clip((floor - effect) / span)


def drug_score(response: Column, floor: float = -0.2, span: float = 1.0) -> Column:
    return clip((floor - response) / span)


def purity_attenuated(score: Column, attenuation: float = 0.6) -> Column:
    return clip(score * attenuation)


def association_strength(correlation: Column, ceiling: float = 0.6) -> Column:
    return clip(F.abs(correlation) / ceiling)


def single_pignistic(score: Column, rate: Column) -> Column:
    return rate * score + (1.0 - rate) / 2.0


def supports(score: Column, threshold: float = 0.5) -> Column:
    """Whether a score speaks for a candidate; NULL where there is none."""
    return score >= threshold


def disagreement(*values: Column) -> Column:
    """How far values lie apart."""
    return F.greatest(*values) - F.least(*values)


def query_string(source: Column, version: Column, query: Column, release_date: Column) -> Column:
    """A reference as one string; the date only where there is one."""
    return F.concat_ws("|", source, version, query, release_date)


def citation_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def seed_from_text(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256, modulo 2^31 - 1."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(2147483647).cast("decimal(20,0)")).cast("long")


def strict_date(text: Column) -> Column:
    """A date from yyyy-MM-dd and nothing else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


#: Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_ppf(p: Column) -> Column:
    """The inverse normal distribution as an expression; NULL outside (0, 1)."""
    q, low = p - 0.5, 0.02425
    t = F.sqrt(-2.0 * F.ln(p))
    u = F.sqrt(-2.0 * F.ln(1.0 - p))
    middle = _horner(q * q, _A) * q / _horner(q * q, (*_B, 1.0))
    return F.when((p > 0) & (p < 1), F.when(p < low, _horner(t, _C) / _horner(t, (*_D, 1.0))).when(p > 1 - low, -_horner(u, _C) / _horner(u, (*_D, 1.0))).otherwise(middle))


def learning_rate(step: Column, total: int, *, rate: float, least: float = 0.0, warmup: float = 0.0, schedule: str = "cosine") -> Column:
    """The rate at a step: a linear warm-up over a share of the steps, then constant, linear or cosine decay."""
    first = int(warmup * total)
    progress = clip((step - first) / float(max(1, total - first)))
    decay = {"constant": F.lit(rate), "linear": rate + progress * (least - rate), "cosine": least + (rate - least) * 0.5 * (1.0 + F.cos(math.pi * progress))}[schedule]
    return F.when(step < first, rate * (step + 1) / float(max(1, first))).otherwise(decay)
