"""Scores to masses, discounting, ordered combination, reports, rankings and the ablation battery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordering import ranked

#: Score columns of wide candidate tables.
SCORES = {"KG": "kg", "DEP": "dep", "FLUX": "flux", "CLIN": "clin"}


def reliability_order(rates: dict[str, float]) -> list[str]:
    """Modalities by falling rate, ties in their declared order."""
    if set(rates) != set(C.MODALITIES) or not all(0 <= r <= 1 for r in rates.values()):
        raise ValueError("a rate in [0, 1] is needed for each modality")
    return sorted(C.MODALITIES, key=lambda m: (-rates[m], C.MODALITIES.index(m)))


def ignorance_floor(rates: dict[str, float]) -> float:
    out = 1.0
    for r in rates.values():
        out *= 1.0 - r
    return out


def mass_of(modality: str, rates: dict[str, float], removed: tuple[str, ...] = ()) -> Column:
    """The discounted mass of a wide table's modality."""
    score = F.lit(None).cast("double") if modality in removed else F.col(SCORES[modality])
    return C.discount(C.map_score(score, C.COMMITMENT[modality]), rates[modality])


def long_masses(candidates: DataFrame, rates: dict[str, float]) -> DataFrame:
    """A row for each candidate and modality: score, mass, discounted mass, pignistic value, available."""
    spark = candidates.sparkSession
    long = candidates.unpivot("candidate", list(SCORES.values()), "column", "score")
    dims = spark.createDataFrame([(SCORES[m], m, i, C.COMMITMENT[m], rates[m]) for i, m in enumerate(C.MODALITIES)], "column string, modality string, ordinal int, commitment double, rate double")
    rows = long.join(F.broadcast(dims), "column")  # four rows
    rows = rows.withColumn("mass", C.map_score(F.col("score"), F.col("commitment"))).withColumn("discounted", C.discount(F.col("mass"), F.col("rate")))
    return rows.select("candidate", "modality", "ordinal", "score", "rate", "mass", "discounted", C.pignistic(F.col("discounted")).alias("betp"), (~C.absent(F.col("score"))).alias("available"))


def combined(candidates: DataFrame, rates: dict[str, float], *, rule=C.pair, removed: tuple[str, ...] = ()) -> DataFrame:
    """candidates with ``fused`` (m, ks): the ordered fold of the four discounted masses."""
    order = reliability_order(rates)
    return candidates.withColumn("fused", C.fold(F.array(*(mass_of(m, rates, removed) for m in order)), rule))


def reports(candidates: DataFrame, rates: dict[str, float], threshold: float = 0.05) -> DataFrame:
    """candidate, bel, pl, betp, width, total_conflict, trace and the modalities' pignistic values."""
    order = reliability_order(rates)
    rows = combined(candidates, rates)
    m = F.col("fused")["m"]
    ks = F.col("fused")["ks"]
    return rows.select(
        *candidates.columns,
        C.belief(m).alias("bel"), C.plausibility(m).alias("pl"), C.pignistic(m).alias("betp"), C.width(m).alias("width"),
        F.aggregate(ks, F.lit(0.0), lambda s, k: s + k).alias("total_conflict"),
        C.trace(ks, order, threshold).alias("trace"),
        *(C.pignistic(mass_of(x, rates)).alias(f"betp_{SCORES[x]}") for x in C.MODALITIES),
        sum((C.absent(F.col(c)).cast("int") for c in SCORES.values()), F.lit(0)).alias("absent_modalities"),
    )


def concordance_labels(rows: DataFrame, margin: float, digits: int | None = None) -> DataFrame:
    """Rows of reports() with ``disagreement``, how far the four modalities' values lie apart, and ``concordant``, whether
    by no more than the margin."""
    apart = C.disagreement(*(F.col(f"betp_{c}") for c in SCORES.values()))
    return rows.withColumn("disagreement", apart if digits is None else F.round(apart, digits)).withColumn("concordant", F.col("disagreement") <= margin)


def support_counts(candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """modality, supporting, opposing, absent: how many candidates each modality's score speaks for."""
    long = candidates.unpivot("candidate", list(SCORES.values()), "column", "score").withColumn("s", C.supports(F.col("score"), threshold))
    return long.groupBy(F.upper("column").alias("modality")).agg(F.count_if("s").alias("supporting"), F.count_if(~F.col("s")).alias("opposing"), F.count_if(F.col("s").isNull()).alias("absent"))


def rank_reports(rows: DataFrame) -> DataFrame:
    """With ``rank``: by betp descending, candidate ascending."""
    return ranked(rows, "betp", "candidate")


def trace_rows(rows: DataFrame) -> DataFrame:
    return rows.select("candidate", F.explode("trace").alias("t")).select("candidate", "t.*")


def trace_summary(rows: DataFrame) -> DataFrame:
    """Steps, flagged steps, total and dominant (first greatest) step of each candidate's trace."""
    best = F.array_max(F.transform("trace", lambda t: F.struct(t["k_mass"].alias("k"), (-t["step"]).alias("s"))))
    return rows.select("candidate", F.size("trace").alias("steps"), F.size(F.filter("trace", lambda t: t["flagged"])).alias("flagged_steps"), "total_conflict", best["k"].alias("dominant_k"), (-best["s"]).alias("dominant_step"))


def violations(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows of reports() that break an invariant: bel <= betp <= pl, width = pl - bel, conflict >= 0."""
    bad = (F.col("bel") > F.col("betp") + tolerance) | (F.col("betp") > F.col("pl") + tolerance) | (F.abs(F.col("pl") - F.col("bel") - F.col("width")) > tolerance) | (F.col("total_conflict") < -tolerance)
    return rows.where(bad)


def enumerated_pair(pairs: DataFrame) -> DataFrame:
    """The pair rule restated on focal sets: pairs (id, a, b of masses) become nine products, summed by intersection."""
    focal = lambda m: F.array(*(F.struct(F.lit(s).alias("s"), m[f].alias("w")) for s, f in (("V", "v"), ("N", "n"), ("T", "theta"))))
    rows = pairs.select("id", F.explode(focal(F.col("a"))).alias("x"), "b").select("id", "x", F.explode(focal(F.col("b"))).alias("y"))
    conflict = ((F.col("x.s") == "V") & (F.col("y.s") == "N")) | ((F.col("x.s") == "N") & (F.col("y.s") == "V"))
    target = F.when(conflict, "T").when(F.col("x.s") == "T", F.col("y.s")).otherwise(F.col("x.s"))
    w = F.col("x.w") * F.col("y.w")
    return rows.groupBy("id").agg(*(F.sum(F.when(target == s, w).otherwise(0.0)).alias(n) for s, n in (("V", "v"), ("N", "n"), ("T", "theta"))), F.sum(F.when(conflict, w).otherwise(0.0)).alias("k"))


def alternatives(candidates: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Averaging, normalised sum, Dempster's rule and log odds beside the ordered rule."""
    order = reliability_order(rates)
    masses = F.array(*(mass_of(m, rates) for m in order))
    rows = candidates.select("candidate", masses.alias("ms"))
    rows = rows.select("candidate", "ms", C.average(F.col("ms")).alias("avg"), C.normalised_sum(F.col("ms")).alias("norm"), C.fold(F.col("ms"), C.dempster_pair).alias("ds"), C.log_odds(F.transform("ms", C.pignistic)).alias("log_odds"))
    return rows.select(
        "candidate", F.col("avg.v").alias("avg_v"), F.col("avg.theta").alias("avg_theta"), C.pignistic(F.col("norm")).alias("norm_betp"),
        C.pignistic(F.col("ds.m")).alias("dempster_betp"), F.col("ds.m.theta").alias("dempster_width"), F.aggregate("ds.ks", F.lit(0.0), lambda s, k: s + k).alias("dempster_conflict"), "log_odds",
    )


def ablation_plan() -> list[tuple[str, str, str]]:
    """(label, rule, removed modality): the full fold, its substitutes, and the fold without each modality."""
    return [("full", "fold", ""), ("average", "average", ""), ("dempster", "dempster", ""), ("log_odds", "log_odds", ""), *((f"without_{m.lower()}", "fold", m) for m in C.MODALITIES), *((f"single_{m.lower()}", "single", m) for m in C.MODALITIES)]


def _unrolled(masses: list[Column], rows: DataFrame, name: str, dempster: bool = False) -> DataFrame:
    """rows with the ordered fold of mass columns as plain columns, a projection a step: <name>_v, _n, _t and _k (total
    conflict). Steps are arithmetic that code generation covers, and each is computed once. Dempster's rule gives NULLs
    after total conflict."""
    v, n, t, k = (f"{name}_{c}" for c in "vntk")
    first = masses[0]
    rows = rows.withColumns({v: first["v"], n: first["n"], t: first["theta"], k: F.lit(0.0), "__k": F.lit(0.0)})
    for m in masses[1:]:
        rows = rows.withColumn("__k", F.col(v) * m["n"] + F.col(n) * m["v"])
        support = F.col(v) * m["v"] + F.col(v) * m["theta"] + F.col(t) * m["v"]
        denial = F.col(n) * m["n"] + F.col(n) * m["theta"] + F.col(t) * m["n"]
        if dempster:
            rest = F.when(F.col("__k") < 1.0 - 1e-15, 1.0 - F.col("__k"))
            parts = (support / rest, denial / rest, F.col(t) * m["theta"] / rest)
        else:
            parts = (support, denial, F.col(t) * m["theta"] + F.col("__k"))
        rows = rows.withColumns({v: parts[0], n: parts[1], t: parts[2], k: F.col(k) + F.col("__k")})
    return rows.drop("__k")


def ablation_scores(candidates: DataFrame, rates: dict[str, float]) -> DataFrame:
    """label, candidate, vulnerable, score, width, conflict for every cell of the plan; one scan of the candidates.

    Masses are columns, made once; folds are unrolled over them; a cell then is a struct of what is there.
    """
    order = reliability_order(rates)
    base = [c for c in candidates.columns if c not in SCORES.values()]
    rows = candidates.select(*base, *(mass_of(m, rates).alias(f"__{m}") for m in order))
    mass = {m: F.col(f"__{m}") for m in order}
    rows = _unrolled([mass[m] for m in order], rows, "full")
    rows = _unrolled([mass[m] for m in order], rows, "dempster", dempster=True)
    for gone in C.MODALITIES:
        # a removed modality is a vacuous mass, which changes nothing
        rows = _unrolled([mass[m] for m in order if m != gone], rows, f"without_{gone.lower()}")

    def cell(label: str, rule: str, removed: str) -> Column:
        if rule == "fold":
            out = (F.col(f"{label}_v") + F.col(f"{label}_t") / 2.0, F.col(f"{label}_t"), F.col(f"{label}_k"))
        elif rule == "dempster":
            gone = F.col("dempster_t").isNull()
            out = (F.coalesce(F.col("dempster_v") + F.col("dempster_t") / 2.0, F.lit(0.5)), F.coalesce("dempster_t", F.lit(1.0)), F.when(gone, 1.0).otherwise(F.col("dempster_k")))
        elif rule == "average":
            n = float(len(order))
            v, t = (sum((mass[m][f] for m in order), F.lit(0.0)) / n for f in ("v", "theta"))
            out = (v + t / 2.0, t, F.lit(0.0))
        elif rule == "log_odds":
            out = (C.log_odds(F.array(*(C.pignistic(mass[m]) for m in order))), F.lit(0.0), F.lit(0.0))
        else:
            out = (C.pignistic(mass[removed]), mass[removed]["theta"], F.lit(0.0))
        return F.struct(F.lit(label).alias("label"), out[0].alias("score"), out[1].alias("width"), out[2].alias("conflict"))

    cells = rows.select("candidate", "vulnerable", F.inline(F.array(*(cell(*p) for p in ablation_plan()))))
    return cells.select("label", "candidate", "vulnerable", "score", "width", "conflict")


#: Fixed names of extraction levels and substitution rules.
LEVELS = ("full", "no-knowledge-graph", "single-agent", "no-verifier", "per-modality-removal")
RULES = ("conflict-redistributing", "dempster-renormalised", "naive-sum", "naive-average", "bayesian-log-odds")


def battery_plan() -> list[tuple]:
    """(label, level, rule, removed, score, interval) of the fifteen cells; the last two name what battery() makes."""
    fold, dempster, total, mean, odds = RULES
    out = [("full", LEVELS[0], fold, "", "fold", "fold"), ("no-knowledge-graph", LEVELS[1], fold, "", "without KG", "without KG"), ("no-verifier (naive average)", LEVELS[3], mean, "", mean, "fold")]
    for m in C.MODALITIES:
        out.append((f"single-agent ({m})", LEVELS[2], fold, "", f"single {m}", "fold"))
        out.append((f"remove {m}", LEVELS[4], fold, m, f"without {m}", f"without {m}"))
    return out + [(f"substitution: {rule}", LEVELS[0], rule, "", rule, dempster if rule == dempster else "fold") for rule in (dempster, total, mean, odds)]


def battery(candidates: DataFrame, rates: dict[str, float]) -> DataFrame:
    """label, level, rule, removed, candidate, vulnerable, score, width, conflict of every cell.

    A removed modality is a vacuous mass, which changes nothing in the fold, so the fold without one is the prefix before
    it, which the full fold has made, and what follows: two combinations at most. Each candidate's scores and intervals
    are made once and named; the plan's rows, fifteen whatever the candidates, pick from them. Rules without an interval
    of their own have that of the fold.
    """
    order = reliability_order(rates)
    base = [c for c in candidates.columns if c not in SCORES.values()]
    rows = candidates.select(*base, *(mass_of(m, rates).alias(f"__{m}") for m in order))
    mass = {m: F.col(f"__{m}") for m in order}
    names = {"fold": "p3"}
    rows = rows.withColumns(_start(mass[order[0]], "p0"))
    for i in range(1, 4):
        rows = _joined(rows, f"p{i - 1}", mass[order[i]], f"p{i}")
    for i, gone in enumerate(order):
        rest = [m for m in order[i + 1 :]]
        at = f"p{i - 1}"
        if i == 0:
            at, rest = "w0", rest[1:]
            rows = rows.withColumns(_start(mass[order[1]], at))
        for j, m in enumerate(rest):
            rows = _joined(rows, at, mass[m], f"w{i}_{j}")
            at = f"w{i}_{j}"
        names[f"without {gone}"] = at
    rows = _unrolled([mass[m] for m in order], rows, "d", dempster=True)
    fold, dempster, total, mean, odds = RULES
    sums = {f: sum((mass[m][f] for m in order), F.lit(0.0)) for f in ("v", "n", "theta")}
    whole = sums["v"] + sums["n"] + sums["theta"]
    scores = {name: F.col(f"{at}_v") + F.col(f"{at}_t") / 2.0 for name, at in names.items()} | {f"single {m}": C.pignistic(mass[m]) for m in order}
    scores |= {
        dempster: F.coalesce(F.col("d_v") + F.col("d_t") / 2.0, F.lit(0.5)), total: (sums["v"] + sums["theta"] / 2.0) / whole, mean: (sums["v"] + sums["theta"] / 2.0) / float(len(order)),
        odds: C.log_odds(F.array(*(C.pignistic(mass[m]) for m in order))),
    }
    intervals = {name: F.struct(F.col(f"{at}_t").alias("width"), F.col(f"{at}_k").alias("conflict")) for name, at in names.items()}
    intervals[dempster] = F.struct(F.coalesce("d_t", F.lit(1.0)).alias("width"), F.when(F.col("d_t").isNull(), 1.0).otherwise(F.col("d_k")).alias("conflict"))
    made = rows.select("candidate", "vulnerable", F.array(*scores.values()).alias("scores"), F.array(*intervals.values()).alias("intervals"))
    place = {name: i for i, name in enumerate(scores)}, {name: i for i, name in enumerate(intervals)}
    plan = candidates.sparkSession.createDataFrame([(*p[:4], place[0][p[4]], place[1][p[5]]) for p in battery_plan()], "label string, level string, rule string, removed string, s int, i int")
    cells = made.crossJoin(F.broadcast(plan))  # fifteen rows
    return cells.select("label", "level", "rule", "removed", "candidate", "vulnerable", F.get("scores", F.col("s")).alias("score"), F.get("intervals", F.col("i"))["width"].alias("width"), F.get("intervals", F.col("i"))["conflict"].alias("conflict"))


def _start(mass: Column, name: str) -> dict[str, Column]:
    """Columns of a fold that has one mass."""
    return {f"{name}_v": mass["v"], f"{name}_n": mass["n"], f"{name}_t": mass["theta"], f"{name}_k": F.lit(0.0)}


def _joined(rows: DataFrame, before: str, mass: Column, name: str) -> DataFrame:
    """rows with the fold ``name``: that of ``before`` and one more mass."""
    v, n, t = (F.col(f"{before}_{c}") for c in "vnt")
    rows = rows.withColumn("__k", v * mass["n"] + n * mass["v"])
    return rows.withColumns({
        f"{name}_v": v * mass["v"] + v * mass["theta"] + t * mass["v"], f"{name}_n": n * mass["n"] + n * mass["theta"] + t * mass["n"],
        f"{name}_t": t * mass["theta"] + F.col("__k"), f"{name}_k": F.col(f"{before}_k") + F.col("__k"),
    }).drop("__k")


def evaluate_battery(candidates: DataFrame, rates: dict[str, float], *, k: int = 10) -> DataFrame:
    """label, level, rule, removed, recall of the k best, mean_score, mean_width, mean_conflict, n of the fifteen cells."""
    cells = battery(candidates, rates)
    keys = ["label", "level", "rule", "removed"]
    means = cells.groupBy(*keys).agg(F.avg("score").alias("mean_score"), F.avg("width").alias("mean_width"), F.avg("conflict").alias("mean_conflict"), F.count("*").alias("n"), F.count_if("vulnerable").alias("p"))
    order = Window.partitionBy("label").orderBy(F.desc(F.round("score", 6)), "candidate")
    top = cells.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).groupBy("label").agg(F.count_if("vulnerable").alias("hits"))  # k rows a cell and task
    return means.join(top, "label").select(*keys, (F.col("hits") / F.nullif("p", F.lit(0))).alias("recall"), "mean_score", "mean_width", "mean_conflict", "n")


def evidence(candidates: DataFrame, *sources: DataFrame) -> DataFrame:
    """Long evidence (candidate, modality, score) of several sources, each candidate with every source's modality."""
    out = None
    for s in sources:
        out = s.select("candidate", "modality", "score") if out is None else out.unionByName(s.select("candidate", "modality", "score"))
    return candidates.select("candidate").join(out, "candidate", "left") if out is not None else candidates.select("candidate")
