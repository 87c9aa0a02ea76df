"""Flux balance on small stoichiometric networks: the network is a bounded payload, the tasks (reactions, genes) are rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gpr, simplex
from ..functions.columns import clip, purity_attenuated
from .ordering import ranked


#: Rule markers that are no genes, pathways without a capacity, the growth floor of capacities, weights of
#: primary and backup networks.
MARKERS, NO_CAPACITY = ("BIOMASS_MARKER", "ENVIRONMENT"), ("exchange", "drain", "biomass", "transport")
CAPACITY_FRACTION, PRIMARY, BACKUP = 0.999, 0.7, 0.3


@dataclass(frozen=True)
class Reaction:
    name: str
    coefficients: dict[str, float]
    rule: str = ""
    pathway: str = ""
    low: float = 0.0
    high: float = 1000.0


@dataclass(frozen=True)
class Network:
    reactions: tuple[Reaction, ...]
    objective: str

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stoichiometry, low, high)."""
        metabolites = list(dict.fromkeys(m for r in self.reactions for m in r.coefficients))
        s = np.zeros((len(metabolites), len(self.reactions)))
        for j, r in enumerate(self.reactions):
            for m, v in r.coefficients.items():
                s[metabolites.index(m), j] = v
        return s, np.array([r.low for r in self.reactions]), np.array([r.high for r in self.reactions])

    def index(self, name: str) -> int:
        return next(i for i, r in enumerate(self.reactions) if r.name == name)

    def blocked(self, gene: str) -> list[str]:
        return [r.name for r in self.reactions if r.rule and gpr.requires(r.rule, gene)]

    def without(self, *genes: str) -> Network:
        """The network with the reactions shut that the genes' loss disables."""
        gone = set(genes)
        return replace(self, reactions=tuple(replace(r, low=0.0, high=0.0) if r.rule and not gpr.is_active(r.rule, gone) else r for r in self.reactions))

    def with_medium(self, caps: dict[str, float]) -> Network:
        return replace(self, reactions=tuple(replace(r, high=caps[r.name], low=-caps[r.name] if r.low < 0 else r.low) if r.name in caps else r for r in self.reactions))

    def optimum(self, name: str | None = None, *, maximise: bool = True, floor: float | None = None) -> float:
        """The extreme flux of a reaction, growth pinned to ``floor`` if given; 0 if infeasible."""
        s, low, high = self.matrix()
        c = np.zeros(len(self.reactions))
        c[self.index(name or self.objective)] = 1.0 if maximise else -1.0
        rows, b = s, np.zeros(len(s))
        if floor is not None:
            pin = np.zeros((1, len(self.reactions)))
            pin[0, self.index(self.objective)] = 1.0
            rows, b = np.vstack([s, pin]), np.append(b, floor)
        found = simplex.maximise(c, rows, b, low, high)
        return 0.0 if found is None else (found[0] if maximise else -found[0])

    def has_rule(self, gene: str) -> bool:
        return bool(self.blocked(gene))

    def of_pathway(self, pathway: str) -> list[str]:
        return [r.name for r in self.reactions if r.pathway == pathway]

    def expressed(self, expression: dict[str, float], *, quantile: float = 0.25, threshold: float | None = None) -> Network:
        """The network with the reactions shut whose rule cannot hold on the genes expressed at the threshold (by default
        a quantile of the values); genes without a value are off, markers stay on."""
        cut = threshold if threshold is not None else float(np.quantile(list(expression.values()), quantile)) if expression else 0.0
        on = {g for g, v in expression.items() if v >= cut}

        def shut(r: Reaction) -> bool:
            off = {g for g in gpr.genes(r.rule) if g not in on and g not in MARKERS} if r.rule else set()
            return bool(off) and not gpr.is_active(r.rule, off)

        return replace(self, reactions=tuple(replace(r, low=0.0, high=0.0) if shut(r) else r for r in self.reactions))

    def capacity(self, pathway: str, floor: float) -> float:
        """The sum of the greatest |flux| of a pathway's reactions with growth at the floor."""
        return sum(abs(self.optimum(n, floor=floor)) for n in self.of_pathway(pathway))

    def capacities(self, fraction: float) -> dict[str, float]:
        """Capacity by pathway at a fraction of optimal growth, exchange, drain, biomass and transport aside."""
        best = self.optimum()
        names = [p for p in dict.fromkeys(r.pathway for r in self.reactions) if p not in NO_CAPACITY]
        return {p: self.capacity(p, fraction * best) if best > 1e-12 else 0.0 for p in names}

    def genes(self) -> list[str]:
        return sorted({g for r in self.reactions if r.rule for g in gpr.genes(r.rule)})


def toy_network() -> Network:
    """Two units of the fed substrate make one of the product, which drains."""
    return Network((Reaction("FEED", {"sub": 1.0}, high=1.0), Reaction("DIMER", {"sub": -2.0, "out": 1.0}, rule="G1"), Reaction("DRAIN", {"out": -1.0})), "DRAIN")


def network_from_frames(reactions: DataFrame, objective: str) -> Network:
    """From rows name, substrates, products (arrays, repetition counts), rule, pathway, low, high: a small catalogue."""
    found = []
    for r in reactions.orderBy("seq").collect():
        c: dict[str, float] = {}
        for names, sign in ((r["substrates"], -1.0), (r["products"], 1.0)):
            for n in names or ():
                c[n] = c.get(n, 0.0) + sign
        found.append(Reaction(r["name"], {k: v for k, v in c.items() if v}, r["rule"] or "", r["pathway"] or "", r["low"], r["high"]))
    return Network(tuple(found), objective)


def stoichiometry(reactions: DataFrame) -> DataFrame:
    """reaction, metabolite, coefficient (products less substrates, none 0)."""
    side = lambda c, s: reactions.select(F.col("name").alias("reaction"), F.explode(c).alias("metabolite"), F.lit(s).alias("n"))
    return side("substrates", -1.0).union(side("products", 1.0)).groupBy("reaction", "metabolite").agg(F.sum("n").alias("coefficient")).where("coefficient <> 0")


def imbalance(stoich: DataFrame, fluxes: DataFrame) -> DataFrame:
    """The greatest |S v| over the metabolites."""
    by = stoich.join(fluxes, "reaction").groupBy("metabolite").agg(F.sum(F.col("coefficient") * F.col("flux")).alias("net"))
    return by.agg(F.max(F.abs("net")).alias("residual"))


def _solved(spark: SparkSession, names: list[str], column: str, schema: str, solve) -> DataFrame:
    """A linear program a row, dealt over tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([solve(n) for n in pdf[column]], columns=[c.split()[0] for c in schema.split(", ")])

    rows = spark.createDataFrame([(n,) for n in names], f"{column} string")
    return rows.repartition(min(len(names), 2 * spark.sparkContext.defaultParallelism), column).mapInPandas(run, schema)


def variability(spark: SparkSession, network: Network, *, fraction: float = 1.0) -> DataFrame:
    """reaction, low, high at a fraction of the optimal growth; the optimum is solved once."""
    floor = fraction * network.optimum()
    return _solved(spark, [r.name for r in network.reactions], "reaction", "reaction string, low double, high double", lambda n: (n, network.optimum(n, maximise=False, floor=floor), network.optimum(n, floor=floor)))


def knockouts(spark: SparkSession, network: Network, threshold: float = 0.5) -> DataFrame:
    """gene, growth, ratio (share of growth lost), essential."""
    base = network.optimum()

    def solve(gene: str):
        grown = network.without(gene).optimum()
        lost = 1 - grown / base if base > 1e-12 else 0.0
        return gene, grown, lost, lost >= threshold

    return _solved(spark, network.genes(), "gene", "gene string, growth double, ratio double, essential boolean", solve)


def pathway_capacity(spark: SparkSession, network: Network, *, fraction: float = 1.0) -> DataFrame:
    """pathway, capacity: sums of |greatest flux| of a pathway's reactions at the growth floor."""
    of = {r.name: r.pathway for r in network.reactions}
    rows = variability(spark, network, fraction=fraction)
    names = spark.createDataFrame(list(of.items()), "reaction string, pathway string")
    return rows.join(names, "reaction").groupBy("pathway").agg(F.sum(F.abs("high")).alias("capacity"))


def sample_fluxes(network: Network, n: int, seed: int, fraction: float = 0.9, thin: int = 5) -> np.ndarray:
    """Hit-and-run samples of the flux space with growth at ``fraction`` of the optimum or more; n x reactions."""
    s, low, high = network.matrix()
    low = low.copy()
    low[network.index(network.objective)] = max(low[network.index(network.objective)], fraction * network.optimum())
    _, values, vt = np.linalg.svd(s)
    null = vt[(values > 1e-10).sum() :].T
    start = []
    for i in range(len(network.reactions)):
        for sign in (1.0, -1.0):
            c = np.zeros(len(low))
            c[i] = sign
            found = simplex.maximise(c, s, np.zeros(len(s)), low, high)
            if found is not None:
                start.append(found[1])
    x, rng, out = np.mean(start, axis=0), np.random.default_rng(seed), []
    for i in range(n * thin):
        d = null @ rng.normal(size=null.shape[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (low - x) / d, (high - x) / d
        ok = np.abs(d) > 1e-12
        lo, hi = np.minimum(a, b)[ok].max(initial=-np.inf), np.maximum(a, b)[ok].min(initial=np.inf)
        if np.isfinite(lo) and np.isfinite(hi) and hi > lo:
            x = x + d * rng.uniform(lo, hi)
        if i % thin == thin - 1:
            out.append(x)
    return np.array(out)


def utilisation(network: Network, pathway: str, *, fraction: float = 0.9) -> float:
    """What a pathway can carry at a fraction of optimal growth; 0 without reactions."""
    return network.capacity(pathway, fraction * network.optimum())


def feasible(stoich: DataFrame, fluxes: DataFrame, bounds: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """feasible, residual: fluxes (reaction, flux) within bounds (reaction, low, high) that balance every metabolite."""
    out = fluxes.join(bounds, "reaction").agg(F.count_if((F.col("flux") < F.col("low") - tolerance) | (F.col("flux") > F.col("high") + tolerance)).alias("out"))
    both = out.crossJoin(imbalance(stoich, fluxes))  # a row each
    return both.select(((F.col("out") == 0) & (F.col("residual") <= tolerance)).alias("feasible"), "residual")


def suppression(spark: SparkSession, network: Network, genes: list[str] | None = None, *, fraction: float = CAPACITY_FRACTION) -> DataFrame:
    """gene, growth_loss, capacity_loss, score: half the growth and half the worst pathway capacity that the loss of a
    gene costs. The network without loss is solved once; genes are dealt over tasks. No growth means no capacity. A gene
    that shuts no reaction has a NULL score."""
    base, before = network.optimum(), network.capacities(fraction)

    def solve(gene: str):
        if not network.has_rule(gene):
            return gene, None, None, None
        without = network.without(gene)
        grown = without.optimum()
        after = without.capacities(fraction) if grown > 1e-12 else {}
        growth = 1 - grown / base if base > 1e-12 else 0.0
        losses = [1 - after.get(p, 0.0) / c for p, c in before.items() if c > 1e-9]
        capacity = max(0.0, *losses) if losses else 0.0
        return gene, growth, capacity, 0.5 * growth + 0.5 * capacity

    return _solved(spark, genes or network.genes(), "gene", "gene string, growth_loss double, capacity_loss double, score double", solve)


def flux_scores(spark: SparkSession, network: Network, backup: Network | None = None, genes: list[str] | None = None, *, attenuation: float = 0.6) -> DataFrame:
    """gene, score in [0, 1] of the flux evidence: suppression in the primary network, blended with the attenuated score
    in a backup network where that has a rule for the gene; NULL where the primary has none."""
    first = suppression(spark, network, genes).select("gene", F.col("score").alias("a"))
    if backup is None:
        return first.select("gene", clip(F.col("a")).alias("score"))
    second = suppression(spark, backup, genes or network.genes()).select("gene", F.col("score").alias("b"))
    blend = F.when(F.col("b").isNotNull(), PRIMARY * F.col("a") + BACKUP * purity_attenuated(F.col("b"), attenuation)).otherwise(F.col("a"))
    return first.join(second, "gene").select("gene", clip(blend).alias("score"))


def dependency_rank(scores: DataFrame) -> DataFrame:
    """gene, score, rank: by score descending, gene ascending."""
    return ranked(scores.where("score is not null").select("gene", "score"), "score", "gene")


def synthetic_lethality(spark: SparkSession, network: Network, pairs: list[tuple[str, str]]) -> DataFrame:
    """first, second, loss: the growth that the second gene's loss costs on top of the first's, a pair a row."""
    base = network.optimum()

    def solve(pair: str):
        first, second = pair.split("|")
        if base <= 1e-12:
            return first, second, 1.0
        return first, second, (network.without(first).optimum() - network.without(first, second).optimum()) / base

    return _solved(spark, ["|".join(p) for p in pairs], "pair", "first string, second string, loss double", solve)


def reaction_frame(spark: SparkSession, network: Network) -> DataFrame:
    """seq, reaction, pathway, genes (of the rule, without markers), low, high."""
    rows = [(i, r.name, r.pathway, sorted(g for g in (gpr.genes(r.rule) if r.rule else ()) if g not in MARKERS), r.low, r.high) for i, r in enumerate(network.reactions)]
    return spark.createDataFrame(rows, "seq long, reaction string, pathway string, genes array<string>, low double, high double")


def reactions_of_genes(reactions: DataFrame) -> DataFrame:
    """gene, reactions (sorted)."""
    return reactions.select(F.explode("genes").alias("gene"), "reaction").groupBy("gene").agg(F.array_sort(F.collect_set("reaction")).alias("reactions"))


def alternative_uptake(reactions: DataFrame, gene: str) -> DataFrame:
    """gene: those of reactions that a gene's loss leaves open, exchange, drain and transport aside; none if it has none."""
    own = reactions.where(F.array_contains("genes", gene)).select("reaction")
    rest = reactions.where(~F.col("pathway").isin("exchange", "drain", "transport")).join(own, "reaction", "left_anti")
    return rest.select(F.explode("genes").alias("gene")).distinct().join(own.limit(1).select(F.lit(1)), how="left_semi")


def flux_samples(spark: SparkSession, network: Network, n: int, seeds: list[int], fraction: float = 0.9) -> DataFrame:
    """seed, sample, reaction, flux: a hit-and-run chain a seed, chains dealt over tasks."""
    names = [r.name for r in network.reactions]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf["seed"].iloc[0])
        x = sample_fluxes(network, n, seed, fraction)
        return pd.DataFrame({"seed": seed, "sample": np.repeat(np.arange(n), len(names)), "reaction": np.tile(names, n), "flux": x.reshape(-1)})

    return spark.createDataFrame([(s,) for s in seeds], "seed long").groupBy("seed").applyInPandas(run, "seed long, sample long, reaction string, flux double")


def flux_distribution(samples: DataFrame) -> DataFrame:
    """reaction, mean, sd (of the population), low, high."""
    return samples.groupBy("reaction").agg(F.avg("flux").alias("mean"), F.stddev_pop("flux").alias("sd"), F.min("flux").alias("low"), F.max("flux").alias("high"))


def range_narrowing(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """reaction, narrowing: 1 less the share of the wide samples' span that the narrow ones have, 0 at least."""
    span = lambda d, n: flux_distribution(d).select("reaction", (F.col("high") - F.col("low")).alias(n))
    both = span(wide, "w").join(span(narrow, "n"), "reaction")
    return both.select("reaction", F.when(F.col("w") <= 1e-12, 0.0).otherwise(F.greatest(1 - F.col("n") / F.nullif("w", F.lit(0.0)), F.lit(0.0))).alias("narrowing"))


def flux_shift(first: DataFrame, second: DataFrame, reactions: DataFrame) -> DataFrame:
    """pathway, shift: the mean distance of a pathway's mean fluxes in two sample sets."""
    mean = lambda d, n: d.groupBy("reaction").agg(F.avg("flux").alias(n))
    both = mean(first, "a").join(mean(second, "b"), "reaction").join(reactions.select("reaction", "pathway"), "reaction")
    return both.groupBy("pathway").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("shift"))
