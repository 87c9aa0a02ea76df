"""The study's jobs: calibrate, discover, simulate, benchmark, ablate, size. Each takes a session and returns its result
tables; run() writes them as Parquet with a JSON and a text summary beside.

    python -m beliefline.plans.jobs discover --output /data/out --option hops=2
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchmark as bench
from ..operators import calibration, cohort, contrasts, discovery, flux, fusion, guarantees, mass_map, metrics, simulation, stats
from ..sources import generators as gen
from ..sources import readers, sinks
from ..sources import reference_data as data
from . import checks

#: The grid of the simulation, its two named cells, the reliability rates of the guarantees.
CONFLICTS, ABSENTS = (0.1, 0.3, 0.5), (0.0, 0.15, 0.3)
REFERENCE_CELLS = {"moderate_conflict": (0.3, 0.0), "absent_evidence": (0.3, 0.25)}
AUDIT_RATES = {"KG": 0.86, "DEP": 0.91, "FLUX": 0.74, "CLIN": 0.66}


def design(config: dict | None = None, **reduced) -> dict:
    """Options of a simulation: the configuration's grid and seeds, then what is reduced by hand; the rest is kept."""
    block = (config or {}).get("simulation", {})
    out = {"conflicts": tuple(block.get("conflicts", CONFLICTS)), "absents": tuple(block.get("absents", ABSENTS)), "seeds": tuple(range(1, int(block.get("seeds", 20)) + 1)), "candidates": int(block.get("candidates", 2000)), "k": int(block.get("cutoff", 10))}
    if reduced.get("seeds"):
        out["seeds"] = out["seeds"][: int(reduced["seeds"])]
    if reduced.get("candidates"):
        out["candidates"] = int(reduced["candidates"])
    return out


@dataclass
class Runtime:
    """What the jobs share, made once when it is first asked for."""

    spark: SparkSession

    @cached_property
    def network(self) -> flux.Network:
        return data.reduced_network()

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = gen.substrate(self.spark, self.network)
        return nodes.cache(), edges.cache()

    @cached_property
    def pool(self) -> DataFrame:
        return gen.candidate_pool(self.graph[0]).cache()

    @cached_property
    def panel(self) -> DataFrame:
        return data.control_panel(self.spark)

    @cached_property
    def controls(self) -> DataFrame:
        return self.panel.select("symbol", "ordinal", "label").distinct()

    @cached_property
    def rates(self) -> dict[str, float]:
        rows = self.panel.where("calibration").select("modality", "score", F.col("label").cast("double").alias("y"))
        return {r["modality"]: r["rate"] for r in calibration.fit_rates(rows, []).collect()}  # four rows

    @cached_property
    def records(self) -> DataFrame:
        return cohort.labelled(gen.cohort(self.spark)).cache()

    @cached_property
    def dependency(self) -> DataFrame:
        return gen.dependency_table(self.pool.select(F.col("candidate").alias("gene")))

    def sources(self, *, hops: int = 3) -> dict[str, Callable[[DataFrame], DataFrame]]:
        """The four agents by modality: each gives candidate, modality, score of the candidates it is asked for, all of them."""
        nodes, edges = self.graph

        def clinical(pool: DataFrame) -> DataFrame:
            values = gen.expression(self.spark, self.records, pool.select(F.col("candidate").alias("gene")))
            return discovery.association_evidence(pool, values, self.records.select("record_id", "label"))

        return {
            "KG": lambda pool: discovery.path_evidence(pool, edges, nodes.select("key", "kind"), gen.PHENOTYPE, hops=hops),
            "DEP": lambda pool: discovery.dependency_evidence(pool, self.dependency),
            "FLUX": lambda pool: discovery.capacity_evidence(pool, flux.flux_scores(self.spark, self.network)),
            "CLIN": clinical,
        }

    def evidence(self, pool: DataFrame, **options) -> DataFrame:
        return discovery.wide(*(agent(pool) for agent in self.sources(**options).values()))


def calibrate(spark: SparkSession, **options) -> dict[str, DataFrame]:
    """rates (pooled and by fold), the agreement of the closed form, the fitted mass map and its training."""
    run = Runtime(spark)
    rows = run.panel.where("calibration").select("symbol", "ordinal", "modality", "score", F.col("label").cast("double").alias("y"))
    fitted = mass_map.fit(run.panel, mass_map.Optimiser(epochs=int(options.get("epochs", 200))))
    before, after = ([k, *(float(fitted[k][c]) for c in ("brier", "ece"))] for k in ("before", "after"))
    model = fitted["model"]
    return {
        "rates": calibration.fit_folds(rows, "ordinal"), "agreement": mass_map.numeric_rates(rows), "stability": calibration.rate_stability(calibration.fit_folds(rows, "ordinal")),
        "mass_map": spark.createDataFrame([(m, *(float(p[i]) for p in model.parts())) for i, m in enumerate(fusion.SCORES)], "modality string, slope double, offset double, gate double"),
        "metrics": spark.createDataFrame([before, after], "state string, brier double, ece double"),
        "history": spark.createDataFrame([(h["step"], h["loss"], h["rate"]) for h in fitted["history"]], "step long, loss double, rate double"),
        "folds": bench.control_folds(run.controls), "fold_audit": bench.audit_folds(bench.control_folds(run.controls), run.controls),
    }


def discover(spark: SparkSession, **options) -> dict[str, DataFrame]:
    """The ranking of the pool by the four agents' evidence, its ledger and the audit of its citations."""
    run = Runtime(spark)
    pool = run.pool if not options.get("limit") else run.pool.orderBy("candidate").limit(int(options["limit"]))
    wide = run.evidence(pool, hops=int(options.get("hops", 3))).cache()
    reports = fusion.rank_reports(fusion.reports(wide, run.rates))
    ledger = sinks.ledger_rows(reports, fusion.long_masses(wide, run.rates), agent="verifier", source="study", version="1", recorded_at=options.get("recorded_at", "2026-01-01 00:00:00"))
    keyed = lambda df: df.select("candidate", F.concat_ws("|", "candidate", "modality").alias("key"))
    cited = keyed(ledger.where("evidence_score is not null"))
    return {"ranking": reports, "ledger": ledger, "violations": fusion.violations(reports), "grounding": metrics.grounding(metrics.audit_citations(cited, keyed(ledger)))}


def simulate(spark: SparkSession, **options) -> dict[str, DataFrame]:
    """Runs of the grid, contrasts of its cells and the verdicts on the hypotheses."""
    plan = design(options.get("config"), seeds=options.get("seeds"), candidates=options.get("candidates"))
    run = Runtime(spark)
    runs = simulation.run_design(spark, run.rates, **plan).cache()
    some = simulation.pools(spark, conflicts=(0.3,), absents=(0.0,), seeds=(1,), candidates=plan["candidates"]).cache()
    reports = fusion.reports(some, run.rates)
    verdicts = contrasts.hypothesis_report(runs, reports, some, run.rates)
    return {
        "runs": runs, "contrasts": contrasts.cell_contrasts(runs, resamples=int(options.get("bootstrap", 5000))), "means": contrasts.seed_means(runs), "verdicts": verdicts,
        "verdict_counts": contrasts.verdict_counts(verdicts), "reachability": contrasts.cutoff_reachability(spark, candidates=plan["candidates"], cutoff=plan["k"]),
        "guarantees": guarantees.summary(spark, AUDIT_RATES), "trace_r2": contrasts.trace_r2(reports), "single": contrasts.single_modality_recall(reports, k=plan["k"]),
    }


def benchmark(spark: SparkSession, **options) -> dict[str, DataFrame]:
    """The comparison operators on the pool, the report's table and the pool's audits."""
    run = Runtime(spark)
    nodes, edges = run.graph
    late = gen.held_out(edges)
    wide = run.evidence(run.pool, hops=int(options.get("hops", 3))).join(late.withColumn("vulnerable", F.lit(True)), "candidate", "left").withColumn("vulnerable", F.coalesce("vulnerable", F.lit(False)))
    rows = bench.registry(spark, data.operator_plan())
    scored = discovery.operator_scores(fusion.reports(wide, run.rates), data.operator_plan(), seed=int(options.get("seed", 1))).cache()
    executed = contrasts.recall_by(scored, "number", k=int(options.get("k", 10)))
    pool = bench.assemble(nodes, edges, run.pool, late, run.controls, phenotype=gen.PHENOTYPE, last=gen.CUTOFF, reference="positive control study")
    return {"operators": scored, "table": bench.table_rows(rows, executed), "families": bench.family_counts(rows), "valid": bench.validate(rows), "bindings": bench.bindings(rows, scored), **{f"pool_{k}": v for k, v in pool.items()}}


def ablate(spark: SparkSession, **options) -> dict[str, DataFrame]:
    """The battery over one simulated pool: means and recall of each cell."""
    pool = simulation.pools(spark, conflicts=(float(options.get("conflict", 0.3)),), absents=(float(options.get("absent", 0.0)),), seeds=(int(options.get("seed", 1)),), candidates=int(options.get("candidates", 2000))).cache()
    return {"battery": fusion.evaluate_battery(pool, Runtime(spark).rates, k=int(options.get("k", 10))), "plan": spark.createDataFrame([p[:4] for p in fusion.battery_plan()], "label string, level string, rule string, removed string")}


def size(spark: SparkSession, **options) -> dict[str, DataFrame]:
    """The least records that detect the margin, what accrual covers of them, and the power at some sizes."""
    minima = stats.sizing(spark, baseline=float(options.get("baseline", 0.70)), margin=float(options.get("margin", 0.081)), prevalence=float(options.get("prevalence", 0.25)))
    return {"minima": minima, "covered": stats.accrual_covers(minima), "power": stats.power_curve(spark, [200, 400, 600, 800])}


JOBS: dict[str, Callable[..., dict[str, DataFrame]]] = {"calibrate": calibrate, "discover": discover, "simulate": simulate, "benchmark": benchmark, "ablate": ablate, "size": size}


#: Tables that may have no rows.
MAY_BE_EMPTY = ("violations",)


def run(spark: SparkSession, job: str, output: str, **options) -> dict:
    """Runs a job, writes its tables under output with the checks that they met on their way, and a summary of their sizes,
    which it returns."""
    recorder = checks.Recorder(spark, job)
    for name, table in JOBS[job](spark, **options).items():
        recorder.watched(name, table).write.mode("overwrite").parquet(f"{output}/{name}")
    found = recorder.counts()
    recorder.rows().where(~(F.col("table").isin(*MAY_BE_EMPTY) & (F.col("check") == "has_rows"))).write.mode("overwrite").parquet(f"{output}/checks")
    sinks.write_json(spark, f"{output}/summary.json", {"job": job, "options": options, "rows": found})
    sinks.write_report(spark, f"{output}/summary.txt", job, {"options": options, "rows": found})
    return found


def run_all(spark: SparkSession, output: str, options: dict[str, dict] | None = None) -> DataFrame:
    """Every job, each in a folder of its own, and the checks of all."""
    for job in JOBS:
        run(spark, job, f"{output}/{job}", **(options or {}).get(job, {}))
    return spark.read.parquet(*(f"{output}/{job}/checks" for job in JOBS))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=[*sorted(JOBS), "all"])
    p.add_argument("--output", required=True)
    p.add_argument("--config", help="folder of experiment files")
    p.add_argument("--experiment", default="main")
    p.add_argument("--option", action="append", default=[], help="name=value")
    a = p.parse_args(args)
    options = {k: v for k, v in readers.overridden({}, a.option).items()}
    if a.config:
        options["config"] = readers.experiment(a.config, a.experiment)
    spark = SparkSession.builder.appName(a.job).getOrCreate()
    if a.job == "all":
        run_all(spark, a.output, {job: options for job in JOBS}).orderBy("job", "table", "check").show(1000, truncate=False)
    else:
        run(spark, a.job, a.output, **options)


if __name__ == "__main__":
    main()
