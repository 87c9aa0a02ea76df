"""Queries of the library's own operators over the warehouse tables, each with an independent SQL statement.

Outputs are rounded to six digits on both sides, so that the order of a sum does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import calibration, cohort, flux, fusion, graph, metrics, ordering, simulation, stats
from ..operators import discovery as operators_of
from ..sources import reference_data as data
from . import oracles as O
from .fixtures import view

RATES = O.RATES
_FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(F.col(c) + 0.0, digits) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reports(view(spark, sf_dir, "scores"), RATES)


@query(O.BELIEF_RANK)
def belief_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.rank_reports(tidy(_reports(spark, sf_dir).select("candidate", "bel", "pl", "betp", "width", "total_conflict")))
    return rows


@query(O.MASS_MAP)
def mass_map_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.long_masses(view(spark, sf_dir, "scores"), RATES)
    return tidy(rows.select("candidate", "modality", "score", F.col("mass.v").alias("v"), F.col("mass.theta").alias("theta"), F.col("discounted.v").alias("dv"), F.col("discounted.n").alias("dn"), F.col("discounted.theta").alias("dtheta"), "betp", "available"))


@query(O.UNDISCOUNT)
def undiscount_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.long_masses(view(spark, sf_dir, "scores"), RATES).withColumn("back", C.undiscount(F.col("discounted"), F.col("rate")))
    return tidy(rows.select("candidate", "modality", F.col("back.v").alias("v"), F.col("back.n").alias("n"), F.col("back.theta").alias("theta"), C.is_simplex(F.col("back")).alias("valid"), C.is_vacuous(F.col("back")).alias("vacuous")))


@query(O.PAIR)
def pair_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scores").select(F.col("candidate").alias("id"), fusion.mass_of("DEP", RATES).alias("a"), fusion.mass_of("KG", RATES).alias("b"))
    return tidy(fusion.enumerated_pair(rows))


@query(O.ALTERNATIVES)
def alternative_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fusion.alternatives(view(spark, sf_dir, "scores"), RATES))


@query(O.TRACE)
def conflict_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fusion.trace_summary(_reports(spark, sf_dir)))


@query(O.TRACE_ROWS)
def conflict_trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fusion.trace_rows(_reports(spark, sf_dir)).select("candidate", F.col("step").cast("long").alias("step"), "pair", "k_mass"))


@query(O.VIOLATIONS)
def report_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.violations(_reports(spark, sf_dir)).agg(F.count("*").alias("violations"))


@query(O.ABLATION)
def ablation_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fusion.ablation_scores(view(spark, sf_dir, "scores"), RATES)
    return tidy(cells.groupBy("label").agg(F.avg("score").alias("mean_score"), F.avg("width").alias("mean_width"), F.avg("conflict").alias("mean_conflict"), F.count("*").alias("n")))


@query(O.OPERATORS)
def operator_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.long_masses(view(spark, sf_dir, "scores"), RATES)
    wide = rows.groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "betp"))), lambda s: s["betp"]).alias("xs"))  # four values
    return tidy(wide.select("candidate", *(c.alias(n) for n, c in metrics.row_aggregates(F.col("xs")).items())))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_reports(spark, sf_dir).select("candidate", F.col("betp").alias("score"), "vulnerable", "width"))


@query(O.RANKING)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.ranking_metrics(_scored(spark, sf_dir), k=50))


@query(O.RECALL_CURVE)
def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.recall_curve(_scored(spark, sf_dir), [10, 45, 100, 500]))


@query(O.TOP)
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_k(_scored(spark, sf_dir), 25)


@query(O.BEST)
def best_single_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = view(spark, sf_dir, "scores")
    long = fusion.long_masses(scores, RATES).join(scores.select("candidate", "vulnerable"), "candidate")
    return tidy(metrics.best_single(tidy(long.select("candidate", "modality", "ordinal", "betp", "vulnerable")), k=100))


@query(O.SEPARABILITY)
def width_separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.concordance_labels(_reports(spark, sf_dir), 0.45, digits=6)
    rows = tidy(rows.select("candidate", (-F.col("width")).alias("w"), "concordant"))
    return tidy(metrics.auroc(rows, "w", "concordant"))


@query(O.MIDRANK)
def midranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.midranks(view(spark, sf_dir, "scores").select("candidate", "kg"), "kg")


@query(O.SCALED)
def scaled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(calibration.scaled(view(spark, sf_dir, "scores").select("candidate", "kg"), "kg", temperature=0.5))


@query(O.RATES_SQL)
def rate_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = view(spark, sf_dir, "scores")
    return tidy(calibration.fit_rates(calibration.long_scores(scores), []))


@query(O.FOLDS)
def calibration_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = view(spark, sf_dir, "scores")
    long = calibration.long_scores(scores).withColumn("part", (F.col("candidate") % 5).cast("int"))
    return tidy(calibration.fit_folds(long, "part"))


@query(O.CENSUS)
def cohort_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(cohort.census(view(spark, sf_dir, "records")))


@query(O.EXCLUSIONS)
def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "records").select("record_id", cohort.exclusion().alias("exclusion"), F.col("pcr").cast("int").alias("label"))


@query(O.ASSOCIATION)
def clinical_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = cohort.labelled(view(spark, sf_dir, "records")).select("record_id", "label")
    rows = view(spark, sf_dir, "expression").join(labels, "record_id")
    return tidy(metrics.point_biserial(rows, "gene", "value", "label"))


@query(O.GRAPH_CENSUS)
def graph_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.census(view(spark, sf_dir, "edges"))


@query(O.CUTOFF)
def cutoff_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges")
    kept = graph.cutoff(edges, "2024-06-30").groupBy("source_db").agg(F.count("*").alias("kept"))
    return edges.groupBy("source_db").agg(F.count("*").alias("all")).join(kept, "source_db", "left").select("source_db", "all", F.coalesce("kept", F.lit(0)).alias("kept"))


@query(O.DEDUP)
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges")
    twice = edges.unionByName(edges.withColumn("seq", F.concat("seq", F.lit(">"))))
    return graph.dedup_edges(twice).select("src", "dst", "relation", "seq")


@query(O.HOLDOUT)
def edge_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges")
    return graph.holdout(edges, "N:2", "R:2").groupBy("relation").agg(F.count("*").alias("n"))


@query(O.INDUCED)
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges")
    keep = edges.where("relation = 'reaction_enzyme' and weight > 0.95").select(F.explode(F.array("src", "dst")).alias("key"))
    return graph.induced(edges, keep).select("src", "dst", "relation")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("P:"), "p_partkey").alias("source"))


@query(O.BFS)
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs_depth(view(spark, sf_dir, "edges"), _sources(spark, sf_dir), 3)


@query(O.PATHS)
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.simple_paths(view(spark, sf_dir, "edges"), _sources(spark, sf_dir), "R:2", 3)
    return paths.select("source", "hops", F.concat_ws(">", "nodes").alias("path"), F.concat_ws(">", "relations").alias("relations"))


@query(O.SUPPORT)
def path_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges")
    kinds = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct().withColumn("kind", F.when(F.col("key").startswith("T:"), "pathway").otherwise("other"))
    return tidy(graph.path_support(graph.simple_paths(edges, _sources(spark, sf_dir), "R:2", 3), kinds))


@query(O.PATHWAY)
def pathway_of_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pathway_of(view(spark, sf_dir, "edges"))


@query(O.CALIBRATION)
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.calibration_summary(view(spark, sf_dir, "predictions")))


@query(O.RELIABILITY)
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.reliability_curve(view(spark, sf_dir, "predictions")))


@query(O.COCHRAN)
def cochran_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = view(spark, sf_dir, "predictions").groupBy("grp").agg(F.avg("y").alias("effect"), (F.var_samp("y") / F.count("*")).alias("variance")).where("variance > 0")
    return tidy(metrics.cochran_q(by), 5)


@query(O.ROC)
def roc_auc_delong(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "predictions").select("p", (F.col("y") > 0).alias("label"))
    return tidy(stats.roc_estimate(rows, "p", "label"), 9)


@query(O.PAIRED_ROC)
def paired_delong(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scores").select("candidate", "vulnerable", "kg", "dep")
    return tidy(stats.paired_roc(rows, "kg", "dep", "vulnerable", "candidate").drop("p"))


_P = [(f"t{i}", p) for i, p in enumerate((0.001, 0.01, 0.02, 0.2, 0.5, 0.04, 0.049))]


@query(O.HOLM)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.holm(spark.createDataFrame(_P, "name string, p double")))


@query(O.BH)
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.benjamini_hochberg(spark.createDataFrame(_P, "name string, p double")))


@query(O.CONCORDANCE)
def concordance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "survival").withColumn("event", (F.col("event_type") == 1).cast("int")).withColumn("risk", F.col("user_id") % 7)
    return tidy(stats.concordance_index(rows, "time", "event", "risk"))


@query(O.INCIDENCE)
def cumulative_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "survival")
    return tidy(stats.cumulative_incidence(rows, "time", "event_type").withColumn("time", F.col("time").cast("long")))


@query(O.COX)
def cox_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "survival").select("time", "stratum", (F.col("event_type") == 1).cast("int").alias("event"), ((F.col("user_id") % 5).cast("double") / 5).alias("x"))
    return tidy(stats.cox_terms(rows, "time", "event", ["x"], [0.3], "stratum"))


@query(O.COX_FIT)
def cox_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "survival").select("time", "stratum", "event_type", ((F.col("user_id") % 5).cast("double") / 5).alias("x"))
    fits = stats.competing_risks(rows, "time", "event_type", ["x"], stratum="stratum")
    return tidy(spark.createDataFrame([(n, f["coefficients"][0], f["errors"][0], f["loglik"]) for n, f in fits.items()], "cause string, coefficient double, error double, loglik double"))


@query(O.GEE_FIT)
def gee_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "readers").select("reader", "agree", F.lit(1.0).alias("one"), F.col("arm").cast("double").alias("arm"))
    f = stats.fit_gee(rows, "agree", ["one", "arm"], "reader")
    return tidy(spark.createDataFrame([(n, c, e, f["correlation"]) for n, c, e in zip(("intercept", "arm"), f["coefficients"], f["errors"], strict=True)], "name string, coefficient double, error double, correlation double"))


@query(O.KAPPA)
def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.cohens_kappa(view(spark, sf_dir, "readers"), "arm", "agree"))


@query(O.CLUSTERS)
def gee_cluster_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "readers").withColumn("r", F.col("agree") - 0.5)
    return tidy(stats.cluster_pair_sums(rows, "reader", "r"))


@query(O.GROUNDING)
def ledger_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "citations")
    return tidy(metrics.grounding(metrics.audit_citations(rows.select("candidate", "key"), rows.where("in_ledger").select("key"))))


@query(O.AUDIT)
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "citations")
    return metrics.audit_citations(rows.select("candidate", "key"), rows.where("in_ledger").select("key"))


@query(O.COMPLETENESS)
def ledger_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "citations").select("key", "candidate", F.when(F.col("in_ledger"), F.col("value")).alias("value"), "event_type")
    return metrics.null_fields(rows, ["key", "candidate", "value", "event_type"])


@query(O.LATEST)
def ledger_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "citations").select(F.concat_ws("|", F.col("candidate").cast("string"), "event_type").alias("key"), "value", "event_id")
    return tidy(metrics.latest_by_key(rows, "key", "event_id").select("key", F.col("event_id").alias("event_id"), "value"))


@query(O.CONTRASTS)
def cell_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(simulation.level_contrasts(_runs(spark, sf_dir), "level", "value"), 4)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("level"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("value"))


@query(None)
def seed_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.bootstrap_mean(_runs(spark, sf_dir), ["level"], "value", resamples=500, seed=17), 4)


@query(O.SIZING)
def sizing_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sizing(spark)


@query(O.SEEDS)
def text_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return names.select("n_name", C.seed_from_text(F.col("n_name")).alias("seed"), C.citation_key(F.col("n_name"), F.lit("agent"), F.col("n_regionkey").cast("string")).alias("key"))


@query(None)
def simulated_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(simulation.run_design(spark, RATES, conflicts=(0.1, 0.5), absents=(0.0, 0.3), seeds=(1, 2), candidates=200))


@query(None)
def flux_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(flux.variability(spark, data.reduced_network(), fraction=0.9))


@query(None)
def knockout_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(flux.knockouts(spark, data.reduced_network()))


@query(None)
def pathway_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(flux.pathway_capacity(spark, data.reduced_network()))


@query(None)
def panel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.control_panel(spark).where("calibration").withColumn("y", F.col("label").cast("double"))
    return tidy(calibration.fit_folds(rows, "ordinal"))


@query(O.DISCOVERY)
def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges")
    candidates = _sources(spark, sf_dir).withColumnRenamed("source", "candidate")
    kinds = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct().withColumn("kind", F.when(F.col("key").startswith("T:"), "pathway").otherwise("other"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    table = lines.groupBy(F.concat(F.lit("P:"), F.col("l_partkey")).alias("gene")).agg((-F.avg("l_quantity") / 50).alias("effect"), F.when(F.count("*") >= 28, -F.avg(F.col("l_discount") + 0.0) * 10).alias("response"))
    scores = lines.groupBy(F.concat(F.lit("P:"), F.col("l_partkey")).alias("gene")).agg(F.avg(F.col("l_tax") + 0.0).alias("t")).select("gene", (F.col("t") * 10).alias("score"))
    rows = operators_of.discover(candidates, RATES, operators_of.path_evidence(candidates, edges, kinds, "R:2"), operators_of.dependency_evidence(candidates, table), operators_of.capacity_evidence(candidates, scores))
    return tidy(rows.select("candidate", "kg", "dep", "flux", "betp", "width", "total_conflict"))


@query(None)
def benchmark_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operators_of.operator_scores(_reports(spark, sf_dir), data.operator_plan())
    ranked = rows.groupBy("number", "family").agg(F.avg("score").alias("mean_score"), F.avg(F.when(F.col("vulnerable"), F.col("score"))).alias("mean_positive"), F.count("*").alias("n"))
    return tidy(ranked)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import study  # noqa: F401  it adds its queries

    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {n: s for n, (_, s) in _FOUND.items() if s}
