"""The benchmark's pool, its temporal folds and control folds, and the table of comparison operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph

#: Rows that are rebuilt and rows that only stand in the original benchmark, folds of the pool.
ROWS, ORIGINAL, FOLDS = 37, 2, 5
FAMILIES = ("multi_agent", "graph_embedding", "retrieval", "mechanistic", "single_llm", "transcriptomic", "fusion_control")


def registry(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    """number, family, modalities, aggregation, noise, calibrated, hops, rebuilt: the plan of operators as rows."""
    return spark.createDataFrame([(*p, p[0] <= ROWS) for p in plan], "number int, family string, modalities array<string>, aggregation string, noise double, calibrated boolean, hops int, rebuilt boolean")


def of_family(rows: DataFrame, family: str) -> DataFrame:
    return rows.where(F.col("family") == family)


def research_rows(rows: DataFrame) -> DataFrame:
    return rows.where("rebuilt")


def original_rows(rows: DataFrame) -> DataFrame:
    return rows.where("not rebuilt")


def operator_of(rows: DataFrame, number: int):
    """The one operator of a number; none or several are an error."""
    found = rows.where(F.col("number") == number).limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{len(found)} operators have number {number}")
    return found[0]


def family_counts(rows: DataFrame) -> DataFrame:
    """family, n with zeros."""
    dims = rows.sparkSession.createDataFrame([(f,) for f in FAMILIES], "family string")
    return dims.join(rows.groupBy("family").agg(F.count("*").alias("n")), "family", "left").select("family", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def validate(rows: DataFrame) -> DataFrame:
    """rows, rebuilt, original, distinct, valid."""
    out = rows.agg(F.count("*").alias("rows"), F.count_if("rebuilt").alias("rebuilt"), F.count_if(~F.col("rebuilt")).alias("original"), F.countDistinct("number").alias("distinct"))
    return out.withColumn("valid", (F.col("rebuilt") == ROWS) & (F.col("original") == ORIGINAL) & (F.col("distinct") == F.col("rows")))


def bindings(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """number, side: operators without scores (missing) and scores without an operator (extra); none if they agree."""
    a, b = rows.select("number"), scored.select("number").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a.distinct()).withColumn("side", F.lit("extra")))


def temporal_folds(pool: DataFrame, held_out: DataFrame, edges: DataFrame, phenotype: str, folds: int = FOLDS) -> DataFrame:
    """fold, cutoff, candidate, withheld: even folds withhold what was released late, odd ones the rest; a fold's cutoff
    is a release date of the phenotype's edges, in turn. A row a fold and candidate."""
    dates = sorted(r[0] for r in edges.where(F.col("dst") == phenotype).select("release_date").distinct().collect())  # release dates
    if folds < 2 or len(dates) < 2:
        raise ValueError("two folds and two release dates are needed")
    dims = edges.sparkSession.createDataFrame([(i, dates[i % len(dates)]) for i in range(folds)], "fold int, cutoff string")
    late = pool.join(held_out.select("candidate").distinct().withColumn("late", F.lit(True)), "candidate", "left").select("candidate", F.coalesce("late", F.lit(False)).alias("late"))
    return late.crossJoin(F.broadcast(dims)).select("fold", "cutoff", "candidate", (F.col("late") == (F.col("fold") % 2 == 0)).alias("withheld"))  # a few folds


def pool_summary(nodes: DataFrame, edges: DataFrame, pool: DataFrame, held_out: DataFrame) -> DataFrame:
    """candidates, nodes, edges, metabolic, held_out as one row."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    out = one(pool, "candidates")
    for df, n in ((nodes, "nodes"), (edges, "edges"), (held_out, "held_out")):
        out = out.crossJoin(one(df, n))
    return out.crossJoin(graph.metabolic_edges(edges).withColumnRenamed("n", "metabolic"))


def assemble(nodes: DataFrame, edges: DataFrame, pool: DataFrame, held_out: DataFrame, controls: DataFrame, *, phenotype: str, last: str, reference: str, folds: int = FOLDS) -> dict[str, DataFrame]:
    """The pool with controls (symbol, label), folds and the audit of all positive controls; a control that is not in the
    pool is an error."""
    gone = controls.join(pool, controls["symbol"] == pool["candidate"], "left_anti").select("symbol").limit(1).collect()
    if gone:
        raise ValueError(f"control {gone[0][0]} is not in the pool")
    pairs = positives(controls).select(F.col("symbol").alias("candidate"), F.lit(phenotype).alias("phenotype"))
    return {
        "candidates": pool, "positives": positives(controls), "negatives": negatives(controls), "folds": temporal_folds(pool, held_out, edges, phenotype, folds),
        "leakage": graph.leakage_audit(edges, pairs, last=last, reference=reference), "summary": pool_summary(nodes, edges, pool, held_out),
    }


def positives(controls: DataFrame) -> DataFrame:
    return controls.where("label = 1")


def negatives(controls: DataFrame) -> DataFrame:
    return controls.where("label <> 1")


def control_folds(controls: DataFrame) -> DataFrame:
    """fold, withheld, member, label: fold i withholds control i (a handful of controls)."""
    one = controls.select(F.col("ordinal").alias("fold"), F.col("symbol").alias("withheld"))
    return one.join(controls.select(F.col("symbol").alias("member"), "label"), F.col("withheld") != F.col("member"))


def fold_of(folds: DataFrame, symbol: str) -> DataFrame:
    return folds.where(F.col("withheld") == symbol)


def withheld_positives(folds: DataFrame, controls: DataFrame) -> DataFrame:
    """symbol of the positive controls that some fold withholds."""
    return positives(controls).select("symbol").join(folds.select(F.col("withheld").alias("symbol")), "symbol", "left_semi")


def audit_folds(folds: DataFrame, controls: DataFrame) -> DataFrame:
    """folds, withheld_once, members_complete: whether each control is withheld by one fold and present in all others."""
    by = folds.groupBy("fold").agg(F.countDistinct("member").alias("members"), F.countDistinct("withheld").alias("withheld"))
    n = controls.agg(F.countDistinct("symbol").alias("n"))
    out = by.crossJoin(n).agg(F.count("*").alias("folds"), (F.max("withheld") == 1).alias("withheld_once"), (F.min("members") == F.max("n") - 1).alias("members_complete"), F.max("n").alias("controls"))
    return out.withColumn("complete", F.col("folds") == F.col("controls"))


def table_rows(rows: DataFrame, executed: DataFrame | None = None) -> DataFrame:
    """number, family, metric columns of the executed operators, executed: the report's table; rows without a run are
    pending (NULL)."""
    if executed is None:
        return rows.select("number", "family", F.lit(None).cast("double").alias("recall"), F.lit(False).alias("executed"))
    return rows.select("number", "family").join(executed, "number", "left").withColumn("executed", F.col("recall").isNotNull())
