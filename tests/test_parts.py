"""Small parts that queries do not reach: nodes and edges of a graph, evidence, schedules, bundles, sinks."""

import pytest
from pyspark.sql import functions as F

from beliefline.functions import columns as C
from beliefline.operators import calibration, fusion, graph, mass_map, metrics
from beliefline.sources import readers, sinks


def test_nodes_and_edges(spark):
    nodes = spark.createDataFrame([(0, "a", "gene"), (1, "b", "drug"), (2, "a", "drug"), (3, "b", "drug")], "seq long, key string, kind string")
    got = {r["key"]: (r["seq"], r["kind"], r["clash"]) for r in graph.dedup_nodes(nodes).collect()}
    assert got == {"a": (0, "gene", True), "b": (1, "drug", False)}
    edges = spark.createDataFrame([("a", "b", "x/1", 1), ("a", "z", "y/2", 2), ("q", "b", None, 3), ("q", "z", "x/3", 4)], "src string, dst string, evidence_ref string, seq long")
    assert sorted(r["seq"] for r in graph.missing_ends(edges, nodes.select("key").distinct()).collect()) == [2, 3, 4]
    assert sorted(r["seq"] for r in graph.without_reference(edges, "x/").collect()) == [2, 3] and graph.without_reference(edges, "").count() == 4
    assert [(r["seq"], r["place"]) for r in graph.first_seen(nodes, "key").orderBy("seq").collect()] == [(0, 1), (1, 1), (2, 2), (3, 2)]
    assert sorted(r["seq"] for r in readers.last_row(nodes, "key", "seq").collect()) == [2, 3]


def test_evidence_columns(spark):
    df = spark.createDataFrame([(0.5, "s", "1", "q", "2024-01-01"), (0.4, "s", "1", "q", None), (None, "s", "1", "q", None)], "score double, source string, version string, query string, date string")
    rows = df.select(C.supports(F.col("score")).alias("s"), C.query_string(*(F.col(c) for c in ("source", "version", "query", "date"))).alias("q")).collect()
    assert [r["s"] for r in rows] == [True, False, None] and rows[0]["q"] == "s|1|q|2024-01-01" and rows[1]["q"] == "s|1|q"
    one = df.limit(1).select(C.discount_floor(0.8).alias("f"), C.single_pignistic(F.lit(0.6), F.lit(0.5)).alias("p"), C.association_strength(F.lit(-0.3)).alias("a"), C.disagreement(F.lit(0.2), F.lit(0.9), F.lit(0.4)).alias("d")).first()
    assert list(one) == pytest.approx([0.2, 0.55, 0.5, 0.7])
    wide = spark.createDataFrame([("a", 0.9, None, 0.1, 0.5), ("b", 0.5, 0.4, None, None)], "candidate string, kg double, dep double, flux double, clin double")
    counts = {r["modality"]: (r["supporting"], r["opposing"], r["absent"]) for r in fusion.support_counts(wide).collect()}
    assert counts == {"KG": (2, 0, 0), "DEP": (0, 1, 1), "FLUX": (0, 1, 1), "CLIN": (1, 0, 1)}


def test_provenance(spark):
    audits = spark.createDataFrame([("a", 4, 3), ("b", 0, 0)], "candidate string, cited long, grounded long")
    entries = spark.createDataFrame([("a", 1.0, "x"), ("a", None, "x"), ("b", 2.0, None)], "candidate string, score double, source string")
    r = metrics.provenance_summary(audits, entries, ["candidate", "source"]).first()
    assert r.asDict() == {"candidates": 2, "cited": 4, "grounded": 3, "grounded_rate": 0.75, "hallucinated_rate": 0.25, "complete_entries": 2}
    assert metrics.provenance_summary(audits.limit(0), entries, ["candidate"]).first()["grounded_rate"] == 0.0
    assert metrics.entries_of(entries, "a").count() == 2


def test_schedules_and_folds(spark):
    o = mass_map.Optimiser(epochs=7, batch=4, schedule="linear")
    total = mass_map.total_steps(o, 10)
    assert [r["rate"] for r in mass_map.schedule_curve(spark, o, 10).orderBy("step").collect()] == pytest.approx([mass_map.rate_at(i, total, o) for i in range(total)])
    controls = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "symbol string, ordinal int")
    assert sorted((r["fold"], r["withheld"], r["member"]) for r in calibration.leave_one_out(controls).collect()) == [(0, "a", "b"), (0, "a", "c"), (1, "b", "a"), (1, "b", "c"), (2, "c", "a"), (2, "c", "b")]


def test_bundle_and_yaml(spark, tmp_path):
    nodes = spark.createDataFrame([("g", "gene"), ("h", "gene"), ("p", "phenotype")], "key string, kind string")
    edges = spark.createDataFrame([("g", "p", "2026-02-01"), ("h", "p", "2025-02-01"), ("g", "h", "2027-01-01")], "src string, dst string, release_date string")
    sinks.save_graph(nodes, edges, f"file://{tmp_path}/graph")
    found = sinks.load_bundle(spark, f"file://{tmp_path}/graph", phenotype="p", last="2026-01-01")
    assert {r[0] for r in found["pool"].collect()} == {"g", "h"} and [r[0] for r in found["held_out"].collect()] == ["g"]
    sinks.write_yaml(spark, f"file://{tmp_path}/x.yaml", {"b": 1, "a": [2]})
    assert readers.yaml(f"{tmp_path}/x.yaml") == {"b": 1, "a": [2]} if hasattr(readers, "yaml") else (tmp_path / "x.yaml").read_text() == "b: 1\na:\n- 2\n"
