"""Hand-computed values of the evidence algebra, rules, programs and statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beliefline.functions import columns as C
from beliefline.functions import gpr, simplex
from beliefline.operators import cohort, flux, fusion, graph, metrics, ordering, simulation, stats

RATES = {"KG": 0.86, "DEP": 0.91, "FLUX": 0.74, "CLIN": 0.66}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pair_rule_moves_conflict_to_ignorance(spark):
    m, k = C.pair(C.mass(0.5, 0.4, 0.1), C.mass(0.4, 0.5, 0.1))
    d, _ = C.dempster_pair(C.mass(0.5, 0.4, 0.1), C.mass(0.4, 0.5, 0.1))
    assert one(spark, k) == pytest.approx(0.41)
    assert one(spark, m["theta"]) == pytest.approx(0.42)
    assert one(spark, d["theta"]) == pytest.approx(0.01 / 0.59)


def test_fold_depends_on_order(spark):
    a, b, c = C.mass(0.6, 0.3, 0.1), C.mass(0.2, 0.7, 0.1), C.mass(0.5, 0.4, 0.1)
    x, y = (one(spark, C.fold(F.array(*ms))["m"]["v"]) for ms in ((a, b, c), (c, b, a)))
    assert x != pytest.approx(y)


def test_total_conflict_is_null_under_dempster(spark):
    assert one(spark, C.fold(F.array(C.certain(), C.denied()), C.dempster_pair)["m"]) is None


def test_absent_scores_are_vacuous(spark):
    m = one(spark, C.map_score(F.lit(None).cast("double"), 0.9))
    assert (m["v"], m["n"], m["theta"]) == (0, 0, 1)


def test_discount_round_trip(spark):
    m = one(spark, C.undiscount(C.discount(C.mass(0.42, 0.31, 0.27), 0.8), 0.8))
    assert tuple(m) == pytest.approx((0.42, 0.31, 0.27))
    assert one(spark, C.undiscount(C.mass(0.5, 0.5, 0.0), 0.8)) is None


def test_normal_ppf(spark):
    for p, z in ((0.975, 1.959963984540054), (0.5, 0.0), (0.001, -3.090232306167813)):
        assert one(spark, C.normal_ppf(F.lit(p))) == pytest.approx(z, abs=1e-7)


def test_reliability_order_breaks_ties_by_declaration():
    assert fusion.reliability_order({"KG": 1.0, "DEP": 1.0, "FLUX": 0.5, "CLIN": 1.0}) == ["KG", "DEP", "CLIN", "FLUX"]
    with pytest.raises(ValueError):
        fusion.reliability_order({"KG": 1.0})


def test_strict_dates(spark):
    rows = spark.createDataFrame([("2024-01-31",), ("2024-1-31",), ("2024",), ("2024-02-31",), (None,)], "d string")
    assert [r["x"] is not None for r in rows.select(C.strict_date(F.col("d")).alias("x")).collect()] == [True, False, False, False, False]


def test_ranks_and_midranks_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, 300)
    df = spark.createDataFrame([(f"c{i:03d}", float(v)) for i, v in enumerate(x)], "name string, v double")
    got = {r["name"]: r["midrank"] for r in ordering.midranks(df, "v").collect()}
    want = {f"c{i:03d}": float((x < v).sum() + ((x == v).sum() + 1) / 2) for i, v in enumerate(x)}
    assert got == want
    ranks = {r["name"]: r["rank"] for r in ordering.ranked(df, "v", "name").collect()}
    order = sorted(range(300), key=lambda i: (-x[i], f"c{i:03d}"))
    assert [ranks[f"c{i:03d}"] for i in order] == list(range(1, 301))


def test_ranking_toy(spark):
    df = spark.createDataFrame([("a", 0.9, True), ("b", 0.8, False), ("c", 0.7, False), ("d", 0.6, True), ("e", 0.5, False)], "candidate string, score double, vulnerable boolean")
    r = metrics.ranking_metrics(df, k=2).first()
    assert (r["recall_at_k"], r["average_precision"], r["mrr"]) == (0.5, 0.75, 1.0)


def test_calibration_toy(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "p double, y double")
    r = metrics.calibration_summary(df).first()
    assert (r["brier"], r["ece"]) == (0.25, 0.25)


def test_toy_graph(spark):
    edges = spark.createDataFrame([(i, s, d, "r", "2024-01-01", 1.0) for i, (s, d) in enumerate([("A", "P1"), ("P1", "PH"), ("B", "P1"), ("C", "P2"), ("P2", "PH")])], "seq int, src string, dst string, relation string, release_date string, weight double")
    sources = spark.createDataFrame([("A",), ("B",), ("C",), ("Z",)], "source string")
    paths = {tuple(r["nodes"]) for r in graph.simple_paths(edges, sources, "PH").collect()}
    assert paths == {("A", "P1", "PH"), ("B", "P1", "PH"), ("C", "P2", "PH")}
    assert graph.cutoff(edges, "2023-12-31").count() == 0
    nodes = spark.createDataFrame([("A", "gene", 0, [("hgnc", "a1")]), ("B", "gene", 1, [("alias", "X")])], "key string, kind string, seq int, identifiers array<struct<namespace: string, value: string>>")
    asked = spark.createDataFrame([("A",), ("x",), ("none",)], "query string")
    assert {r["query"]: r["key"] for r in graph.resolve(asked, nodes).collect()} == {"A": "A", "x": "B", "none": None}


def test_gene_rules():
    assert gpr.parse("A and (B or C)") == [frozenset("AB"), frozenset("AC")]
    assert gpr.requires("A and (B or C)", "A") and not gpr.requires("A or B", "A")
    assert not gpr.is_active("A and B", {"B"}) and gpr.is_active("A or B", {"B"})
    assert gpr.to_text("(A and B) or A") == "A"
    for bad in ("", "A and", "(A", "A)", "and A"):
        with pytest.raises(ValueError):
            gpr.parse(bad)


def test_linear_programs():
    net = flux.toy_network()
    assert net.optimum() == pytest.approx(0.5)
    assert net.with_medium({"FEED": 0.5}).optimum() == pytest.approx(0.25)
    assert net.without("G1").optimum() == 0.0
    assert simplex.maximise(np.array([1.0]), np.array([[1.0]]), np.array([5.0]), np.array([0.0]), np.array([1.0])) is None
    samples = flux.sample_fluxes(net, 20, seed=1)
    s, low, high = net.matrix()
    assert np.abs(samples @ s.T).max() < 1e-9 and (samples >= low - 1e-9).all() and (samples <= high + 1e-9).all()


def test_multiplicity(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.04)], "name string, p double")
    assert [r["adjusted"] for r in stats.holm(df).orderBy("p").collect()] == pytest.approx([0.03, 0.04, 0.04])
    assert [r["adjusted"] for r in stats.benjamini_hochberg(df).orderBy("p").collect()] == pytest.approx([0.03, 0.03, 0.04])


def test_cox_published_values(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 1), (5, 0, 0), (6, 1, 1)], "time int, event int, x int")
    f = stats.fit_cox(rows, "time", "event", ["x"])
    assert f["loglik"] == pytest.approx(-4.46068250, abs=1e-6)
    assert f["coefficients"][0] == pytest.approx(0.340144, abs=1e-5)


def test_cochran_published_values(spark):
    r = metrics.cochran_q(spark.createDataFrame([(0.70, 0.0025), (0.72, 0.0025), (0.69, 0.0025)], "effect double, variance double")).first()
    assert r["q"] == pytest.approx(0.18666667, abs=1e-6) and r["i2"] == 0


def test_hanley_mcneil(spark):
    assert one(spark, C.hanley_mcneil(F.lit(0.7), F.lit(150.0), F.lit(450.0))) == pytest.approx(0.0006852750, abs=1e-9)


def test_pool_is_reproducible_and_exact():
    a, b = simulation.draw_pool(5, 300, 0.3, 0.25), simulation.draw_pool(5, 300, 0.3, 0.25)
    assert a.equals(b) and a.vulnerable.sum() == 45


def test_ablation_published_values(spark):
    rates = {"KG": 1.0, "DEP": 1.0, "FLUX": 0.5533206584743218, "CLIN": 1.0}
    pool = spark.createDataFrame(simulation.draw_pool(1, 400, 0.3, 0.0))
    by = {r["label"]: r for r in fusion.ablation_scores(pool, rates).groupBy("label").agg(F.avg("width").alias("w"), F.avg("conflict").alias("c")).collect()}
    assert by["full"]["w"] == pytest.approx(0.326580, abs=1e-5)
    assert by["dempster"]["w"] == pytest.approx(0.005509, abs=1e-5)
    assert by["dempster"]["c"] == pytest.approx(0.965426, abs=1e-5)


def test_expectations(spark):
    rows = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, age int")
    assert [r["broken"] for r in cohort.expectations(rows, {"age": F.col("age") >= 0}).collect()] == [["age"]]


def test_point_biserial_of_a_constant(spark):
    rows = spark.createDataFrame([("g", 1.0, i % 2) for i in range(20)], "gene string, value double, label int")
    assert metrics.point_biserial(rows, "gene", "value", "label").first()["r"] == 0


def test_poisson_bootstrap_covers_the_mean(spark):
    rows = spark.range(500).select(F.lit("a").alias("g"), F.col("id"), (F.col("id") % 10).cast("double").alias("v"))
    r = stats.poisson_bootstrap(rows, ["g"], "v", "id").first()
    assert r["lower"] < 4.5 < r["upper"] and r["upper"] - r["lower"] < 1.5


def test_normal_cdf(spark):
    assert one(spark, stats.normal_cdf(F.lit(1.959963984540054))) == pytest.approx(0.975)
    assert math.isclose(stats.two_sided_p(1.959963984540054), 0.05, rel_tol=1e-9)


def test_published_network_values():
    from beliefline.sources.reference_data import control_scores, reduced_network

    net = reduced_network()
    best = net.optimum()
    assert best == pytest.approx(0.151899, abs=1e-6) and len(net.reactions) == 66
    for name, low, high in (("LDHA", 0.0, 0.600), ("MCT1_export", 0.0, 0.600), ("OXPHOS", 0.615, 0.682)):
        assert net.optimum(name, maximise=False, floor=0.9 * best) == pytest.approx(low, abs=1e-3)
        assert net.optimum(name, floor=0.9 * best) == pytest.approx(high, abs=1e-3)
    panel = control_scores()
    rows = panel[(panel.modality == "FLUX") & panel.calibration]
    a, b = rows.score - 0.5, 0.5 - rows.label
    assert -(a * b).sum() / (a * a).sum() == pytest.approx(0.5533206584743218, abs=1e-12)


def test_published_sizes(spark):
    assert {r["correlation"]: r["records"] for r in stats.sizing(spark).collect()} == {0.3: 632, 0.4: 542, 0.5: 454}
    assert [round(r["power"], 4) for r in stats.power_curve(spark, [200, 400, 600, 800]).orderBy("records").collect()] == [0.3973, 0.6723, 0.8385, 0.9258]


def test_schedules(spark):
    rows = spark.range(10).select(C.learning_rate(F.col("id"), 10, rate=1.0, warmup=0.2).alias("x")).collect()
    assert rows[0]["x"] == 0.5 and rows[1]["x"] == 1.0 and rows[2]["x"] == 1.0 and rows[9]["x"] == pytest.approx(0.5 * (1 + math.cos(math.pi * 7 / 8)))
