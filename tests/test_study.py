"""Guarantees, generators, the mass map, pools, networks, sinks and jobs against published values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beliefline.operators import benchmark, contrasts, flux, guarantees, mass_map, stats
from beliefline.operators import graph as graphs
from beliefline.plans import jobs
from beliefline.sources import generators, readers, sinks
from beliefline.sources import reference_data as data

RATES = jobs.AUDIT_RATES


def test_width_grows_from_its_published_start_to_its_end(spark):
    r = guarantees.monotonicity_detail(guarantees.monotonicity_scan(spark, RATES)).first()
    assert (round(r["first_width"], 6), round(r["last_width"], 6), round(r["last_conflict"], 6), r["worst"]) == (0.333256, 0.511371, 1.214178, 0.0)
    assert round(guarantees.bias_floor(RATES), 10) == 0.0005569200
    assert [x["holds"] for x in guarantees.summary(spark, RATES).collect()] == [True] * 3
    assert guarantees.zero_conflict_limit(RATES, target=False)[0] == guarantees.bias_floor(RATES)


@pytest.fixture(scope="module")
def reference(spark):
    nodes, edges = generators.substrate(spark)
    return nodes.cache(), edges.cache()


def test_reference_graph_and_pool(spark, reference):
    nodes, edges = reference
    controls = data.control_panel(spark).select("symbol", "ordinal", "label").distinct()
    pool, late = generators.candidate_pool(nodes), generators.held_out(edges)
    made = benchmark.assemble(nodes, edges, pool, late, controls, phenotype=generators.PHENOTYPE, last=generators.CUTOFF, reference="positive control study")
    assert made["summary"].first().asDict() == {"candidates": 132, "nodes": 280, "edges": 822, "held_out": 15, "metabolic": 388}
    assert {r["control"]: r["removed"] for r in made["leakage"].collect()} == {"cutoff": 21, "reference": 2, "holdout": 2}
    withheld = {(r["fold"], r["withheld"]): r["count"] for r in made["folds"].groupBy("fold", "withheld").count().collect()}
    assert all(withheld[i, True] + withheld[i, False] == 132 and withheld[i, True] == (15 if i % 2 == 0 else 117) for i in range(5))
    with pytest.raises(ValueError):
        benchmark.assemble(nodes, edges, pool.where("candidate <> 'CES1'"), late, controls, phenotype=generators.PHENOTYPE, last=generators.CUTOFF, reference="")
    two = graphs.simple_paths(graphs.holdout(edges, "SLC2A1", generators.PHENOTYPE), spark.createDataFrame([("SLC2A1",)], "source string"), generators.PHENOTYPE, 3)
    assert two.count() == 2
    cited = graphs.citations(two, edges)
    assert cited.count() == 4 and graphs.has_edge(spark.createDataFrame([("SLC2A1", "transport"), ("CES1", "nowhere")], "src string, dst string"), edges).count() == 1
    some = graphs.accepted(edges, relations=["gene_pathway_membership"], nodes=nodes, kinds=["pathway"], last="2024-01-01")
    assert {r["release_date"] for r in some.select("release_date").distinct().collect()} == {"2023-06-30"}
    assert graphs.enzyme_partners(edges, spark.createDataFrame([("OXPHOS",)], "reaction string")).count() == 3


def test_control_folds(spark):
    controls = data.control_panel(spark).select("symbol", "ordinal", "label").distinct()
    folds = benchmark.control_folds(controls)
    assert benchmark.audit_folds(folds, controls).first()["complete"]
    assert {r[0] for r in benchmark.withheld_positives(folds, controls).collect()} == {"SLC2A1", "SLC16A1"}
    assert benchmark.fold_of(folds, "CES1").count() == 4 and benchmark.negatives(controls).count() == 3


def test_registry(spark):
    rows = benchmark.registry(spark, data.operator_plan())
    assert benchmark.validate(rows).first()["valid"] and benchmark.original_rows(rows).count() == 2 and benchmark.research_rows(rows).count() == 37
    counts = {r["family"]: r["n"] for r in benchmark.family_counts(rows.where("family <> 'retrieval'")).collect()}
    assert counts["retrieval"] == 0 and counts["mechanistic"] == benchmark.of_family(rows, "mechanistic").count() == 7
    with pytest.raises(KeyError):
        benchmark.operator_of(rows, 99)
    assert {(r["number"], r["side"]) for r in benchmark.bindings(rows.where("number > 1"), rows.where("number < 39")).collect()} == {(39, "missing"), (1, "extra")}
    table = benchmark.table_rows(rows, spark.createDataFrame([(1, 0.5)], "number int, recall double"))
    assert table.where("executed").count() == 1 and benchmark.table_rows(rows).where("not executed").count() == 39


def test_mass_map_reaches_the_published_loss(spark, tmp_path):
    found = mass_map.fit(data.control_panel(spark))
    assert round(found["before"]["brier"], 6) == 0.121473 and round(found["after"]["brier"], 6) == 0.094648
    model, rng = mass_map.MassMap(), np.random.default_rng(3)
    batch = rng.random((5, 4)), rng.integers(0, 2, (5, 1)).astype(float), rng.random((5, 4)) < 0.8
    for part, g in zip(model.parts(), mass_map.gradients(model, *batch), strict=True):  # against differences
        for i in range(4):
            part[i] += 1e-6
            high = mass_map.loss(model, *batch)
            part[i] -= 2e-6
            low = mass_map.loss(model, *batch)
            part[i] += 1e-6
            assert abs((high - low) / 2e-6 - g[i]) < 1e-7
    assert mass_map.loss(model, batch[0], batch[1], np.zeros((5, 4), bool)) == 0.0
    averaged, history = mass_map.train(list(mass_map.batches(*batch, 2)), mass_map.Optimiser(epochs=3, accumulate=2, ema=0.5, schedule="linear"))
    assert len(history) == 9 and math.isfinite(mass_map.mean_loss(averaged, [batch]))
    with pytest.raises(ValueError):
        mass_map.Optimiser(schedule="steps")
    path = f"file://{tmp_path}/map.json"
    sinks.save_checkpoint(spark, path, {"slope": found["model"].slope}, seed=9, step=200, config={})
    assert np.allclose(sinks.load_checkpoint(spark, path)["parameters"]["slope"], found["model"].slope)
    sinks.write_atomic(spark, path, sinks.read_text(spark, path).replace('"sha256": "', '"sha256": "0'))
    with pytest.raises(ValueError):
        sinks.load_checkpoint(spark, path)


def test_golden_section():
    x, value = mass_map.golden_section(lambda v: (v - 0.3) ** 2 + 1, 0.0, 1.0)
    assert abs(x - 0.3) < 1e-6 and abs(value - 1) < 1e-9


def test_cohort_and_expression(spark):
    rows = generators.cohort(spark, sites=(("Site A", "Region I", 40), ("Site B", "Region II", 40), ("Site C", "Region III", 40)), prospective=10)
    assert rows.count() == 130 and rows.where("arm = 'prospective'").count() == 10 and rows.where("arm = 'retrospective' and recurrence is not null").count() == 0
    from beliefline.operators import cohort

    assert cohort.expectations(rows, generators.rules()).count() == 0
    assert cohort.expectations(rows.withColumn("ct_stage", F.lit(7)), generators.rules()).count() == 130
    labelled = cohort.labelled(rows)
    values = generators.expression(spark, labelled, ["a", "b", "c", "d"])
    assert values.count() == 4 * labelled.count()
    means = {(r["gene"], r["label"]): r["m"] for r in values.join(labelled, "record_id").groupBy("gene", "label").agg(F.avg("value").alias("m")).collect()}
    assert means["a", 1] + means["d", 1] > means["a", 0] + means["d", 0]


def test_cohort_holds_exact_counts(spark):
    rows = generators.cohort(spark).cache()
    by = {(r["site"], r["arm"]): r for r in rows.groupBy("site", "arm").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("ids")).collect()}
    assert {k: r["n"] for k, r in by.items() if k[1] == "prospective"} == {(s, "prospective"): 275 for s, *_ in generators.SITES}
    assert rows.select("record_id").distinct().count() == 4125
    small = generators.cohort(spark, sites=(("Site A", "Region I", 4000),), prospective=0)
    share = small.where("outcome_ascertained").agg(F.avg(F.col("pcr").cast("int"))).first()[0]
    assert abs(share - 0.25) < 0.01, "responses and lost outcomes are unrelated"
    shares = {r["histology"]: r["count"] / 4125 for r in rows.groupBy("histology").count().collect()}
    assert all(abs(shares[h] - p) < 0.02 for h, p in generators.HISTOLOGIES)
    assert abs(rows.agg(F.avg("age")).first()[0] - 63) < 0.6 and abs(rows.agg(F.stddev("age")).first()[0] - 10) < 0.5
    again = generators.cohort(spark).repartition(7)
    assert rows.exceptAll(again).count() == 0
    rows.unpersist()


def test_discovery_has_clinical_evidence_for_the_whole_pool(spark):
    run = jobs.Runtime(spark)
    scores = run.sources()["CLIN"](run.pool)
    assert scores.count() == run.pool.count() == scores.where("score is not null").count() == 132


def test_network_questions(spark):
    net = flux.toy_network()
    rows = {r["gene"]: r for r in flux.suppression(spark, net, ["G1", "none"]).collect()}
    assert rows["G1"]["growth_loss"] == 1.0 and rows["G1"]["score"] == 1.0 and rows["none"]["score"] is None
    whole = data.reduced_network()
    assert not whole.has_rule("nothing") and whole.has_rule("HMGCR")
    scores = {r["gene"]: r["score"] for r in flux.flux_scores(spark, whole, whole.without("SLC16A3"), ["SLC16A3", "HMGCR", "HK2"]).collect()}
    assert scores["HK2"] is None and scores["HMGCR"] == pytest.approx(0.7 + 0.3 * 0.6) and 0 <= scores["SLC16A3"] < 0.5
    assert flux.dependency_rank(flux.suppression(spark, whole, ["HMGCR", "SLC16A3"])).orderBy("rank").first()["gene"] == "HMGCR"
    lethal = flux.synthetic_lethality(spark, whole, [("HK2", "GCK"), ("PFKM", "SLC16A3")]).collect()
    assert {r["first"]: round(r["loss"], 6) for r in lethal}["HK2"] == 1.0
    assert flux.utilisation(whole, "nowhere") == 0.0 and flux.utilisation(whole, "oxidative-phosphorylation") > 0.6
    assert whole.expressed({"G": 1.0}).optimum() == 0.0 and whole.expressed({g: 1.0 for g in whole.genes()}).optimum() == pytest.approx(whole.optimum())
    frame = flux.reaction_frame(spark, whole)
    genes = {r["gene"]: r["reactions"] for r in flux.reactions_of_genes(frame).collect()}
    assert genes["ATP5F1A"] == ["OXPHOS"] and "ENVIRONMENT" not in genes
    assert flux.alternative_uptake(frame, "nothing").count() == 0 and {"HK2"} <= {r[0] for r in flux.alternative_uptake(frame, "PHGDH").collect()}


def test_flux_samples(spark):
    net = flux.toy_network()
    samples = flux.flux_samples(spark, net, 40, [1, 2], fraction=0.5).cache()
    stoich = spark.createDataFrame([(r.name, m, v) for r in net.reactions for m, v in r.coefficients.items()], "reaction string, metabolite string, coefficient double")
    bounds = spark.createDataFrame([(r.name, r.low, r.high) for r in net.reactions], "reaction string, low double, high double")
    one = samples.where("seed = 1 and sample = 7").select("reaction", "flux")
    assert flux.feasible(stoich, one, bounds).first()["feasible"] and not flux.feasible(stoich, one.withColumn("flux", F.col("flux") + 1), bounds).first()["feasible"]
    spread = {r["reaction"]: r for r in flux.flux_distribution(samples).collect()}
    assert 0.25 - 1e-9 <= spread["DRAIN"]["low"] <= spread["DRAIN"]["mean"] <= spread["DRAIN"]["high"] <= 0.5 + 1e-9
    narrow = flux.flux_samples(spark, net, 40, [3], fraction=0.95)
    assert {r["reaction"]: r["narrowing"] for r in flux.range_narrowing(samples, narrow).collect()}["DRAIN"] > 0.5
    assert all(r["shift"] > 0 for r in flux.flux_shift(samples, narrow, flux.reaction_frame(spark, net)).collect())


def test_reader_study(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(int(rng.random() < 0.4 + 0.2 * arm), r, arm) for r in range(6) for arm in (0, 1) for _ in range(60)], "agree int, reader int, arm int")
    built, names = stats.reader_design(rows, "reader", "arm")
    assert names == ["intercept", "assisted_arm", *(f"reader_{i}" for i in range(1, 6))]
    gain = stats.arm_gain(stats.fit_gee(built, "agree", names[:2], "reader"), names)
    assert gain["lower"] < gain["coefficient"] < gain["upper"] and gain["odds_ratio"] > 1
    assert stats.accrual_covers(stats.sizing(spark)).first().asDict() == {"covered": 3, "total": 3, "all_covered": True}


def test_configuration(tmp_path):
    (tmp_path / "experiment").mkdir()
    (tmp_path / "model").mkdir()
    (tmp_path / "experiment" / "x.yaml").write_text("model: small\nmodel_override: {depth: 3}\ntrain: {rate: 0.1}\n")
    (tmp_path / "model" / "small.yaml").write_text("depth: 1\nwidth: 2\n")
    found = readers.experiment(str(tmp_path), "x", ["train.rate=0.5", "train.names=[a, 2, true]", "new.deep.key=null"])
    assert found["model"] == {"depth": 3, "width": 2} and found["train"] == {"rate": 0.5, "names": ["a", 2, True]} and found["new"] == {"deep": {"key": None}} and found["data"] == {}
    with pytest.raises(ValueError):
        readers.overridden({}, ["nothing"])


@pytest.mark.parametrize(("job", "options", "table", "rows"), [("size", {}, "minima", 3), ("ablate", {"candidates": 120}, "battery", 15), ("simulate", {"seeds": 2, "candidates": 60, "bootstrap": 100}, "verdicts", 5), ("calibrate", {"epochs": 20}, "history", 20)])
def test_jobs(spark, tmp_path, job, options, table, rows):
    out = f"file://{tmp_path}"
    assert jobs.run(spark, job, out, **options)[table] == rows
    assert f'"job": "{job}"' in sinks.read_text(spark, f"{out}/summary.json") and sinks.read_text(spark, f"{out}/summary.txt").startswith(job)


def test_verdicts(spark):
    some = contrasts.verdict(spark, "a", True, 1.0, 0.0).unionByName(contrasts.verdict(spark, "b", False, 0.0, 1.0))
    assert {r["verdict"]: r["n"] for r in contrasts.verdict_counts(some).collect()} == {"pass": 1, "fail": 1, "not_tested": 0}
    r = contrasts.cutoff_reachability(spark).first()
    assert round(r["ceiling"], 4) == 0.0333 and r["first_reachable"] == 45 and not r["reachable"]
    assert jobs.design({"simulation": {"cutoff": 7, "seeds": 4}}, seeds=2) == {"conflicts": jobs.CONFLICTS, "absents": jobs.ABSENTS, "seeds": (1, 2), "candidates": 2000, "k": 7}


def test_survival_over_ranges_of_times(spark):
    rng = np.random.default_rng(6)
    t, e, r = rng.exponential(size=300).round(3), rng.integers(0, 3, 300), rng.normal(size=300).round(1)
    rows = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r, strict=True)], "t double, e int, r double")
    good = pairs = 0.0
    for i in np.flatnonzero(e == 1):
        after = t > t[i]
        pairs += after.sum()
        good += (after & (r[i] > r)).sum() + 0.5 * (after & (r[i] == r)).sum()
    found = stats.concordance_index(rows.withColumn("d", (F.col("e") == 1).cast("int")), "t", "d", "r").first()
    assert found["pairs"] == pairs and found["concordance"] == pytest.approx(good / pairs)
    survival, incidence = 1.0, 0.0
    got = {x["time"]: x for x in stats.cumulative_incidence(rows, "t", "e").collect()}
    for x in sorted(set(t.tolist())):
        risk, d, some = (t >= x).sum(), ((t == x) & (e == 1)).sum(), ((t == x) & (e > 0)).sum()
        incidence += survival * d / risk
        survival *= 1 - some / risk
        assert got[x]["at_risk"] == risk and got[x]["survival"] == pytest.approx(survival, abs=1e-9) and got[x]["incidence"] == pytest.approx(incidence)
    plain = stats.fit_cox(rows.withColumn("d", (F.col("e") == 1).cast("int")), "t", "d", ["r"])
    one = stats.fit_cox(rows.withColumn("d", (F.col("e") == 1).cast("int")).withColumn("s", F.lit(1)), "t", "d", ["r"], stratum="s")
    assert plain["coefficients"] == pytest.approx(one["coefficients"]) and plain["loglik"] == pytest.approx(one["loglik"])
