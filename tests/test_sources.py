"""Readers and sinks on small files."""

import json

import pytest

from beliefline.operators import flux, fusion
from beliefline.plans.fixtures import view
from beliefline.sources import digests, readers, sinks
from beliefline.streaming import ledger


def test_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("case_id\tproject_id\na\tTCGA-COAD\n")
    assert readers.clinical(spark, str(tmp_path / "c.tsv")).count() == 1
    (tmp_path / "d.tsv").write_text("case_id\tproject_id\na\tTCGA-XXXX\n")
    with pytest.raises(ValueError):
        readers.clinical(spark, str(tmp_path / "d.tsv"))
    (tmp_path / "e.csv").write_text("model,A (1),B (2)\nm1,-0.5,NA\nm2,,0.25\n")
    assert sorted(map(tuple, readers.gene_effects(spark, str(tmp_path / "e.csv")).collect())) == [("m1", "A", -0.5), ("m2", "B", 0.25)]
    (tmp_path / "r.csv").write_text("gene,response\nA,1\nA,2\nB,NA\n")
    assert [tuple(r) for r in readers.drug_responses(spark, str(tmp_path / "r.csv")).collect()] == [("A", 2.0)]
    (tmp_path / "m.txt").write_text('!Sample_geo_accession\t"S1"\t"S2"\n"ID_REF"\t"S1"\n"G1"\t3\n')
    samples, genes = readers.series_matrix(spark, str(tmp_path / "m.txt"))
    assert [r["sample"] for r in samples.collect()] == ["S1", "S2"] and [r["gene"] for r in genes.orderBy("seq").collect()] == ["ID_REF", "G1"]
    assert [r["exists"] for r in readers.inventory(spark, f"file://{tmp_path}", ["c.tsv", "none"]).collect()] == [True, False]


def test_network_file(spark, tmp_path):
    doc = {"reactions": [{"id": "FEED", "metabolites": {"s": 3.0}, "upper_bound": 1.0}, {"id": "USE", "metabolites": {"s": -2.0}, "gene_reaction_rule": "G1"}]}
    (tmp_path / "n.json").write_text(json.dumps(doc))
    rows = readers.network(spark, str(tmp_path / "n.json"))
    assert flux.network_from_frames(rows, "USE").optimum() == pytest.approx(1.0)
    assert {(r["reaction"], r["coefficient"]) for r in flux.stoichiometry(rows).collect()} == {("FEED", 1.0), ("USE", -1.0)}


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("a: {b: 1}\n")
    assert readers.merged(readers.config(str(tmp_path / "a.yaml")), {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}
    (tmp_path / "b.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        readers.config(str(tmp_path / "b.yaml"))


def test_ledger_and_graph_round_trip(spark, sf_dir, tmp_path):
    rates = {"KG": 0.86, "DEP": 0.91, "FLUX": 0.74, "CLIN": 0.66}
    scores = view(spark, sf_dir, "scores")
    rows = sinks.ledger_rows(fusion.reports(scores, rates), fusion.long_masses(scores, rates), agent="a", source="s", version="1", recorded_at="2026-01-01 00:00:00")
    assert tuple(rows.columns) == sinks.LEDGER_FIELDS
    sinks.append_ledger(rows, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 4 * scores.count()
    with pytest.raises(ValueError):
        sinks.append_ledger(rows.limit(0), str(tmp_path / "ledger"))
    edges = view(spark, sf_dir, "edges")
    nodes = edges.selectExpr("src as key", "'x' as kind").distinct()
    sinks.save_graph(nodes, edges, str(tmp_path / "g"))
    a, b = sinks.load_graph(spark, str(tmp_path / "g"))
    assert (a.count(), b.count()) == (nodes.count(), edges.count())
    assert len(digests.tree_digest(spark, str(tmp_path / "g"))) == 64


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = ledger.read_events(spark, str(tmp_path / "in"))
    q = ledger.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r["start"], r["event_type"], r["n"]) for r in rows)
    assert key(spark.table("counted").collect()) == key(ledger.windowed(batch).collect())
    ledger.append_citations(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
