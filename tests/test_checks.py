"""Checks that tables meet as they are written."""

from beliefline.plans import checks, jobs


def test_broken_rows_are_counted_as_they_are_written(spark, tmp_path):
    rows = [("a", 0.2, 0.6, 0.4, 0.4, 1), ("b", 0.5, 0.4, 0.45, -0.1, 0), (None, float("nan"), 0.9, 0.95, 0.1, 2)]
    df = spark.createDataFrame(rows, "candidate string, bel double, pl double, betp double, width double, rank int")
    kept = checks.Recorder(spark, "some")
    for name, table in (("scores", df), ("none", df.limit(0)), ("plain", df.select("rank"))):
        kept.watched(name, table).write.parquet(str(tmp_path / name))
    got = {(r["table"], r["check"]): (r["status"], r["broken"], r["rows"]) for r in kept.rows().collect()}
    assert kept.counts() == {"scores": 3, "none": 0, "plain": 3}
    assert got["scores", "has_rows"] == ("PASS", 0, 3) and got["none", "has_rows"] == ("FAIL", 1, 0)
    assert got["scores", "candidate_is_there"] == ("FAIL", 1, 3) and got["scores", "width_is_a_share"] == ("FAIL", 1, 3)
    assert got["scores", "bel_is_a_number"] == ("FAIL", 1, 3) and got["scores", "pl_is_a_number"] == ("PASS", 0, 3)
    assert got["scores", "belief_below_pignistic_below_plausibility"][1] == 2 and got["scores", "ranks_begin_at_one"] == ("FAIL", 1, 3)
    assert {c for t, c in got if t == "plain"} == {"has_rows", "ranks_begin_at_one"}


def test_jobs_yield_checks(spark, tmp_path):
    out = f"file://{tmp_path}"
    found = jobs.run(spark, "size", out)
    table = spark.read.parquet(f"{out}/checks")
    assert {r["table"]: r["rows"] for r in table.where("check = 'has_rows'").collect()} == found
    assert table.where("status <> 'PASS'").count() == 0 and table.count() > len(found)
