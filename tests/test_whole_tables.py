"""Queries without an SQL statement read whole tables."""

from beliefline.operators import stats
from beliefline.plans import queries as own


def test_gee_fit_reads_all_orders(spark, sf_dir, monkeypatch):
    seen, fit = [], stats.fit_gee
    monkeypatch.setattr(stats, "fit_gee", lambda rows, *a, **b: seen.append(rows.count()) or fit(rows, *a, **b))
    assert own.queries()["gee_fit"](spark, sf_dir).count() == 2
    assert seen == [spark.read.parquet(f"{sf_dir}/orders.parquet").count()]
