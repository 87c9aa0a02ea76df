"""The entry point holds every query, and statements only for queries."""

import __spark_entry__ as entry


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "belief_rank" in names
    assert entry.llm_queries is None or {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "candidate" and df.count() > 0
