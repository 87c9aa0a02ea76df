"""Alias tables: chains, circles, clashes."""

import random

from beliefline.operators import aliases
from beliefline.sources import reference_data as data


def closed(spark, rows):
    return {r["name"]: (r["canonical"], r["symbols"], r["clash"]) for r in aliases.closure(spark.createDataFrame(rows, "alias string, symbol string")).collect()}


def test_chains_clashes_and_circles(spark):
    got = closed(spark, [("glut1", "SLC2A1"), ("old", "Glut1"), ("older", "OLD"), ("x", "B"), ("X", "A"), ("p", "q"), ("q", "p"), ("self", "SELF"), (None, "z"), ("y", None), ("glut1", "slc2a1")])
    assert {got[n] for n in ("GLUT1", "OLD", "OLDER", "SLC2A1")} == {("SLC2A1", 1, False)}
    assert {got[n] for n in ("A", "B", "X")} == {("A", 2, True)}
    assert got["P"] == got["Q"] == ("P", 0, False) and got["SELF"] == ("SELF", 1, False)
    assert set(got) == {"GLUT1", "OLD", "OLDER", "SLC2A1", "A", "B", "X", "P", "Q", "SELF"}
    assert closed(spark, []) == {}


def test_a_long_chain_and_a_hub(spark):
    rows = [(f"n{i + 1:03d}", f"n{i:03d}") for i in range(70)] + [(f"h{i:03d}", "hub") for i in range(200)]
    random.Random(1).shuffle(rows)
    got = closed(spark, rows)
    assert all(got[f"N{i:03d}"] == ("N000", 1, False) for i in range(71)) and all(got[f"H{i:03d}"][0] == "HUB" for i in range(200))


def test_resolution(spark):
    table = aliases.closure(spark.createDataFrame(list(data.ALIASES.items()), "alias string, symbol string"))
    got = {r["name"]: r["symbol"] for r in aliases.resolved(spark.createDataFrame([("glut1",), ("MCT9",), ("slc2a1",), ("Hk2",), (None,)], "name string"), table).collect()}
    assert got == {"glut1": "SLC2A1", "MCT9": "SLC16A9", "slc2a1": "SLC2A1", "Hk2": "HK2", None: None}
