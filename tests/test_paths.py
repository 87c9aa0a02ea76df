"""Paths from both ends against a plain search."""

import random

import pytest

from beliefline.operators import graph


def plain_paths(edges, sources, target, hops):
    found = []

    def walk(source, nodes, relations, weights):
        if nodes[-1] == target and relations:
            found.append((source, tuple(nodes), tuple(relations), tuple(weights)))
            return
        for u, v, r, w in edges if len(relations) < hops else ():
            if u == nodes[-1] and v not in nodes:
                walk(source, [*nodes, v], [*relations, r], [*weights, w])

    for s in sources:
        walk(s, [s], [], [])
    return sorted(found)


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_paths_from_both_ends(spark, hops):
    rng = random.Random(hops)
    names = [f"n{i}" for i in range(9)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice("xy"), rng.randrange(4) / 4) for _ in range(50)]  # loops and repeats among them
    sources = ["n0", "n3", "n8", "n0", "lost"]  # the target is a source, one stands twice, one has no edge
    df = spark.createDataFrame(edges, "src string, dst string, relation string, weight double")
    got = graph.simple_paths(df, spark.createDataFrame([(s,) for s in sources], "source string"), "n8", hops)
    rows = sorted((r["source"], tuple(r["nodes"]), tuple(r["relations"]), tuple(r["weights"])) for r in got.collect())
    assert rows == plain_paths(edges, sources, "n8", hops) and (rows or hops < 3)
    assert all(r["hops"] == len(r["relations"]) for r in got.collect())


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string, relation string, weight double")
    assert graph.simple_paths(none, spark.createDataFrame([("a",)], "source string"), "b").count() == 0
