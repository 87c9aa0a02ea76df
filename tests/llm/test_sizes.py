"""Near-duplicates: sets whose sizes rule a link out do not meet, and texts that are not asked for do not move."""

import random

import pytest
from pyspark.sql import functions as F

from beliefline.llm import minhash


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_sizes_that_may_link_share_a_class(spark, percent):
    rows = spark.range(1, 3000).select(F.col("id").alias("n"), minhash.size_classes(F.col("id"), percent).alias("c")).union(spark.createDataFrame([(3 * 10**6, None), (4 * 10**6, None)], "n long, c array<long>").select("n", minhash.size_classes(F.col("n"), percent)))
    c = {r["n"]: set(r["c"]) for r in rows.collect()}
    assert all(c[n] & c[least] for n in c if (least := -(-percent * n // 100)) in c)
    assert not c[100] & c[1000]


def test_only_texts_of_sets_that_may_link_move(spark, monkeypatch):
    rng, rows, seen, write = random.Random(4), [], {}, minhash.materialise
    for i in range(40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:220]))]  # alike by a half: most share a bucket
    rows += [(100, rows[0][1] + " x"), (101, rows[1][1] + " y")]

    def kept(df, name):
        seen.setdefault(name, []).append((df._jdf.queryExecution().executedPlan().toString(), (out := write(df, name)).count()))
        return out

    monkeypatch.setattr(minhash, "materialise", kept)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(80)} | {100: 0, 101: 1}
    assert seen["members"][0][1] == 4
    assert "LeftSemi" in seen["texts"][0][0]
