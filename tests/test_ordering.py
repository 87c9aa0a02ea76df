"""Order statistics and dominance counts on heavy ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beliefline.operators import metrics, ordering, stats


def test_a_constant_score_spreads_over_ranges(spark):
    rows = spark.range(0, 60_000, 1, 6).select((F.col("id") * 7919 % 60_000).alias("name"), F.lit(0.5).alias("score"))
    placed = ordering.placed(rows, *ordering.best_first("score", "name"), ranges=6)
    sizes = [r["count"] for r in placed.groupBy("__p").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert ordering.ranked(rows, "score", "name").where("rank <> name + 1").count() == 0


def test_ranks_of_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(f"n{i:03d}", None if i % 11 == 0 else float(rng.integers(0, 4))) for i in range(300)]
    df = spark.createDataFrame(rows, "name string, score double").repartition(5)
    want = {n: r for r, (n, _) in enumerate(sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])), 1)}
    assert {r["name"]: r["rank"] for r in ordering.ranked(df, "score", "name").collect()} == want
    counts = ordering.running(ordering.placed(df, *ordering.best_first("score", "name"), ranges=5), {"n": F.lit(1)})
    assert counts.where("n <> place + 1").count() == 0
    values = np.array([-np.inf if s is None else s for _, s in rows])
    mid = {n: float((values < v).sum() + ((values == v).sum() + 1) / 2) for (n, _), v in zip(rows, values, strict=True)}
    assert {r["name"]: r["midrank"] for r in ordering.midranks(df, "score").collect()} == mid
    assert ordering.ranked(df.limit(0), "score", "name").count() == 0 and ordering.midranks(df.limit(0), "score").count() == 0


def test_ranking_metrics_without_positives(spark):
    df = spark.createDataFrame([(i, 0.5, False) for i in range(9)], "candidate long, score double, vulnerable boolean")
    assert metrics.ranking_metrics(df, k=3).first().asDict() == {"recall_at_k": None, "precision_at_k": 0.0, "mrr": 0.0, "average_precision": None}


def test_roc_of_ties_and_null_labels(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(0, 6)), None if i % 13 == 0 else bool(rng.random() < 0.4)) for i in range(400)]
    pos, neg = np.array([s for s, y in rows if y]), np.array([s for s, y in rows if y is False])
    grid = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
    got = stats.roc_estimate(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()
    assert got["auc"] == pytest.approx(grid.mean()) and (got["positives"], got["negatives"]) == (len(pos), len(neg))
    assert got["variance"] == pytest.approx(grid.mean(axis=1).var(ddof=1) / len(pos) + grid.mean(axis=0).var(ddof=1) / len(neg))


def test_inversions_against_pairs():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 7, 100):
        rank, left, right = rng.permutation(n) * 3, rng.integers(0, 5, n).astype(float), rng.integers(0, 5, n).astype(float)
        assert stats.inversions(rank, left, right) == sum(left[i] * right[j] for i in range(n) for j in range(i + 1, n) if rank[i] > rank[j])


def plain_concordance(t, e, r):
    good = pairs = 0.0
    for i in np.flatnonzero(e == 1):
        later = t > t[i]
        pairs += later.sum()
        good += (later & (r < r[i])).sum() + (later & (r == r[i])).sum() / 2
    return good / pairs if pairs else 0.5, pairs


@pytest.mark.parametrize("times,risks", [(3, 10**9), (10**9, 3), (1, 50), (40, 1), (10**9, 10**9), (5, 4)])
def test_concordance_on_heavy_ties(spark, times, risks):
    rng = np.random.default_rng(times % 97 + risks % 89)
    t, r, e = rng.integers(0, times, 700).astype(float), rng.integers(0, risks, 700).astype(float), rng.integers(0, 2, 700)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r, strict=True)] + [(None, 1, 2.0)], "t double, e int, r double")
    want, pairs = plain_concordance(t, e, r)
    got = stats.concordance_index(df, "t", "e", "r", ranges=13).first()
    assert got["pairs"] == pairs and got["concordance"] == pytest.approx(want)


def test_concordance_without_rows(spark):
    assert stats.concordance_index(spark.createDataFrame([], "t double, e int, r double"), "t", "e", "r").first()[:] == (0.5, 0)
