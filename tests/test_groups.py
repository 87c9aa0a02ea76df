"""Bootstraps of mergeable states and regressions of many groups against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beliefline.operators import stats


def weights(spark, keys, resamples, seed):
    rows = spark.createDataFrame([(k, b) for k in keys for b in range(resamples)], "k long, b int")
    got = rows.select("k", "b", stats.poisson_weight(F.col("k"), F.col("b"), seed).alias("w")).collect()
    out = np.zeros((resamples, len(keys)))
    place = {k: i for i, k in enumerate(keys)}
    for r in got:
        out[r["b"], place[r["k"]]] = r["w"]
    return out


def test_poisson_weights(spark):
    w = weights(spark, list(range(400)), 20, 1)
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1


def test_spread_and_area_against_repeated_rows(spark):
    rng = np.random.default_rng(3)
    v, y = rng.normal(size=120), rng.random(120) < 0.4
    df = spark.createDataFrame([(i, "a", float(x), bool(z)) for i, (x, z) in enumerate(zip(v, y, strict=True))] + [(999, "a", None, None)], "id long, g string, v double, y boolean")
    w = weights(spark, list(range(120)), 30, 9).astype(int)
    spread = [np.repeat(v, row).std(ddof=1) for row in w]
    r = stats.bootstrap_spread(df, ["g"], "v", "id", resamples=30, seed=9).first()
    assert r["point"] == pytest.approx(v.std(ddof=1)) and [r["lower"], r["upper"]] == pytest.approx(np.quantile(spread, [0.025, 0.975]).tolist())
    bins = np.clip(np.floor((v + 3) / 6 * 32), 0, 31)

    def area(row):
        p, n = np.repeat(bins[y], row[y]), np.repeat(bins[~y], row[~y])
        return ((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean()

    r = stats.bootstrap_area(df, ["g"], "v", "y", "id", low=-3.0, high=3.0, bins=32, resamples=30, seed=9).first()
    assert r["point"] == pytest.approx(area(np.ones(120, int))) and [r["lower"], r["upper"]] == pytest.approx(np.quantile([area(x) for x in w], [0.025, 0.975]).tolist())


def test_quantile_is_exact_to_a_bin(spark):
    df = spark.range(1001).select(F.lit(1).alias("g"), "id", (F.col("id") / 1000).alias("v"))
    for share in (0.1, 0.5, 0.9):
        r = stats.bootstrap_quantile(df, ["g"], "v", "id", share=share, bins=100, resamples=20).first()
        assert abs(r["point"] - share) <= 0.01 and r["lower"] < share < r["upper"]
    assert stats.bootstrap_quantile(df.limit(0), ["g"], "v", "id").count() == 0


def test_group_without_a_class_has_no_area(spark):
    df = spark.createDataFrame([(i, "a", i / 9, True) for i in range(9)], "id long, g string, v double, y boolean")
    assert stats.bootstrap_area(df, ["g"], "v", "y", "id", resamples=5).first().asDict() == {"g": "a", "point": None, "lower": None, "upper": None}


def test_grouped_r2_against_pseudo_inverse(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(8):
        x = rng.normal(size=(30, 4))
        if g == 1:
            x[:, 2] = 2 * x[:, 0] + 1  # explained by another
        if g == 2:
            x[:, 1] = 5.0  # constant
        y = x @ np.array([1.0, -1.0, 0.5, 0.0]) + rng.normal(size=30) + 1e6 * (g == 3)
        if g == 4:
            y[:] = 2.0
        key = None if g == 5 else f"g{g}"
        rows += [(key, *map(float, a), float(b)) for a, b in zip(x, y, strict=True)]

        def r2(f, x=x, y=y):
            full = np.column_stack([np.ones(30), x[:, :f]])
            left = y - full @ np.linalg.pinv(full) @ y
            total = ((y - y.mean()) ** 2).sum()
            return 0.0 if total <= 1e-15 else 1 - (left**2).sum() / total

        want[key] = (r2(2), r2(4))
    df = spark.createDataFrame(rows + [("g0", None, 1.0, 1.0, 1.0, 1.0)], "pivot string, gain double, s0_0 double, n double, `a.b` double, y double")  # names that clash
    got = {r["pivot"]: r for r in stats.grouped_r2(df, ["pivot"], {"two": ["gain", "s0_0"], "four": ["gain", "s0_0", "n", "a.b"]}, "y").collect()}
    assert set(got) == set(want) and all(r["n"] == 30 for r in got.values())
    for k, (two, four) in want.items():
        assert (got[k]["two"], got[k]["four"]) == pytest.approx((two, four), abs=1e-7), k
    with pytest.raises(ValueError):
        stats.grouped_r2(df, ["pivot"], {"a": ["gain"], "b": ["n", "gain"]}, "y")
