"""What the ordered rule guarantees: width grows with conflict, and agreement converges to a floor set by the rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .fusion import ignorance_floor, reliability_order

#: Points and ends of the two grids, the centre and spread of pressure, the strengths of sharpening.
PRESSURES, CENTRE, SPREAD = 26, 0.5, 0.45
SHARPNESS, LEAST, MOST, BASE, STEP = 48, 0.25, 24.0, 0.6, 0.4
CHECKS = ("conflict_monotonicity", "pignistic_convergence", "floor_vanishes_iff_rate_saturates")


def trajectory(masses: Column, rule=C.pair) -> Column:
    """The width after each step of the ordered fold, the first mass's own first."""
    start = F.struct(F.element_at(masses, 1).cast(C.MASS).alias("m"), F.array(F.element_at(masses, 1)["theta"]).alias("w"))

    def step(acc: Column, m: Column) -> Column:
        out, _ = rule(acc["m"], m)
        return F.struct(out.cast(C.MASS).alias("m"), F.array_append(acc["w"], out["theta"]).alias("w"))

    return F.aggregate(F.slice(masses, F.lit(2), F.greatest(F.size(masses) - 1, F.lit(0))), start, step)["w"]


def _scan(grid: DataFrame, posteriors: list[Column], rates: dict[str, float]) -> DataFrame:
    """grid with conflict, width, betp and widths of the fold of one posterior a modality, in order of reliability."""
    order = reliability_order(rates)
    masses = F.array(*(C.discount(C.from_posterior(p), rates[m]) for p, m in zip(posteriors, order, strict=True)))
    rows = grid.withColumn("__f", C.fold(masses)).withColumn("widths", trajectory(masses))
    m = F.col("__f")["m"]
    total = F.aggregate(F.col("__f")["ks"], F.lit(0.0), lambda s, k: s + k)
    return rows.select(*grid.columns, total.alias("conflict"), C.width(m).alias("width"), C.pignistic(m).alias("betp"), "widths")


def _grid(spark: SparkSession, name: str, low: float, high: float, points: int) -> DataFrame:
    return spark.range(points).select(F.col("id").alias("point"), (low + (high - low) * F.col("id") / float(points - 1)).alias(name))


def monotonicity_scan(spark: SparkSession, rates: dict[str, float], points: int = PRESSURES) -> DataFrame:
    """point, pressure, conflict, width, betp, widths: modalities are pushed apart by turns, ignorance held fixed."""
    grid = _grid(spark, "pressure", 0.0, 1.0, points)
    return _scan(grid, [C.clip(CENTRE + SPREAD * F.col("pressure") * (1.0 if i % 2 == 0 else -1.0)) for i in range(4)], rates)


def convergence_scan(spark: SparkSession, rates: dict[str, float], *, target: bool = True, points: int = SHARPNESS) -> DataFrame:
    """point, sharpness, conflict, width, betp, widths, bias (distance from the truth): all sharpen towards one status."""
    grid = _grid(spark, "sharpness", LEAST, MOST, points)
    sign = 1.0 if target else -1.0
    rows = _scan(grid, [C.sigmoid(sign * (BASE + STEP * i) * F.col("sharpness")) for i in range(4)], rates)
    return rows.withColumn("bias", F.abs(F.col("betp") - (1.0 if target else 0.0)))


def bias_floor(rates: dict[str, float]) -> float:
    """Half of the ignorance that no agreement removes."""
    return ignorance_floor(rates) / 2.0


def zero_conflict_limit(rates: dict[str, float], *, target: bool = True) -> tuple[float, float]:
    """(betp in the limit of full agreement, its distance from the truth)."""
    floor = bias_floor(rates)
    return (1.0 - floor if target else floor), floor


def worst_decrease(scan: DataFrame) -> DataFrame:
    """worst: how far the width falls from a point to the next at most (0 if never), as a sum over neighbouring points."""
    later = scan.select((F.col("point") - 1).alias("point"), F.col("width").alias("__next"))
    return scan.join(later, "point").agg(F.greatest(F.max(F.col("width") - F.col("__next")), F.lit(0.0)).alias("worst"))


def monotonicity_detail(scan: DataFrame) -> DataFrame:
    """Conflict and width at both ends of a scan, and the worst decrease, as one row."""
    ends = scan.agg(*(f(c, "point").alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in ("conflict", "width")))
    return ends.crossJoin(worst_decrease(scan))  # a row each


def approaches_limit(scan: DataFrame, rates: dict[str, float], *, target: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """holds, betp of the last point, limit, floor: whether the scan ends at its limit and its bias at the floor."""
    limit, floor = zero_conflict_limit(rates, target=target)
    last = scan.agg(F.max_by("betp", "point").alias("betp"), F.max_by("bias", "point").alias("bias"))
    near = (F.abs(F.col("betp") - limit) <= tolerance) & (F.abs(F.col("bias") - floor) <= tolerance)
    return last.select(near.alias("holds"), "betp", F.lit(limit).alias("limit"), F.lit(floor).alias("floor"))


def summary(spark: SparkSession, rates: dict[str, float]) -> DataFrame:
    """name, holds, statistic of the three guarantees, a row each."""
    up = worst_decrease(monotonicity_scan(spark, rates)).select(F.lit(CHECKS[0]).alias("name"), (F.col("worst") <= 1e-12).alias("holds"), F.col("worst").alias("statistic"))
    to = [approaches_limit(convergence_scan(spark, rates, target=t), rates, target=t) for t in (True, False)]
    both = to[0].unionByName(to[1]).agg(F.bool_and("holds").alias("holds"), F.max("betp").alias("statistic")).select(F.lit(CHECKS[1]).alias("name"), "holds", "statistic")
    table = spark.createDataFrame([(m, float(r)) for m, r in rates.items()], "modality string, rate double")
    floor = ignorance_floor(rates)
    vanish = table.agg(F.bool_or(F.col("rate") >= 1.0).alias("one")).select(F.lit(CHECKS[2]).alias("name"), (F.col("one") == F.lit(floor == 0.0)).alias("holds"), F.lit(floor).alias("statistic"))
    return up.unionByName(both).unionByName(vanish)
