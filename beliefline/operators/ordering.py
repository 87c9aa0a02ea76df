"""Global order without a global window.

A window without a partition puts all rows into one task. Where rows may tie, ``placed`` deals them by ranges of the whole
order (the name that breaks ties included, so that one heavy value spreads over many ranges), sorts within ranges and
adds the sizes of the ranges before, one broadcast row a range. Where keys are distinct, as after an aggregation by
key, ``prefix_sums`` cuts them at approximate quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pinned import pinned


def placed(df: DataFrame, *order: Column, into: str = "place", ranges: int | None = None) -> DataFrame:
    """df with each row's place, from 0, in the order of all rows, and ``__p``, the range of the order that holds it.

    Ranges are cut on all of ``order``, so ties of its first part spread if the rest tells them apart. The dealt rows are
    written: which row is where must not change between the count of the ranges and their use. ranges: about so many;
    else as many as the size of the rows calls for.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    dealt = pinned(dealt.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    dealt = dealt.withColumn("__p", F.shiftright("__at", 33))
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    over = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__b"))  # a row a range
    rows = dealt.join(F.broadcast(before), "__p")
    return rows.select(*df.columns, "__p", (F.col("__b") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias(into))


def running(rows: DataFrame, values: dict[str, Column], place: str = "place", *, by=F.sum) -> DataFrame:
    """Rows of placed(), or some of them, with running sums (or F.max, F.min) of columns in their order; each counts itself."""
    totals = rows.groupBy("__p").agg(*(by(c).alias(f"__t_{n}") for n, c in values.items()))
    over = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__p", *(by(f"__t_{n}").over(over).alias(f"__b_{n}") for n in values))  # a row a range
    within = Window.partitionBy("__p").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(by(c).over(within).alias(f"__w_{n}") for n, c in values.items())).join(F.broadcast(before), "__p")
    both = {F.sum: lambda b, w: F.coalesce(b, F.lit(0)) + w, F.max: F.greatest, F.min: F.least}[by]  # greatest and least pass over nulls
    return out.select(*rows.columns, *(both(F.col(f"__b_{n}"), F.col(f"__w_{n}")).alias(n) for n in values))


def grouped(df: DataFrame, key: str, parts: int | None = None, error: float | None = None) -> DataFrame:
    """df with ``__g``, a number that ascends with the numeric column key, whose values are mostly distinct; nulls come
    first."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], error or 0.5 / parts))) if parts > 1 else []

    def place(lo: int, hi: int) -> Column:
        """Cuts lo to hi - 1 by halving."""
        if lo == hi:
            return F.lit(lo)
        m = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(cuts[m]), place(lo, m)).otherwise(place(m + 1, hi))

    return df.withColumn("__g", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place(0, len(cuts))))


def prefix_sums(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], *, descending: bool = False, inclusive: bool = True) -> DataFrame:
    """df with the running sums of columns in a total order that agrees with key.

    order: within equal keys and all; key must be its first part, and few rows share a key. The values of a row count
    into its own sums unless inclusive is false.
    """
    rows = grouped(df, key)
    totals = rows.groupBy("__g").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    over = Window.orderBy(F.col("__g").desc() if descending else F.col("__g").asc()).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__g", *(F.coalesce(F.sum(f"__t_{n}").over(over), F.lit(0)).alias(f"__b_{n}") for n in sums))  # a row a group
    within = Window.partitionBy("__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__w_{n}") for n, c in sums.items()))
    rows = rows.join(F.broadcast(before), "__g")
    return rows.select(*df.columns, *((F.col(f"__b_{n}") + F.col(f"__w_{n}")).alias(n) for n in sums))


def best_first(score: str, name: str) -> tuple[Column, Column]:
    """The order of a ranking: score descending, nulls last, then name."""
    return F.col(score).desc_nulls_last(), F.col(name).asc()


def ranked(df: DataFrame, score: str, name: str, into: str = "rank") -> DataFrame:
    """1-based ranks by score descending, name ascending; null scores last."""
    return placed(df, *best_first(score, name), into="__place").select(*df.columns, (F.col("__place") + 1).alias(into))


def midranks(df: DataFrame, value: str, into: str = "midrank") -> DataFrame:
    """Ascending ranks, ties averaged; nulls tie with each other, first. Equal values are counted before anything is
    ordered, so a heavy tie is one row of the order."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    counts = prefix_sums(counts, "__v", [F.col("__v").asc_nulls_first()], {"__b": F.col("__c")}, inclusive=False)
    rows = df.join(counts, F.col(value).eqNullSafe(F.col("__v")))
    return rows.select(*df.columns, (F.col("__b") + (F.col("__c") + 1) / 2.0).alias(into))
