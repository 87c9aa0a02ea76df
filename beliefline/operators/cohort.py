"""Clinical records: exclusions, labels and censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exclusion() -> Column:
    """The first reason to exclude a record, NULL if it is retained."""
    return F.when(~F.col("rna_yield_ok"), "insufficient_rna").when(~F.col("outcome_ascertained"), "outcome_missing")


def retained(records: DataFrame) -> DataFrame:
    return records.where(exclusion().isNull())


def labelled(records: DataFrame) -> DataFrame:
    return retained(records).where("pcr is not null").withColumn("label", F.col("pcr").cast("int"))


def census(records: DataFrame) -> DataFrame:
    """dimension, value, n, retained, pcr_rate: by arm, site, exclusion and over all, as grouping sets of one scan."""
    rows = records.select("arm", "site", F.coalesce(exclusion(), F.lit("none")).alias("exclusion"), exclusion().isNull().alias("kept"), "pcr")
    name = F.when(F.col("g") == 3, "arm").when(F.col("g") == 5, "site").when(F.col("g") == 6, "exclusion").otherwise("all")
    sets = rows.groupingSets([["arm"], ["site"], ["exclusion"], []], "arm", "site", "exclusion")
    rate = F.avg(F.when(F.col("kept"), F.col("pcr").cast("int").cast("double")))
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("kept").alias("retained"), rate.alias("pcr_rate"))
    out = out.withColumn("value", F.coalesce("arm", "site", "exclusion", F.lit("all")))
    return out.select(name.alias("dimension"), "value", "n", "retained", "pcr_rate")


def expectations(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules that they break (a rule that is NULL is not broken)."""
    broken = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in rules.items())))
    return records.withColumn("broken", broken).where(F.size("broken") > 0)
