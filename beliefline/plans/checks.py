"""Checks of a job's tables, gathered while the tables are written: no table is scanned for them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PASS, FAIL, SCHEMA = "PASS", "FAIL", "job string, table string, check string, group string, status string, broken long, rows long"
#: Columns that hold shares, wherever they stand.
SHARES = ("bel", "pl", "betp", "width", "recall", "recall_at_k", "best_single_recall", "precision_at_k", "brier", "ece", "rate", "grounding_rate", "hallucinated_rate", "mean_score", "mean_width", "power")
#: Columns that name a row, wherever they stand.
KEYS = ("candidate", "modality", "label", "metric", "verdict", "gene", "record_id", "number")
#: What holds for tables of given columns: the check, its group, the columns that it needs, the rows that break it.
RULES = (
    ("belief_below_pignistic_below_plausibility", "belief", ("bel", "betp", "pl"), "bel > betp + 1e-9 or betp > pl + 1e-9"),
    ("width_is_the_gap_of_belief_and_plausibility", "belief", ("bel", "pl", "width"), "abs(pl - bel - width) > 1e-9"),
    ("conflict_is_not_negative", "belief", ("total_conflict",), "total_conflict < -1e-9"),
    ("interval_is_ordered", "intervals", ("lower", "upper"), "lower > upper + 1e-12"),
    ("rates_agree", "calibration", ("numeric", "closed"), "abs(numeric - closed) > 1e-6"),
    ("ranks_begin_at_one", "ranking", ("rank",), "rank < 1"),
    ("verdict_is_known", "hypotheses", ("verdict", "statistic"), "verdict not in ('pass', 'fail', 'not_tested')"),
    ("cited_is_grounded_or_not", "provenance", ("cited", "grounded"), "grounded > cited or cited < 0"),
)


def expected(df: DataFrame) -> dict[tuple[str, str], Column]:
    """(check, group) with the number of rows that break it, for a table's columns; the first counts rows that are there."""
    kinds = dict(df.dtypes)
    out: dict[tuple[str, str], Column] = {}
    for c, kind in kinds.items():
        at = F.col(f"`{c}`")
        if kind in ("double", "float"):
            out[f"{c}_is_a_number", "numbers"] = F.count_if(F.isnan(at) | (F.abs(at) == float("inf")))
        if c in SHARES and kind in ("double", "float"):
            out[f"{c}_is_a_share", "numbers"] = F.count_if(~at.between(-1e-9, 1 + 1e-9))
        if c in KEYS:
            out[f"{c}_is_there", "keys"] = F.count_if(at.isNull())
    for check, group, columns, broken in RULES:
        if set(columns) <= set(kinds):
            out[check, group] = F.count_if(F.expr(broken))
    return out


class Recorder:
    """The checks of one job. ``watched`` gives a table that counts what breaks its checks as it is written, once; ``rows``
    gives what was counted."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job = spark, job
        self.seen: list[tuple[str, list[tuple[str, str]], Observation]] = []

    def watched(self, name: str, df: DataFrame) -> DataFrame:
        checks = expected(df)
        found = Observation(f"{self.job}-{name}-{len(self.seen)}")
        self.seen.append((name, list(checks), found))
        return df.observe(found, F.count(F.lit(1)).alias("rows"), *(c.alias(f"c{i}") for i, c in enumerate(checks.values())))

    def counts(self) -> dict[str, int]:
        return {name: found.get["rows"] for name, _, found in self.seen}

    def rows(self) -> DataFrame:
        """job, table, check, group, status, broken, rows: a row a check. A table without rows fails its first."""
        out = []
        for name, checks, found in self.seen:
            got = found.get
            out.append((self.job, name, "has_rows", "tables", PASS if got["rows"] else FAIL, int(not got["rows"]), got["rows"]))
            out += [(self.job, name, check, group, FAIL if got[f"c{i}"] else PASS, got[f"c{i}"], got["rows"]) for i, (check, group) in enumerate(checks)]
        return self.spark.createDataFrame(out, SCHEMA)
