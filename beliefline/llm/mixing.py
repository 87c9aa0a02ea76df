"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

Every document gets an exponential key, -ln(u) / quality weight, with u from a hash of its id and text. Sources take whole
epochs first (every document once an epoch) and then documents by ascending key until the rest of their budget is
spent. The prefix sums do not put a source into one task: keys are cut into about sqrt(n) ranges of a source, ranges
are summed, and only the sums are cumulated over a source; rows are cumulated within their range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix"
#: Up to so many sources their budgets are broadcast, beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


@dataclass
class Budget:
    source: str | None
    size: int
    rows: int
    target: float
    epochs: int
    rest: float
    ranges: int
    weight: float


def targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[float]:
    """Shares of sum(sizes) by weight; none above cap times its size, what they leave is shared anew by weight."""
    total, left_size, left_weight, level = sum(sizes), sum(sizes), sum(weights), 0.0
    for i in sorted((i for i in range(len(sizes))), key=lambda i: (cap * sizes[i] / weights[i], i)):
        level = left_size / left_weight
        if cap * sizes[i] >= weights[i] * level:
            break
        left_size, left_weight = left_size - cap * sizes[i], left_weight - weights[i]
        level = left_size / left_weight if left_weight else 0.0
    return [min(float(cap * s), w * level) if total else 0.0 for s, w in zip(sizes, weights, strict=True)]


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts of 3 to 15 characters a word, 0.25 for others."""
    return F.when(F.length(text).between(4 * size, 16 * size), F.lit(1e0)).otherwise(F.lit(0.25e0))


def digest(text: Column) -> Column:
    """Hex MD5 of the text, null as empty: with the id it tells rows apart."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def budgets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> list[Budget]:
    """A budget for each source, in order of code points, null last. One row a source comes to the driver."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.avg("weight").alias("weight")).orderBy(F.col("source").asc_nulls_last()).collect()
    goal = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], cap)
    out = []
    for r, t in zip(rows, goal, strict=True):
        epochs = min(cap, int(t // r["size"])) if r["size"] else 0
        out.append(Budget(r["source"], r["size"], r["n"], t, epochs, t - epochs * r["size"], max(1, round(r["n"] ** 0.5)), r["weight"]))
    return out


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size (words), source_size, target, times (how often the mix takes it), taken (words), digest.

    Quality weights come from ``weight_col`` (above 0; null counts as 1), else from quality_weight(). A null text has
    no words; a null source is a source of its own. Rows that repeat an id, null among them, have keys of their
    own unless their texts are equal too; repeated rows are rows of their own. The document at the edge of a budget is taken if more than half of
    it fits, so a source misses its target by half a document at most. A text without words takes nothing of a budget: it comes where
    its place in the order falls, ``cap`` times at most like any other. Reruns agree. Other columns are not read.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), digest(F.col(text_col))).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), (F.coalesce(F.col(weight_col).cast("double"), F.lit(1e0)) if weight_col else quality_weight(F.coalesce(F.col(text_col), F.lit("")), size)).alias("weight"), u.alias("u"), digest(F.col(text_col)).alias("digest"))
    sizes = sizes.withColumn("key", -F.log("u") / F.col("weight")).drop("u")
    sizes = materialise(sizes, "sizes")
    plan = budgets(sizes, weights, cap)
    plan_schema = "plan_source string, source_size long, target double, epochs int, rest double, ranges int, mean double"
    plans = spark.createDataFrame([(b.source, b.size, b.target, b.epochs, b.rest, b.ranges, b.weight) for b in plan], plan_schema)
    rows = sizes.join(F.broadcast(plans) if len(plan) <= BROADCAST_SOURCES else plans, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    place = F.floor((1 - F.exp(-F.col("key") * F.col("mean"))) * F.col("ranges"))
    rows = rows.withColumn("range", F.least(place, F.col("ranges") - 1).cast("int")).withColumn("group", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("range")))
    sums = rows.groupBy("group").agg(F.sum("size").alias("sum"), F.first("source").alias("s"), F.first("range").alias("r"))
    before = sums.select("group", (F.sum("sum").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).alias("before"))
    inner = Window.partitionBy("group").orderBy("key", "size", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(inner)).join(before, "group")
    start = F.col("before") + F.col("within") - F.col("size")
    times = F.least(F.lit(cap), F.col("epochs") + F.when(2 * start + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"), "digest")


#: The same in DuckDB's SQL, for the default weights, cap and seed.
ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, length(coalesce(text, '')) as chars,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint::double + 0.5e0) / 4503599627370496e0 as u, md5(coalesce(text, '')) as digest
  from documents),
keyed as (select *, -ln(u) / (case when chars between 4 * size and 16 * size then 1e0 else 0.25e0 end) as key from sized),
sources as (
  select source, sum(size)::bigint as s, [5, 2, 1][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int]::bigint as w,
         row_number() over (order by source nulls last) as i
  from keyed group by source),
ordered as (
  select *, 3 * s::double / w as r, row_number() over (order by 3 * s::double / w, i) as k from sources),
levels as (
  select *, ((select sum(s) from sources) - coalesce(sum(3 * s) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
          / ((select sum(w) from sources) - coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0))::double as level
  from ordered),
flat as (select min_by(level, k) as level from levels where 3 * s >= w * level),
goals as (select source, s, least((3 * s)::double, w * flat.level) as target from sources, flat),
plans as (select *, case when s > 0 then least(3, floor(target / s))::int else 0 end as epochs from goals),
run as (
  select k.*, p.s, p.target, p.epochs, p.target - p.epochs * p.s as rest,
         sum(k.size) over (partition by k.source order by k.key, k.size, k.doc_id, k.digest rows unbounded preceding) - k.size as start
  from keyed k join plans p on k.source is not distinct from p.source)
select doc_id, size, s as source_size, target, (size * (epochs + case when 2 * start + size <= 2 * rest then 1 else 0 end))::bigint as taken
from run
"""
