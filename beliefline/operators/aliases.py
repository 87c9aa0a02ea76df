"""Names that stand for the same thing: alias tables as a graph, closed over chains, with a rule for clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pinned import pinned


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of the pairs is joined with, over any number of steps.

    Every node points to the least node that it knows of, itself at first. In a round it takes the least of what its
    neighbours point to, and then what that one points to, so chains halve; a hub is one row of a join and of an
    aggregation that tasks combine first. It ends when a round changes nothing. Pairs with a null end are left out.
    """
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = pinned(both.union(both.select("v", "u")).distinct(), "pairs")
    points = pinned(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "points")
    while True:
        near = both.join(points.select(F.col("node").alias("v"), F.col("component").alias("of")), "v").groupBy(F.col("u").alias("node")).agg(F.min("of").alias("of"))
        heard = points.join(near, "node").select("node", "component", F.least("component", "of").alias("least"))
        jump = heard.select(F.col("node").alias("least"), F.col("least").alias("beyond"))
        after = pinned(heard.join(jump, "least").select("node", F.least("least", "beyond").alias("component"), (F.least("least", "beyond") != F.col("component")).alias("changed")), "points")
        if after.where("changed").isEmpty():
            return after.select("node", "component")
        points = after.select("node", "component")


def closure(table: DataFrame, *, alias: str = "alias", symbol: str = "symbol") -> DataFrame:
    """name, canonical, symbols, clash: what each name of an alias table stands for.

    Names count in upper case. An alias of an alias stands for what that one stands for: names that rows join, in either
    direction, are one thing. Its symbols are the names that are no alias of another; the canonical one is the least of them,
    and more than one is a clash. Where each is an alias of another (a circle), the least name is canonical, with no
    symbol and no clash. Rows with a null are left out; a name that is its own alias says nothing.
    """
    rows = table.select(F.upper(alias).alias("alias"), F.upper(symbol).alias("symbol")).where("alias is not null and symbol is not null").distinct()
    other = rows.where("alias <> symbol")
    found = components(rows, "alias", "symbol")
    named = found.join(other.select(F.col("alias").alias("node")).distinct().withColumn("is_alias", F.lit(True)), "node", "left")
    of = named.groupBy("component").agg(F.min(F.when(F.col("is_alias").isNull(), F.col("node"))).alias("first"), F.count_if(F.col("is_alias").isNull()).alias("symbols"))
    return found.join(of, "component").select(F.col("node").alias("name"), F.coalesce("first", "component").alias("canonical"), "symbols", (F.col("symbols") > 1).alias("clash"))


def resolved(queries: DataFrame, closed: DataFrame, *, name: str = "name") -> DataFrame:
    """queries with ``symbol``: the canonical name of each, itself in upper case where no alias knows it, NULL for NULL,
    and ``clash``. closed: of closure()."""
    known = closed.select(F.col("name").alias("__name"), "canonical", F.col("clash").alias("__clash"))
    rows = queries.join(known, F.upper(F.col(name)) == F.col("__name"), "left")
    return rows.select(*queries.columns, F.coalesce("canonical", F.upper(F.col(name))).alias("symbol"), F.coalesce("__clash", F.lit(False)).alias("clash"))
