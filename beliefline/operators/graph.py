"""Typed multigraphs as two DataFrames: nodes (key, kind, ...) and edges (seq, src, dst, relation, release_date, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, strict_date
from .ordering import placed
from .pinned import pinned

#: Fixed values of path support.
HOP_DECAY, PATHWAY_SATURATION = 0.55, 4.0
METABOLIC = ("metabolic_reaction", "reaction_enzyme", "metabolite_pathway")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge (by seq) of each (src, dst, relation), as an aggregation."""
    keys = ["src", "dst", "relation"]
    rest = [c for c in edges.columns if c not in keys]
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("e")).select(*keys, "e.*").select(edges.columns)


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """The first node of each key; ``clash`` says whether its key came with two kinds."""
    rest = [c for c in nodes.columns if c != "key"]
    out = nodes.groupBy("key").agg(F.min_by(F.struct(*rest), "seq").alias("n"), (F.min("kind") != F.max("kind")).alias("clash"))
    return out.select("key", "n.*", "clash")


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    keys = nodes.select("key")
    a = edges.join(keys, edges["src"] == keys["key"], "left_anti")
    return a.union(edges.join(keys, edges["src"] == keys["key"], "left_semi").join(keys, edges["dst"] == keys["key"], "left_anti"))


def drop_edges(edges: DataFrame, drop: Column) -> DataFrame:
    return edges.where(~F.coalesce(drop, F.lit(False)))


def cutoff(edges: DataFrame, last: str, *, require_dated: bool = False) -> DataFrame:
    """Edges not released strictly after ``last``; undated ones stay unless require_dated."""
    late = F.coalesce(strict_date(F.col("release_date")) > F.lit(last).cast("date"), F.lit(require_dated))
    return edges.where(~late)


def holdout(edges: DataFrame, candidate: str, phenotype: str) -> DataFrame:
    return drop_edges(edges, (F.col("src") == candidate) & (F.col("dst") == phenotype))


def without_reference(edges: DataFrame, reference: str) -> DataFrame:
    """Edges whose evidence does not contain the reference; an empty reference drops nothing."""
    return drop_edges(edges, F.contains(F.col("evidence_ref"), F.lit(reference))) if reference else edges


def induced(edges: DataFrame, keep: DataFrame, key: str = "key") -> DataFrame:
    """Edges with both ends among the keys."""
    k = keep.select(F.col(key).alias("__k")).distinct()
    return edges.join(k, F.col("src") == F.col("__k"), "left_semi").join(k, F.col("dst") == F.col("__k"), "left_semi")


def census(edges: DataFrame, by: tuple[str, ...] = ("relation", "source_db")) -> DataFrame:
    """dimension, value, n: counts by each column; a row counts once for every column, and tasks combine their counts first."""
    long = edges.unpivot([], list(by), "dimension", "value")
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def bfs_depth(edges: DataFrame, sources: DataFrame, hops: int = 3) -> DataFrame:
    """source, node, depth for nodes within ``hops``; each level joins the frontier alone."""
    step = edges.select("src", "dst").distinct()
    level = sources.select(F.col("source"), F.col("source").alias("node"), F.lit(0).alias("depth"))
    seen = level
    for d in range(1, hops + 1):
        level = level.join(step, level["node"] == step["src"]).select("source", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(d))
        level = level.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        seen = seen.unionByName(level)
    return seen


def _nodes_by_walk(edges: DataFrame, start: DataFrame, steps: int, *, reverse: bool = False) -> list[DataFrame]:
    """key of the nodes that a walk of exactly 0, 1, ... steps from (to, if reverse) the start reaches. A node is a row."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    out = [start.select(F.col("key")).distinct()]
    for _ in range(steps):
        near = out[-1].select(F.col("key").alias("__k"))
        out.append(pinned(edges.join(near, F.col(here) == F.col("__k"), "left_semi").select(F.col(there).alias("key")).distinct(), "reached"))
    return out


def simple_paths(edges: DataFrame, sources: DataFrame, target: str, hops: int = 3) -> DataFrame:
    """source, hops, nodes, relations, weights: every simple path to the target of at most ``hops`` edges, for all
    sources at once. Paths stop at the target; parallel relations give paths of their own.

    A path of n edges is a head of ceil(n / 2) edges from its source and a tail of floor(n / 2) edges to the target, which
    meet in its middle: heads and tails grow apart, and only along nodes that a walk from a source reaches and a walk to
    the target leaves in the steps that are left. Each path has one middle, so none is made twice.
    """
    e = pinned(edges.select("src", "dst", "relation", F.col("weight").cast("double").alias("weight")).where("src <> dst"), "edges")
    goal = e.sparkSession.createDataFrame([(target,)], "key string")
    from_sources = _nodes_by_walk(e, sources.select(F.col("source").alias("key")), hops - 1)
    to_target = _nodes_by_walk(e, goal, hops - 1, reverse=True)

    def within(levels: list[DataFrame], most: int) -> DataFrame:
        """Nodes of the levels 0 to most but the target."""
        out = levels[0]
        for level in levels[1 : most + 1]:
            out = out.union(level)
        return out.distinct().where(F.col("key") != target).select(F.col("key").alias("__k"))

    start = {"relations": F.array().cast("array<string>"), "weights": F.array().cast("array<double>")}
    heads = sources.select("source", F.array("source").alias("nodes"), *(c.alias(n) for n, c in start.items())).withColumn("end", F.col("source"))
    tails = [goal.select(F.col("key").alias("end"), F.array("key").alias("nodes"), *(c.alias(n) for n, c in start.items()))]
    for k in range(1, hops // 2 + 1):
        near = within(from_sources, hops - k)
        step = e.join(near, F.col("src") == F.col("__k"), "left_semi")
        grown = tails[-1].join(step, F.col("end") == F.col("dst")).where(~F.array_contains("nodes", F.col("src")))
        before = {"nodes": "src", "relations": "relation", "weights": "weight"}
        tails.append(grown.select(F.col("src").alias("end"), *(F.concat(F.array(c), n).alias(n) for n, c in before.items())))
    done = None
    for h in range(1, (hops + 1) // 2 + 1):
        near = within(to_target, hops - h)
        if h == 1:  # an edge straight to the target
            near = near.union(goal.select(F.col("key").alias("__k")))
        step = e.join(near, F.col("dst") == F.col("__k"), "left_semi")
        grown = heads.where(F.col("end") != target).join(step, F.col("end") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        heads = grown.select("source", F.col("dst").alias("end"), *(F.array_append(n, F.col(c)).alias(n) for n, c in (("nodes", "dst"), ("relations", "relation"), ("weights", "weight"))))
        for tail in (t for k, t in enumerate(tails) if (h + k + 1) // 2 == h and h + k <= hops):
            t = tail.select(F.col("end"), F.slice("nodes", 2, hops).alias("__n"), F.col("relations").alias("__r"), F.col("weights").alias("__w"))
            met = heads.join(t, "end").where(~F.arrays_overlap("nodes", "__n"))
            met = met.select("source", F.concat("nodes", "__n").alias("nodes"), F.concat("relations", "__r").alias("relations"), F.concat("weights", "__w").alias("weights"))
            done = met if done is None else done.unionByName(met)
    return done.select("source", F.size("relations").alias("hops"), "nodes", "relations", "weights")


def path_support(paths: DataFrame, kinds: DataFrame, pathway_kind: str = "pathway") -> DataFrame:
    """source, paths, hits (distinct pathway nodes), support: 0.6 * min(1, hits / 4) + 0.4 * m / (1 + m), m the sum of
    decay^hops times the weights. kinds: key, kind."""
    strength = F.pow(F.lit(HOP_DECAY), F.col("hops")) * F.aggregate("weights", F.lit(1.0), lambda a, w: a * F.greatest(w, F.lit(0.0)))
    mass = paths.groupBy("source").agg(F.count("*").alias("paths"), F.sum(strength).alias("m"), F.max((F.col("hops") == 1).cast("int")).alias("direct"))
    on = paths.select("source", F.explode("nodes").alias("key")).distinct().join(kinds.where(F.col("kind") == pathway_kind).select("key"), "key", "left_semi")
    hits = on.groupBy("source").agg(F.count("*").alias("hits"))
    rows = mass.join(hits, "source", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    support = clip(0.6 * F.least(F.lit(1.0), F.col("hits") / PATHWAY_SATURATION) + 0.4 * F.col("m") / (1.0 + F.col("m")))
    return rows.select("source", "paths", "hits", (F.col("direct") == 1).alias("direct"), support.alias("support"))


def resolve(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, key: the node of that key, else the first (by seq) with an identifier value or namespace like it."""
    exact = queries.join(nodes.select(F.col("key").alias("query"), F.col("key").alias("exact")), "query", "left")
    names = nodes.select("key", "seq", F.explode("identifiers").alias("i")).select("key", "seq", F.explode(F.array("i.namespace", "i.value")).alias("name"))
    first = names.groupBy(F.upper("name").alias("upper")).agg(F.min_by("key", "seq").alias("like"))
    rows = exact.withColumn("upper", F.upper("query")).join(first, "upper", "left")
    return rows.select("query", F.coalesce("exact", "like").alias("key"))


def neighbours(edges: DataFrame, nodes: DataFrame, *, reverse: bool = False) -> DataFrame:
    """Edges out of (into) the given keys."""
    return edges.join(nodes.select(F.col("key").alias("dst" if reverse else "src")), "dst" if reverse else "src", "left_semi")


def pathway_of(edges: DataFrame) -> DataFrame:
    """reaction, pathway: its own first membership, else the first membership of its first enzyme."""
    member = edges.where("relation = 'gene_pathway_membership'").select("src", "dst", "seq")
    first = member.groupBy("src").agg(F.min_by("dst", "seq").alias("pathway"))
    enzyme = edges.where("relation = 'reaction_enzyme'").groupBy(F.col("dst").alias("reaction")).agg(F.min_by("src", "seq").alias("enzyme"))
    own = first.select(F.col("src").alias("reaction"), F.col("pathway").alias("own"))
    via = enzyme.join(first.withColumnRenamed("src", "enzyme"), "enzyme", "left").select("reaction", F.col("pathway").alias("via"))
    return own.join(via, "reaction", "full").select("reaction", F.coalesce("own", "via").alias("pathway"))


def first_seen(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Rows numbered by their place within the key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(seq)))


def accepted(edges: DataFrame, *, relations: list[str] | None = None, nodes: DataFrame | None = None, kinds: list[str] | None = None, last: str | None = None) -> DataFrame:
    """Edges that a path may use: of given relations, into nodes of given kinds, released by a date (undated ones stay)."""
    out = edges.where(F.col("relation").isin(*relations)) if relations is not None else edges
    if kinds is not None:
        keys = nodes.where(F.col("kind").isin(*kinds)).select(F.col("key").alias("__k"))
        out = out.join(keys, F.col("dst") == F.col("__k"), "left_semi")
    return cutoff(out, last) if last else out


def citations(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """source, evidence_ref of every step of the paths whose edge has one; repeats stay."""
    steps = paths.select("source", F.explode(F.transform("relations", lambda r, i: F.struct(F.get("nodes", i).alias("src"), F.get("nodes", i + 1).alias("dst"), r.alias("relation")))).alias("s"))
    known = edges.select("src", "dst", "relation", "evidence_ref").where("evidence_ref is not null and evidence_ref <> ''")
    return steps.select("source", "s.*").join(known, ["src", "dst", "relation"]).select("source", "evidence_ref")


def metabolic_edges(edges: DataFrame) -> DataFrame:
    """n: edges of the three metabolic relations."""
    return edges.where(F.col("relation").isin(*METABOLIC)).agg(F.count("*").alias("n"))


def has_edge(pairs: DataFrame, edges: DataFrame, relation: str | None = None) -> DataFrame:
    """Pairs (src, dst) that an edge, of that relation if given, joins."""
    e = edges.where(F.col("relation") == relation) if relation else edges
    return pairs.join(e.select("src", "dst"), ["src", "dst"], "left_semi")


def enzyme_partners(edges: DataFrame, reactions: DataFrame) -> DataFrame:
    """reaction, gene of the enzymes of given reactions."""
    e = edges.where("relation = 'reaction_enzyme'").select(F.col("dst").alias("reaction"), F.col("src").alias("gene"))
    return e.join(reactions.select("reaction"), "reaction", "left_semi")


def positions(nodes: DataFrame) -> DataFrame:
    """key, position: places from 0 in the order of seq."""
    rows = nodes.select("key", "seq")
    return placed(rows, F.col("seq").asc(), F.col("key").asc(), into="position").select("key", "position")


def leakage_audit(edges: DataFrame, pairs: DataFrame, *, last: str, reference: str) -> DataFrame:
    """control, removed, kept: edges that the date cutoff, the evidence reference and the hold-out of all pairs
    (candidate, phenotype) remove, each by itself; one scan for the first two, a semi-join for the third."""
    late = F.coalesce(strict_date(F.col("release_date")) > F.lit(last).cast("date"), F.lit(False))
    cited = F.coalesce(F.contains(F.col("evidence_ref"), F.lit(reference)), F.lit(False)) if reference else F.lit(False)
    direct = edges.join(pairs.select(F.col("candidate").alias("src"), F.col("phenotype").alias("dst")).distinct().withColumn("__d", F.lit(True)), ["src", "dst"], "left")
    flags = {"cutoff": late, "reference": cited, "holdout": F.coalesce(F.col("__d"), F.lit(False))}
    wide = direct.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(k).alias("control"), F.col(k).alias("removed"), (F.col("n") - F.col(k)).alias("kept")) for k in flags))))
