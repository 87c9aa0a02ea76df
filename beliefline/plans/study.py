"""Queries of guarantees, contrasts, intervals, pools and networks, each with an independent SQL statement where there
is one. They stand in the registry of the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aliases, benchmark, calibration, cohort, contrasts, flux, fusion, graph, guarantees, mass_map, stats
from ..operators import metrics  # noqa: I001
from ..sources import generators
from ..sources import reference_data as data
from . import oracles as O
from .fixtures import ctes, view
from .queries import RATES, _reports, _scored, _sources, query, tidy

_A = [RATES[m] for m in O.ORDER]


def _scan_sql(points: int, grid: str, posteriors: list[str]) -> str:
    """The fold of four posteriors along a grid, a CTE a step."""
    out = [f"with p as (select i::bigint as point, {grid} as x from range({points}) t(i))"]
    masses = ", ".join(f"{a}*({q}) as v{i}, {a}*(1e0-({q})) as n{i}, 1e0-{a} as t{i}" for i, (a, q) in enumerate(zip(_A, posteriors, strict=True)))
    out.append(f"m as (select *, {masses} from p)")
    out.append("s0 as (select *, v0 as v, n0 as n, t0 as t, 0e0 as k, t0 as w0 from m)")
    for i in (1, 2, 3):
        k = f"(v*n{i}+n*v{i})"
        out.append(f"s{i} as (select * replace (v*v{i}+v*t{i}+t*v{i} as v, n*n{i}+n*t{i}+t*n{i} as n, t*t{i}+{k} as t, k+{k} as k), t*t{i}+{k} as w{i} from s{i - 1})")
    return ",\n".join(out)


_PRESSURE = _scan_sql(guarantees.PRESSURES, "i/25e0", [f"least(greatest(0.5e0{s}0.45e0*x,0e0),1e0)" for s in "+-+-"])
_SHARP = _scan_sql(guarantees.SHARPNESS, "0.25e0+23.75e0*i/47e0", [f"1e0/(1e0+exp(-{0.6 + 0.4 * i}*x))" for i in range(4)])
_FLOOR = "*".join(f"(1e0-{a})" for a in _A)


@query(_PRESSURE + " select point, round(x,6) as pressure, round(k,6) as conflict, round(t,6) as width, round(v+t/2e0,6) as betp, round(w1,6) as second_width from s3")
def conflict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guarantees.monotonicity_scan(spark, RATES)
    return tidy(rows.select("point", "pressure", "conflict", "width", "betp", F.get("widths", F.lit(1)).alias("second_width")))


@query(_SHARP + " select point, round(x,6) as sharpness, round(k,6) as conflict, round(v+t/2e0,6) as betp, round(abs(v+t/2e0-1e0),6) as bias from s3")
def convergence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(guarantees.convergence_scan(spark, RATES).select("point", "sharpness", "conflict", "betp", "bias"))


@query(_PRESSURE + f""", d as (select greatest(max(t-nt),0e0) as worst from (select t, lead(t) over (order by point) as nt from s3)),
l as (select max_by(k, point) as k, max_by(t, point) as w, min_by(t, point) as w0 from s3)
select round(w0,6) as first_width, round(w,6) as last_width, round(k,6) as last_conflict, round(worst,6) as worst, round({_FLOOR}/2e0,9) as floor, worst <= 1e-12 as holds from l, d""")
def guarantee_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guarantees.monotonicity_detail(guarantees.monotonicity_scan(spark, RATES))
    held = guarantees.summary(spark, RATES).agg(F.bool_and("holds").alias("holds"))
    rows = rows.crossJoin(held).withColumn("floor", F.lit(guarantees.bias_floor(RATES)))  # a row each
    return rows.select(*(F.round(c, 6).alias(c) for c in ("first_width", "last_width", "last_conflict", "worst")), F.round("floor", 9).alias("floor"), "holds")


@query(O.MASSES + ",\nw0 as (select *, dep_dv as v, dep_dn as n, dep_dt as t, dep_dt as a0 from masses)" + "".join(
    f",\nw{i} as (select * replace (v*{s}_dv+v*{s}_dt+t*{s}_dv as v, n*{s}_dn+n*{s}_dt+t*{s}_dn as n, t*{s}_dt+v*{s}_dn+n*{s}_dv as t), t*{s}_dt+v*{s}_dn+n*{s}_dv as a{i} from w{i - 1})" for i, s in enumerate(("kg", "flux", "clin"), 1)
) + " select candidate, round(a0,6) as step_0, round(a1,6) as step_1, round(a2,6) as step_2, round(a3,6) as step_3 from w3")
def width_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = guarantees.trajectory(F.array(*(fusion.mass_of(m, RATES) for m in fusion.reliability_order(RATES))))
    rows = view(spark, sf_dir, "scores").select("candidate", widths.alias("w"))
    return tidy(rows.select("candidate", *(F.get("w", F.lit(i)).alias(f"step_{i}") for i in range(4))))


_FLAGS = "((k1>=0.3)::int+(k2>=0.3)::int+(k3>=0.3)::int)::double"
_ABSENT = "+".join(f"({c} is null)::int" for c in O.COLUMN.values())


@query(O.FOLDED + f""", r as (select t as y, k1+k2+k3 as a, ({_ABSENT})::double as b, {_FLAGS} as c from f3),
r1 as (select r.*, b-(regr_intercept(b,a) over ()+regr_slope(b,a) over ()*a) as b1, c-(regr_intercept(c,a) over ()+regr_slope(c,a) over ()*a) as c1 from r),
r2 as (select *, c1-regr_slope(c1,b1) over ()*b1 as c2 from r1), s as (select power(corr(y,a),2)+power(corr(y,b1),2) as red, power(corr(y,c2),2) as extra from r2)
select round(red,6) as r2_reduced, round(red+extra,6) as r2_full, round(extra/(1e0-red),6) as partial from s""")
def trace_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.reports(view(spark, sf_dir, "scores"), RATES, threshold=0.3)
    flagged = F.size(F.filter("trace", lambda t: t["flagged"])).cast("double")
    rows = rows.select("width", "total_conflict", F.col("absent_modalities").cast("double").alias("absent_modalities"), flagged.alias("flagged_steps"))
    full, reduced = (stats.linear_r2(rows, list(f), "width") for f in ((*contrasts.REDUCED, "flagged_steps"), contrasts.REDUCED))
    return tidy(spark.createDataFrame([(reduced, full, (full - reduced) / (1 - reduced))], "r2_reduced double, r2_full double, partial double"))


@query(O.REPORTS + f""", naive as (select candidate, vulnerable, {O._SUMS[0]}/4e0+{O._SUMS[2]}/8e0 as b from masses),
a as (select vulnerable, row_number() over (order by round(betp,6) desc, candidate) as r from reports), n as (select vulnerable, row_number() over (order by round(b,6) desc, candidate) as r from naive),
x as (select (select count(*) filter (vulnerable and r <= 50)/count(*) filter (vulnerable)::double from a) as f, (select count(*) filter (vulnerable and r <= 50)/count(*) filter (vulnerable)::double from n) as g)
select round(f,6) as full_recall, round(g,6) as naive_recall, round(f-g,6) as loss from x""")
def fusion_rule_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(contrasts.fusion_rule_contrast(view(spark, sf_dir, "scores"), RATES, k=50))


@query(O.SCORED + """, f as (select ((candidate // 20) % 5)::int as fold, vulnerable, row_number() over (partition by (candidate // 20) % 5 order by score desc, candidate) as r from scored),
g as (select fold, count(*) filter (vulnerable and r <= 20)/count(*) filter (vulnerable)::double as recall from f group by fold) select round(avg(recall),6) as recall, count(*) as folds from g""")
def fold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(contrasts.fold_recall(_scored(spark, sf_dir).withColumn("fold", F.floor(F.col("candidate") / 20) % 5), k=20))


@query(O.SCORED + " select c.name, rank, coalesce(rank <= 10, false) as hit from (values ('1'),('17'),('150'),('-5')) c(name) left join scored s on s.candidate::varchar = c.name")
def named_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.ranks_of(_scored(spark, sf_dir), ["1", "17", "150", "-5"], k=10)


def _poisson_sql(rows: str, by: str, key: str, value: str, resamples: int, seed: int) -> str:
    """Weighted means of every replicate, a row each."""
    import math

    cuts, total = [], 0.0
    for n in range(8):
        total += math.exp(-1) / math.factorial(n)
        cuts.append(total)
    weight = "case " + " ".join(f"when u < {c!r}::double then {n}e0" for n, c in enumerate(cuts)) + " else 8e0 end"
    u = f"('0x' || substr(md5('{seed}:' || b || ':' || {key}),1,13))::bigint::double/4503599627370496e0"
    return f""", d as ({rows}), u as (select {by}, b, {value} as v, {u} as u from d, range({resamples}) t(b)),
w as (select {by}, b, sum({weight}*v)/nullif(sum({weight}),0) as m from u group by {by}, b)"""


_PAIRED = _poisson_sql("select candidate, candidate % 7 as grp, kg-dep as diff from scores where kg is not null and dep is not null", "grp", "candidate::varchar", "diff", 20, 0)


@query(ctes("scores") + _PAIRED + " select grp, round((select avg(diff) from d where d.grp = w.grp),6) as mean_difference, round(quantile_cont(m,0.025),6) as lower, round(quantile_cont(m,0.975),6) as upper from w group by grp")
def paired_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scores").withColumn("grp", F.col("candidate") % 7)
    return tidy(contrasts.paired_difference(rows, ["grp"], "kg", "dep", "candidate", resamples=20))


_CLUSTERED = _poisson_sql("select grp, candidate % 40 as cluster, avg(kg)-avg(dep) as diff from (select *, candidate % 2 as grp from scores) group by grp, candidate % 40", "grp", "cluster::varchar", "diff", 20, 3)


@query(ctes("scores") + _CLUSTERED + " select grp, round((select avg(diff) from d where d.grp = w.grp),6) as mean_difference, round(quantile_cont(m,0.025),6) as lower, round(quantile_cont(m,0.975),6) as upper from w group by grp")
def cluster_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scores").withColumn("grp", F.col("candidate") % 2).withColumn("cluster", F.col("candidate") % 40)
    return tidy(contrasts.cluster_difference(rows, ["grp"], "cluster", "kg", "dep", resamples=20, seed=3))


@query("""with r as (select o_orderpriority as site, avg(o_totalprice)/400000e0 as auc from orders group by 1) select round(max(auc)-min(auc),6) as gap, max(auc)-min(auc) > 0.1 as flagged from r""")
def site_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return tidy(contrasts.site_gap(orders.groupBy("o_orderpriority").agg((F.avg("o_totalprice") / 400000.0).alias("auc"))))


@query(ctes("edges") + " select count(*) as n from edges where relation in ('metabolic_reaction', 'reaction_enzyme', 'metabolite_pathway')")
def metabolic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metabolic_edges(view(spark, sf_dir, "edges"))


@query(ctes("edges") + " select dst as reaction, src as gene from edges where relation = 'reaction_enzyme' and dst in (select 'S:' || s_suppkey from supplier where s_nationkey = 3)")
def enzyme_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey = 3").select(F.concat(F.lit("S:"), "s_suppkey").alias("reaction"))
    return graph.enzyme_partners(view(spark, sf_dir, "edges"), suppliers)


@query(ctes("edges") + """, n as (select count(*) as n from edges), p as (select distinct src, dst from edges where relation = 'metabolic_reaction')
select 'cutoff' as control, count(*) filter (release_date > '2024-06-30') as removed, count(*) filter (release_date <= '2024-06-30') as kept from edges
union all select 'reference', count(*) filter (contains(source_db || '/' || src, 'lineitem/P:1')), count(*) filter (not contains(source_db || '/' || src, 'lineitem/P:1')) from edges
union all select 'holdout', count(*) filter ((src, dst) in (select (src, dst) from p)), count(*) filter ((src, dst) not in (select (src, dst) from p)) from edges""")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges").withColumn("evidence_ref", F.concat_ws("/", "source_db", "src"))
    pairs = edges.where("relation = 'metabolic_reaction'").select(F.col("src").alias("candidate"), F.col("dst").alias("phenotype"))
    return graph.leakage_audit(edges, pairs, last="2024-06-30", reference="lineitem/P:1")


@query(O._PATHS.replace("join edges e on e.src = g.nodes[-1] where", "join edges e on e.src = g.nodes[-1] and e.relation in ('gene_pathway_membership', 'pathway_disease_association') where") + " select source, count(*) as steps, count(distinct r) as refs from (select source, nodes[i] || '>' || nodes[i+1] as r from (select source, nodes, unnest(range(1, hops + 1)) as i from paths)) group by source")
def path_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.accepted(view(spark, sf_dir, "edges"), relations=["gene_pathway_membership", "pathway_disease_association"]).withColumn("evidence_ref", F.concat_ws(">", "src", "dst"))
    found = graph.citations(graph.simple_paths(edges, _sources(spark, sf_dir), "R:2", 3), edges)
    return found.groupBy("source").agg(F.count("*").alias("steps"), F.countDistinct("evidence_ref").alias("refs"))


@query("select s_suppkey::bigint as key, (row_number() over (order by s_acctbal, s_suppkey)-1)::bigint as position from supplier")
def node_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return graph.positions(suppliers.select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_acctbal").alias("seq")))


@query(O._SCORES_LONG + """, s as (select modality, sum((s-0.5e0)*(s-0.5e0)) as aa, sum((s-0.5e0)*(0.5e0-y)) as ab from long group by modality)
select modality, round(least(greatest(-ab/aa,0e0),1e0),6) as numeric, round(least(greatest(-ab/aa,0e0),1e0),6) as closed from s""")
def numeric_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(mass_map.numeric_rates(calibration.long_scores(view(spark, sf_dir, "scores"))).select("modality", "numeric", "closed"))


@query(O.SCORED + """, w as (select t as width from f3), q as (select round(width,6) as width from w), m as (select 0.33e0 as c),
a as (select width, true as l from q, m where width <= c union all select width, false from q, m where width >= c),
k as (select l, width, rank() over (order by -width) + (count(*) over (partition by width) - 1)/2e0 as r from a)
select round((sum(r) filter (l) - count(*) filter (l)*(count(*) filter (l)+1)/2e0)/(count(*) filter (l)*count(*) filter (not l)),6) as auroc, count(*) filter (l) as concordant, count(*) filter (not l) as discordant,
round(avg(width) filter (l),6) as mean_width_concordant, round(avg(width) filter (not l),6) as mean_width_discordant from k""")
def group_separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.separability(_scored(spark, sf_dir), 0.33))


@query(ctes("records") + " select count(*) filter (site not in ('Site A', 'Site B', 'Site C'))::bigint as site, count(*) filter (pcr is not null and not outcome_ascertained)::bigint as outcome from records")
def record_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {n: generators.rules()[n] for n in ("site", "outcome")}
    broken = cohort.expectations(view(spark, sf_dir, "records"), rules)
    return broken.agg(*(F.count_if(F.array_contains("broken", n)).alias(n) for n in rules))


@query("select 280::bigint as nodes, 822::bigint as edges, 388::bigint as metabolic, 132::bigint as candidates, 15::bigint as held_out, 21::bigint as late")
def reference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = generators.substrate(spark)
    edges = edges.cache()  # 822 rows
    pool = benchmark.pool_summary(nodes, edges, generators.candidate_pool(nodes), generators.held_out(edges))
    late = edges.where(F.col("release_date") > generators.CUTOFF).agg(F.count("*").alias("late"))
    return pool.crossJoin(late).select("nodes", "edges", "metabolic", "candidates", "held_out", "late")


@query("""with r as (select (i*104729+34909) % 4125 as place from range(4125) t(i))
select count(*) as records, count(*) filter (place >= 278+112) as retained, count(*) filter (place < 278) as insufficient_rna, count(*) filter (place between 278 and 278+111) as outcome_missing, count(*) filter (place is null) as broken from r""")
def reference_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generators.cohort(spark)
    x = cohort.exclusion()
    counts = rows.agg(F.count("*").alias("records"), F.count_if(x.isNull()).alias("retained"), *(F.count_if(x == n).alias(n) for n in ("insufficient_rna", "outcome_missing")))
    return counts.crossJoin(cohort.expectations(rows, generators.rules()).agg(F.count("*").alias("broken")))


@query("select 39::bigint as rows, 37::bigint as rebuilt, 2::bigint as original, true as valid, 0::bigint as unbound")
def operator_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import discovery

    rows = benchmark.registry(spark, data.operator_plan())
    scored = discovery.operator_scores(_reports(spark, sf_dir), data.operator_plan())
    unbound = benchmark.bindings(rows, scored.groupBy("number").agg(F.count("*").alias("n"))).agg(F.count("*").alias("unbound"))
    return benchmark.validate(rows).select("rows", "rebuilt", "original", "valid").crossJoin(unbound)


@query(None)
def gene_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = flux.suppression(spark, data.reduced_network(), [g for g in data.reduced_network().genes() if g not in flux.MARKERS])
    return tidy(flux.dependency_rank(scores).join(scores.drop("score"), "gene"))


@query("select 0.121473e0 as before, 0.094648e0 as after, true as falls")
def mass_map_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mass_map.fit(data.control_panel(spark))
    rows = [(float(found["before"]["brier"]), float(found["after"]["brier"]), found["history"][-1]["loss"] < found["history"][0]["loss"])]
    return tidy(spark.createDataFrame(rows, "before double, after double, falls boolean"))


def _weighted_sql(rows: str, key: str, resamples: int, seed: int) -> str:
    """CTEs d (the rows) and w (the rows of every replicate b with their weight; b is -1 and w 1 for the sample itself)."""
    import math

    cuts, total = [], 0.0
    for n in range(8):
        total += math.exp(-1) / math.factorial(n)
        cuts.append(total)
    weight = "case " + " ".join(f"when u < {c!r}::double then {n}e0" for n, c in enumerate(cuts)) + " else 8e0 end"
    u = f"('0x' || substr(md5('{seed}:' || b || ':' || {key}),1,13))::bigint::double/4503599627370496e0"
    return f", d as ({rows}), u as (select d.*, b, {u} as u from d, range({resamples}) t(b)), w as (select * exclude (u), {weight} as w from u union all select *, -1, 1e0 from d)"


_ENDS = """ select grp, round(max(x) filter (b < 0),6) as point, round(quantile_cont(x,0.025) filter (b >= 0),6) as lower, round(quantile_cont(x,0.975) filter (b >= 0),6) as upper from x group by grp"""


@query(ctes("scores") + _weighted_sql("select candidate, candidate % 5 as grp, kg as v from scores where kg is not null", "candidate::varchar", 40, 5)
       + ", x as (select grp, b, sqrt((sum(w*v*v)-power(sum(w*v),2)/sum(w))/(sum(w)-1e0)) as x from w group by grp, b)" + _ENDS)
def bootstrap_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scores").withColumn("grp", F.col("candidate") % 5)
    return tidy(stats.bootstrap_spread(rows, ["grp"], "kg", "candidate", resamples=40, seed=5))


@query(ctes("scores") + _weighted_sql("select candidate, candidate % 5 as grp, least(greatest(floor(dep*64e0),0e0),63e0) as bin from scores where dep is not null", "candidate::varchar", 40, 6)
       + """, h as (select grp, b, bin, sum(w) as n from w group by grp, b, bin having sum(w) > 0),
c as (select *, sum(n) over (partition by grp, b order by bin) as c, sum(n) over (partition by grp, b) as a from h),
x as (select grp, b, min_by((bin+(0.5e0*a-(c-n))/n)/64e0, bin) as x from c where c >= 0.5e0*a group by grp, b)""" + _ENDS)  # fmt: skip
def bootstrap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scores").withColumn("grp", F.col("candidate") % 5)
    return tidy(stats.bootstrap_quantile(rows, ["grp"], "dep", "candidate", bins=64, resamples=40, seed=6))


@query(ctes("scores") + _weighted_sql("select candidate, candidate % 3 as grp, least(floor(kg*50e0),49e0) as bin, vulnerable::int::double as y from scores where kg is not null", "candidate::varchar", 40, 7)
       + """, h as (select grp, b, bin, sum(w*y) as p, sum(w*(1e0-y)) as q from w group by grp, b, bin),
c as (select *, sum(q) over (partition by grp, b order by bin) - q as below from h), x as (select grp, b, sum(p*(below+q/2e0))/nullif(sum(p)*sum(q),0) as x from c group by grp, b)""" + _ENDS)  # fmt: skip
def bootstrap_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scores").withColumn("grp", F.col("candidate") % 3)
    return tidy(stats.bootstrap_area(rows, ["grp"], "kg", "vulnerable", "candidate", bins=50, resamples=40, seed=7))


def _nested_r2_sql(rows: str, by: str, y: str, features: list[str], reduced: int) -> str:
    """CTEs to fit (by, n, red, extra): the R2 of the first features and what the others add, by residuals of each on the
    ones before within the group."""
    over = f"over (partition by {by})"
    out, left = [f", h0 as (select {by}, {y} as y, " + ", ".join(f"{x} as x{i}" for i, x in enumerate(features)) + f" from {rows})"], len(features)
    for i in range(left - 1):
        rest = ", ".join(f"x{j}-coalesce(regr_intercept(x{j},x{i}) {over}+regr_slope(x{j},x{i}) {over}*x{i},0e0) as x{j}" for j in range(i + 1, left))
        kept = ", ".join(f"x{j}" for j in range(i + 1))
        out.append(f"h{i + 1} as (select {by}, y, {kept}, {rest} from h{i})")
    share = [f"case when var_pop(x{i}) > 1e-9 then power(coalesce(corr(y,x{i}),0e0),2) else 0e0 end" for i in range(left)]
    out.append(f"fit as (select {by}, count(*) as n, {'+'.join(share[:reduced])} as red, {'+'.join(share[reduced:])} as extra from h{left - 1} group by {by})")
    return ",\n".join(out)


_TRACED = ["k1+k2+k3", f"({_ABSENT})::double", _FLAGS, f"({_FLAGS} > 0)::int::double"]


@query(O.FOLDED + ", j as (select f3.*, p_brand from f3 join part on p_partkey = candidate)" + _nested_r2_sql("j", "p_brand", "t", _TRACED, 2)
       + " select p_brand, n, round(red,6) as r2_reduced, round(red+extra,6) as r2_full, round(extra/(1e0-red),6) as partial from fit")
def trace_regression_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("candidate"), "p_brand")
    rows = fusion.reports(view(spark, sf_dir, "scores"), RATES, threshold=0.3).join(brands, "candidate")
    return tidy(contrasts.grouped_trace_r2(rows, ["p_brand"]))


_POOLED = ", keep as (select * replace (candidate::varchar || '|' || ((candidate % 2)/10e0)::varchar || '|0.0|' || (candidate % 7)::varchar as candidate) from reports where candidate % 7 < 5)"


@query(O.REPORTS + _POOLED + _nested_r2_sql("(select 1 as one, * from keep)", "one", "t", _TRACED, 2) + ",\nr as (select vulnerable, "
       + ", ".join(f"row_number() over (order by round({c},6) desc nulls last, candidate) as r{i}" for i, c in enumerate(["betp", f"{O._SUMS[0]}/4e0+{O._SUMS[2]}/8e0", *(f"betp_{s}" for s in O.COLUMN.values())]))
       + " from keep), c as (select " + ", ".join(f"count(*) filter (vulnerable and r{i} <= 50)/count(*) filter (vulnerable)::double as c{i}" for i in range(6))
       + """ from r) select n as candidates, 0.3e0 as flag_threshold, round(c0,6) as full_recall, round(c1,6) as naive_recall, round(c0-c1,6) as loss, case when c0 > c1 then 'pass' else 'fail' end as fusion_verdict,
round(red,6) as r2_reduced, round(red+extra,6) as r2_full, round(extra/(1e0-red),6) as partial, case when extra > 0 then 'pass' else 'fail' end as trace_verdict,
round(c2,6) as recall_kg, round(c3,6) as recall_dep, round(c4,6) as recall_flux, round(c5,6) as recall_clin from fit, c""")  # fmt: skip
def pooled_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scores").withColumns({"conflict": (F.col("candidate") % 2) / 10.0, "absent": F.lit(0.0), "seed": F.col("candidate") % 7})
    return tidy(contrasts.pooled_trace_analysis(rows, RATES, k=50, seeds=5, threshold=0.3))


def _battery_sql() -> str:
    """The fifteen cells, each by its own fold."""
    parts, m = [O.FOLDED, O._fold("d", O.ORDER, True)], O.COLUMN
    fold = "t as width, k1+k2+k3 as conflict from f3"
    total, mean = (f"({O._SUMS[0]}+{O._SUMS[2]}/2e0)/" + x for x in (f"({O._SUMS[0]}+{O._SUMS[1]}+{O._SUMS[2]})", "4e0"))
    odds = f"1e0/(1e0+exp(-({O._LOGODDS})))"
    cells = [("full", "full", "conflict-redistributing", "", "v+t/2e0", fold), ("no-verifier (naive average)", "no-verifier", "naive-average", "", mean, fold)]
    for x, c in m.items():
        parts.append(O._fold(f"w{c}", tuple(y for y in O.ORDER if y != x)))
        less = f"t as width, k1+k2 as conflict from w{c}2"
        cells.append((f"remove {x}", "per-modality-removal", "conflict-redistributing", x, "v+t/2e0", less))
        cells.append((f"single-agent ({x})", "single-agent", "conflict-redistributing", "", f"{c}_dv+{c}_dt/2e0", fold))
        if x == "KG":
            cells.append(("no-knowledge-graph", "no-knowledge-graph", "conflict-redistributing", "", "v+t/2e0", less))
    cells.append(("substitution: dempster-renormalised", "full", "dempster-renormalised", "", "v+t/2e0", "t as width, k1+k2+k3 as conflict from d3"))
    cells += [(f"substitution: {n}", "full", n, "", e, fold) for n, e in (("naive-sum", total), ("naive-average", mean), ("bayesian-log-odds", odds))]
    rows = "\nunion all ".join(f"select '{a}' as label, '{b}' as level, '{r}' as rule, '{x}' as removed, candidate, vulnerable, {e} as score, {rest}" for a, b, r, x, e, rest in cells)
    return ",\n".join(parts) + f""", cells as ({rows}), ranked as (select *, row_number() over (partition by label order by round(score,6) desc, candidate) as r from cells)
select label, level, rule, removed, round(count(*) filter (vulnerable and r <= 50)/count(*) filter (vulnerable)::double,6) as recall, round(avg(score),6) as mean_score, round(avg(width),6) as mean_width, round(avg(conflict),6) as mean_conflict, count(*) as n
from ranked group by label, level, rule, removed"""


@query(_battery_sql())
def ablation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fusion.evaluate_battery(view(spark, sf_dir, "scores"), RATES, k=50))


@query("""with recursive t as (select 'C' || c_custkey as alias, 'C' || (c_custkey // 2) as symbol from customer where c_custkey % 3 <> 0
  union select 'C' || c_custkey, 'C' || (c_custkey // 5) from customer where c_custkey % 35 = 0),
e as (select alias as a, symbol as b from t union select symbol, alias from t),
reach as (select a as n, a as o from e union select n, b from reach join e on e.a = reach.o),
c as (select n, min(o) as component from reach group by n), s as (select *, n not in (select alias from t where alias <> symbol) as official from c),
f as (select component, min(n) filter (official) as first, count(*) filter (official) as symbols from s group by component)
select n as name, coalesce(first, component) as canonical, symbols, symbols > 1 as clash from s join f using (component)""")
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    first = customers.where(key % 3 != 0).select(name(key).alias("alias"), name(F.floor(key / 2)).alias("symbol"))
    return aliases.closure(first.unionByName(customers.where(key % 35 == 0).select(name(key).alias("alias"), name(F.floor(key / 5)).alias("symbol"))))


#: A test a supplier: whether its mean quantity is far from all lines' mean, by Cantelli's bound on one side.
_TESTS = """with g as (select avg(l_quantity + 0e0) as m, var_pop(l_quantity + 0e0) as v from lineitem),
t as (select 'S' || l_suppkey as name, round(1e0/(1e0+count(*)*power(avg(l_quantity + 0e0)-max(m),2)/max(v)),9) as p from lineitem, g group by l_suppkey)"""


def _supplier_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), (F.col("l_quantity") + 0.0).alias("q"))
    rows = lines.groupBy("name").agg(F.count("*").alias("n"), F.avg("q").alias("m")).crossJoin(F.broadcast(lines.agg(F.avg("q").alias("mean"), F.var_pop("q").alias("var"))))  # one row
    return rows.select("name", F.round(1.0 / (1.0 + F.col("n") * (F.col("m") - F.col("mean")) ** 2 / F.col("var")), 9).alias("p"))


@query(_TESTS + """, r as (select *, least(1e0,(count(*) over ()-row_number() over (order by p,name)+1)*p) as a from t), m as (select name, p, max(a) over (order by p,name) as adjusted from r)
select name, round(p,6) as p, round(adjusted,6) as adjusted, adjusted <= 0.05e0 as rejected from m""")
def supplier_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.holm(_supplier_tests(spark, sf_dir)))


@query(_TESTS + """, r as (select *, least(1e0,p*count(*) over ()/row_number() over (order by p,name)) as a from t), m as (select name, p, min(a) over (order by p desc,name desc) as adjusted from r)
select name, round(p,6) as p, round(adjusted,6) as adjusted, adjusted <= 0.05e0 as rejected from m""")
def supplier_false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.benjamini_hochberg(_supplier_tests(spark, sf_dir)))


@query(O._AUDIT + """, s as (select count(*) as candidates, sum(cited) as cited, sum(grounded) as grounded from a)
select candidates, cited::bigint as cited, grounded::bigint as grounded, round(grounded/cited::double,6) as grounded_rate, round(1e0-grounded/cited::double,6) as hallucinated_rate,
(select count(*) from citations where in_ledger and value is not null and key is not null and candidate is not null) as complete_entries from s""")
def provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "citations")
    entries = rows.select("key", "candidate", F.when(F.col("in_ledger"), F.col("value")).alias("value"))
    return tidy(metrics.provenance_summary(metrics.audit_citations(rows.select("candidate", "key"), rows.where("in_ledger").select("key")), entries, ["key", "candidate", "value"]))


@query(ctes("scores") + " union all ".join(f" select '{m}' as modality, count(*) filter ({c} >= 0.5) as supporting, count(*) filter ({c} < 0.5) as opposing, count(*) filter ({c} is null) as absent from scores" for m, c in O.COLUMN.items()))
def modality_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.support_counts(view(spark, sf_dir, "scores"))
