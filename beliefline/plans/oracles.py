"""Independent SQL (DuckDB) for the queries; the views come first, then a statement that knows nothing of the library."""

from __future__ import annotations

from .fixtures import ctes

RATES = {"KG": 0.86, "DEP": 0.91, "FLUX": 0.74, "CLIN": 0.66}
GATES = {"KG": 0.88, "DEP": 0.92, "FLUX": 0.80, "CLIN": 0.72}
ORDER = ("DEP", "KG", "FLUX", "CLIN")
COLUMN = {"KG": "kg", "DEP": "dep", "FLUX": "flux", "CLIN": "clin"}


def _raw(m: str) -> str:
    s = COLUMN[m]
    p = f"(1e0/(1e0+exp(-(6e0*least(greatest({s},0e0),1e0)-3e0))))"
    g = GATES[m]
    return f"case when {s} is null then 0e0 else {g}*{p} end as {s}_v, case when {s} is null then 0e0 else {g}*(1e0-{p}) end as {s}_n, case when {s} is null then 1e0 else 1e0-{g} end as {s}_t"


def _discounted(m: str) -> str:
    s, a = COLUMN[m], RATES[m]
    return f"{a}*{s}_v as {s}_dv, {a}*{s}_n as {s}_dn, 1e0-{a}+{a}*{s}_t as {s}_dt"


MASSES = (
    ctes("scores")
    + ",\nraw as (select *, " + ", ".join(_raw(m) for m in RATES) + " from scores)"
    + ",\nmasses as (select *, " + ", ".join(_discounted(m) for m in RATES) + " from raw)"
)


def _fold(name: str, order: tuple[str, ...], dempster: bool = False) -> str:
    """CTEs f0 .. fk that combine one modality after the other."""
    first = COLUMN[order[0]]
    out = [f"{name}0 as (select *, {first}_dv as v, {first}_dn as n, {first}_dt as t from masses)"]
    for i, m in enumerate(order[1:], 1):
        s = COLUMN[m]
        v, n, t, k = f"v*{s}_dv+v*{s}_dt+t*{s}_dv", f"n*{s}_dn+n*{s}_dt+t*{s}_dn", f"t*{s}_dt", f"(v*{s}_dn+n*{s}_dv)"
        if dempster:
            out.append(f"{name}{i} as (select * replace (({v})/(1e0-{k}) as v, ({n})/(1e0-{k}) as n, ({t})/(1e0-{k}) as t), {k} as k{i} from {name}{i-1})")
        else:
            out.append(f"{name}{i} as (select * replace ({v} as v, {n} as n, {t}+{k} as t), {k} as k{i} from {name}{i-1})")
    return ",\n".join(out)


FOLDED = MASSES + ",\n" + _fold("f", ORDER)
REPORTS = FOLDED + ",\nreports as (select *, v as bel, v+t as pl, v+t/2e0 as betp, t as width, k1+k2+k3 as total_conflict, " + ", ".join(f"{s}_dv+{s}_dt/2e0 as betp_{s}" for s in COLUMN.values()) + " from f3)"
SCORED = REPORTS + ",\nscored as (select candidate, round(betp,6) as score, vulnerable, row_number() over (order by round(betp,6) desc, candidate) as rank from reports)"

BELIEF_RANK = REPORTS + """
select candidate, round(bel,6) as bel, round(pl,6) as pl, round(betp,6) as betp, round(width,6) as width, round(total_conflict,6) as total_conflict,
       row_number() over (order by round(betp,6) desc, candidate) as rank from reports"""

_LONG = MASSES + ",\nlong as (" + "\nunion all\n".join(
    f"select candidate, vulnerable, '{m}' as modality, {i} as ordinal, {s} as score, {s}_v as v, {s}_n as n, {s}_t as theta, {s}_dv as dv, {s}_dn as dn, {s}_dt as dtheta, {s}_dv+{s}_dt/2e0 as betp, {s} is not null as available from masses"
    for i, (m, s) in enumerate(COLUMN.items())) + ")"
MASS_MAP = _LONG + " select candidate, modality, round(score,6) as score, round(v,6) as v, round(theta,6) as theta, round(dv,6) as dv, round(dn,6) as dn, round(dtheta,6) as dtheta, round(betp,6) as betp, available from long"
UNDISCOUNT = _LONG + " select candidate, modality, round(v,6) as v, round(n,6) as n, round(theta,6) as theta, true as valid, score is null as vacuous from long"
PAIR = MASSES + """
select candidate as id, round(dep_dv*kg_dv+dep_dv*kg_dt+dep_dt*kg_dv,6) as v, round(dep_dn*kg_dn+dep_dn*kg_dt+dep_dt*kg_dn,6) as n,
       round(dep_dt*kg_dt+dep_dv*kg_dn+dep_dn*kg_dv,6) as theta, round(dep_dv*kg_dn+dep_dn*kg_dv,6) as k from masses"""
_SUMS = "(kg_dv+dep_dv+flux_dv+clin_dv)", "(kg_dn+dep_dn+flux_dn+clin_dn)", "(kg_dt+dep_dt+flux_dt+clin_dt)"
_LOGODDS = "+".join(f"ln(({s}_dv+{s}_dt/2e0)/(1e0-({s}_dv+{s}_dt/2e0)))" for s in COLUMN.values())
ALTERNATIVES = MASSES + ",\n" + _fold("d", ORDER, True) + f"""
select candidate, round({_SUMS[0]}/4e0,6) as avg_v, round({_SUMS[2]}/4e0,6) as avg_theta,
       round(({_SUMS[0]}+{_SUMS[2]}/2e0)/({_SUMS[0]}+{_SUMS[1]}+{_SUMS[2]}),6) as norm_betp,
       round(v+t/2e0,6) as dempster_betp, round(t,6) as dempster_width, round(k1+k2+k3,6) as dempster_conflict,
       round(1e0/(1e0+exp(-({_LOGODDS}))),6) as log_odds from d3"""
TRACE = FOLDED + """
select candidate, 3::int as steps, ((k1>=0.05)::int+(k2>=0.05)::int+(k3>=0.05)::int)::int as flagged_steps, round(k1+k2+k3,6) as total_conflict,
       round(greatest(k1,k2,k3),6) as dominant_k, (case when k1>=k2 and k1>=k3 then 1 when k2>=k3 then 2 else 3 end)::int as dominant_step from f3"""
TRACE_ROWS = FOLDED + """
select candidate, 1::bigint as step, 'DEP+KG' as pair, round(k1,6) as k_mass from f3
union all select candidate, 2::bigint, 'DEP|KG+FLUX', round(k2,6) from f3 union all select candidate, 3::bigint, 'DEP|KG|FLUX+CLIN', round(k3,6) from f3"""
VIOLATIONS = "select 0::bigint as violations"


def _ablation() -> str:
    parts = [FOLDED, _fold("d", ORDER, True)]
    cells = [
        "select 'full' as label, v+t/2e0 as score, t as width, k1+k2+k3 as conflict from f3",
        f"select 'average', {_SUMS[0]}/4e0+{_SUMS[2]}/8e0, {_SUMS[2]}/4e0, 0e0 from masses",
        "select 'dempster', v+t/2e0, t, k1+k2+k3 from d3",
        f"select 'log_odds', 1e0/(1e0+exp(-({_LOGODDS}))), 0e0, 0e0 from masses",
    ]
    for m, s in COLUMN.items():
        rest = tuple(x for x in ORDER if x != m)
        parts.append(_fold(f"w{s}", rest))
        cells.append(f"select 'without_{s}', v+t/2e0, t, k1+k2 from w{s}2")
        cells.append(f"select 'single_{s}', {s}_dv+{s}_dt/2e0, {s}_dt, 0e0 from masses")
    return ",\n".join(parts) + ",\ncells as (" + "\nunion all\n".join(cells) + ")\nselect label, round(avg(score),6) as mean_score, round(avg(width),6) as mean_width, round(avg(conflict),6) as mean_conflict, count(*) as n from cells group by label"


ABLATION = _ablation()
OPERATORS = _LONG + """, xs as (
  select candidate, avg(betp) as mean, max(betp) as top, min(betp) as low, sum(betp) as total, median(betp) as med, exp(avg(ln(greatest(betp,1e-6)))) as prod,
         stddev_pop(betp) as sd, list_sort(list(betp)) as l from long group by candidate)
select candidate, round(mean,6) as mean, round(top,6) as max, round(low,6) as min, round(med,6) as median, round(prod,6) as product, 2.5e0 as rank_mean,
       round(0.6e0*top+0.4e0*(total-top)/3e0,6) as tournament, round(0.6e0*low+0.4e0*(total-low)/3e0,6) as reviewer,
       round((top+l[3])/2e0*(1e0-sd/2e0),6) as dual_mode, round(mean*(1e0-low),6) as provenance_gated from xs"""
RANKING = SCORED + """, h as (select *, sum(vulnerable::int) over (order by rank) as hits from scored)
select round(sum((rank<=50 and vulnerable)::int)/sum(vulnerable::int)::double,6) as recall_at_k, round(sum((rank<=50 and vulnerable)::int)/50e0,6) as precision_at_k,
       round(1e0/min(rank) filter (vulnerable),6) as mrr, round(sum(hits/rank::double) filter (vulnerable)/sum(vulnerable::int),6) as average_precision from h"""
RECALL_CURVE = SCORED + """
select c::bigint as cutoff, round(sum((rank<=c and vulnerable)::int)/sum(vulnerable::int)::double,6) as recall from scored, (select unnest([10,45,100,500]) as c) group by c"""
TOP = SCORED + " select candidate, score from scored where rank <= 25"
BEST = _LONG + """, r as (select *, row_number() over (partition by modality order by round(betp,6) desc, candidate) as rank from long),
m as (select modality, ordinal, sum((rank<=100 and vulnerable)::int)/sum(vulnerable::int)::double as recall from r group by modality, ordinal)
select modality, round(recall,6) as recall, row_number() over (order by recall desc, ordinal) = 1 as best from m"""
SEPARABILITY = REPORTS + """, x as (select round(-width,6) as w, round(greatest(betp_kg,betp_dep,betp_flux,betp_clin)-least(betp_kg,betp_dep,betp_flux,betp_clin),6) <= 0.45 as c from reports)
select round(sum(case when a.w > b.w then 1e0 when a.w = b.w then 0.5e0 else 0e0 end)/count(*),6) as auroc from x a, x b where a.c and not b.c"""
MIDRANK = ctes("scores") + " select candidate, kg, rank() over (order by kg) + (count(*) over (partition by kg) - 1)/2e0 as midrank from scores"
SCALED = ctes("scores") + """
select candidate, round(kg,6) as kg, round((kg-min(kg) over ())/(max(kg) over ()-min(kg) over ()),6) as min_max, round((kg-avg(kg) over ())/stddev_pop(kg) over (),6) as zscore,
       round(exp((kg-max(kg) over ())/0.5e0)/(select sum(exp((kg-(select max(kg) from scores))/0.5e0)) from scores),6) as softmax from scores"""
_SCORES_LONG = ctes("scores") + ", long as (" + " union all ".join(f"select candidate, '{m}' as modality, least(greatest({s},0e0),1e0) as s, vulnerable::int::double as y from scores where {s} is not null" for m, s in COLUMN.items()) + ")"
_LOSS = "avg(power({r}*s+(1e0-{r})/2e0-y,2))"
RATES_SQL = _SCORES_LONG + """, i as (select modality, least(greatest(-sum((s-0.5e0)*(0.5e0-y))/sum((s-0.5e0)*(s-0.5e0)),0e0),1e0) as r from long group by modality)
select modality, round(max(r),6) as rate, round(avg(power(r*s+(1e0-r)/2e0-y,2)),6) as loss, count(*) as n from long join i using (modality) group by modality"""
FOLDS = _SCORES_LONG + """, k as (select -1 as fold union all select unnest(range(0,5))::int), t as (select k.fold, l.* from k, long l where k.fold < 0 or l.candidate % 5 <> k.fold),
i as (select fold, modality, least(greatest(-sum((s-0.5e0)*(0.5e0-y))/sum((s-0.5e0)*(s-0.5e0)),0e0),1e0) as r from t group by fold, modality)
select fold::int as fold, modality, round(max(r),6) as rate, round(avg(power(r*s+(1e0-r)/2e0-y,2)),6) as loss, count(*) as n from t join i using (fold, modality) group by fold, modality"""

_EXCLUDED = "case when not rna_yield_ok then 'insufficient_rna' when not outcome_ascertained then 'outcome_missing' end"
_C = "count(*) as n, count(*) filter (x is null) as retained, round(avg(case when x is null then pcr::int::double end),6) as pcr_rate"
CENSUS = ctes("records") + f""", r as (select *, {_EXCLUDED} as x from records)
select 'arm' as dimension, arm as value, {_C} from r group by arm union all select 'site', site, {_C} from r group by site
union all select 'exclusion', coalesce(x,'none'), {_C} from r group by coalesce(x,'none') union all select 'all', 'all', {_C} from r"""
EXCLUSIONS = ctes("records") + f" select record_id, {_EXCLUDED} as exclusion, pcr::int as label from records"
ASSOCIATION = ctes("records", "expression") + """, j as (select e.gene, e.value, r.pcr::int::double as y from expression e join records r using (record_id) where r.rna_yield_ok and r.outcome_ascertained and r.pcr is not null)
select gene, count(*) as pairs, round(corr(value,y),6) as r, round(case when count(*) >= 12 then least(abs(corr(value,y))/0.6e0,1e0) end,6) as strength from j group by gene"""
GRAPH_CENSUS = ctes("edges") + " select 'relation' as dimension, relation as value, count(*) as n from edges group by relation union all select 'source_db', source_db, count(*) from edges group by source_db"
CUTOFF = ctes("edges") + """ select source_db, count(*) as "all", count(*) filter (release_date <= '2024-06-30') as kept from edges group by source_db"""
DEDUP = ctes("edges") + " select src, dst, relation, seq from edges"
HOLDOUT = ctes("edges") + " select relation, count(*) as n from edges where not (src = 'N:2' and dst = 'R:2') group by relation"
INDUCED = ctes("edges") + """, k as (select src as key from edges where relation = 'reaction_enzyme' and weight > 0.95 union select dst from edges where relation = 'reaction_enzyme' and weight > 0.95)
select src, dst, relation from edges where src in (select key from k) and dst in (select key from k)"""
_BFS = ctes("edges") + """, walk as (
  select 'P:' || p_partkey as source, 'P:' || p_partkey as node, 0 as depth from part
  union select w.source, e.dst, w.depth + 1 from walk w join edges e on e.src = w.node where w.depth < 3)"""
BFS = _BFS + " select source, node, min(depth)::int as depth from walk group by source, node"
_PATHS = ctes("edges") + """, grow as (
  select 'P:' || p_partkey as source, ['P:' || p_partkey] as nodes, []::varchar[] as rels, 1e0 as w, 0 as hops from part
  union all
  select g.source, list_append(g.nodes, e.dst), list_append(g.rels, e.relation), g.w * greatest(e.weight,0e0), g.hops + 1
  from grow g join edges e on e.src = g.nodes[-1] where g.hops < 3 and g.nodes[-1] <> 'R:2' and not list_contains(g.nodes, e.dst)),
paths as (select * from grow where nodes[-1] = 'R:2')"""
PATHS = _PATHS + " select source, hops::int as hops, array_to_string(nodes,'>') as path, array_to_string(rels,'>') as relations from paths"
SUPPORT = _PATHS + """, m as (select source, count(*) as paths, sum(power(0.55e0,hops)*w) as m, bool_or(hops = 1) as direct from paths group by source),
h as (select source, count(distinct n) as hits from (select source, unnest(nodes) as n from paths) where n like 'T:%' group by source)
select source, paths, coalesce(hits,0) as hits, direct, round(least(greatest(0.6e0*least(1e0,coalesce(hits,0)/4e0)+0.4e0*m/(1e0+m),0e0),1e0),6) as support from m left join h using (source)"""
PATHWAY = ctes("edges") + """, f as (select src, arg_min(dst, seq) as pathway from edges where relation = 'gene_pathway_membership' group by src),
e as (select dst as reaction, arg_min(src, seq) as enzyme from edges where relation = 'reaction_enzyme' group by dst)
select coalesce(f.src, e.reaction) as reaction, coalesce(f.pathway, g.pathway) as pathway from f full join (e left join f g on g.src = e.enzyme) on f.src = e.reaction"""

_EDGES = "[0.1,0.2,0.30000000000000004,0.4,0.5,0.6000000000000001,0.7000000000000001,0.8,0.9]"
_BINNED = ctes("predictions") + f", b as (select *, len(list_filter({_EDGES}, lambda e: e <= p))::int as bin from predictions)"
CALIBRATION = _BINNED + """, g as (select count(*) as n, abs(avg(p)-avg(y)) as gap from b group by bin)
select round(avg(power(p-y,2)),6) as brier, round((select sum(n*gap)/sum(n) from g),6) as ece, count(*) as n, round(avg(p),6) as mean_p, round(avg(y),6) as base_rate, round(avg(p)-avg(y),6) as overconfidence from b"""
RELIABILITY = _BINNED + " select bin, count(*) as n, round(avg(p),6) as mean_p, round(avg(y),6) as mean_y, round(abs(avg(p)-avg(y)),6) as gap from b group by bin"
COCHRAN = ctes("predictions") + """, e as (select grp, avg(y) as effect, var_samp(y)/count(*) as variance from predictions group by grp having var_samp(y) > 0),
p as (select sum(effect/variance)/sum(1e0/variance) as m from e), q as (select sum(power(effect-m,2)/variance) as q, count(*) as n, max(effect)-min(effect) as gap, max(m) as m from e, p)
select round(m,5) as pooled, round(q,5) as q, round(case when q <= 0 then 0e0 else greatest((q-(n-1))/q,0e0) end,5) as i2, (case when q <= 0 then 0e0 else greatest((q-(n-1))/q,0e0) end) > 0.5 as heterogeneous, round(gap,5) as max_gap from q"""
ROC = ctes("predictions") + """, r as (select p, y > 0 as l from predictions),
k as (select l, rank() over (order by p) + (count(*) over (partition by p) - 1)/2e0 as overall, rank() over (partition by l order by p) + (count(*) over (partition by l, p) - 1)/2e0 as own from r),
n as (select count(*) filter (l) as p, count(*) filter (not l) as q from r), v as (select l, case when l then (overall-own)/q else 1e0-(overall-own)/p end as v from k, n)
select round(avg(v) filter (l),9) as auc, round(var_samp(v) filter (l)/count(*) filter (l)+var_samp(v) filter (not l)/count(*) filter (not l),9) as variance, count(*) filter (l) as positives, count(*) filter (not l) as negatives from v"""
PAIRED_ROC = ctes("scores") + """, c as (select a.candidate as i, b.candidate as j, case when a.kg > b.kg then 1e0 when a.kg = b.kg then 0.5e0 else 0e0 end as s, case when a.dep > b.dep then 1e0 when a.dep = b.dep then 0.5e0 else 0e0 end as t from scores a, scores b where a.vulnerable and not b.vulnerable),
x as (select i, avg(s) as s, avg(t) as t from c group by i), z as (select j, avg(s) as s, avg(t) as t from c group by j),
o as (select (select avg(s) from x) as a, (select avg(t) from x) as b, (select var_samp(s-t)/count(*) from x)+(select var_samp(s-t)/count(*) from z) as v)
select round(a,6) as first_auc, round(b,6) as second_auc, round(a-b,6) as difference, round(v,6) as variance, round((a-b)/sqrt(v),6) as z from o"""
_T = "t(name,p) as (values ('t0',0.001e0),('t1',0.01e0),('t2',0.02e0),('t3',0.2e0),('t4',0.5e0),('t5',0.04e0),('t6',0.049e0))"
HOLM = f"with {_T}, r as (select *, least(1e0,(count(*) over ()-row_number() over (order by p,name)+1)*p) as a from t), m as (select name, p, max(a) over (order by p,name) as adjusted from r) select name, round(p,6) as p, round(adjusted,6) as adjusted, adjusted <= 0.05e0 as rejected from m"
BH = f"with {_T}, r as (select *, least(1e0,p*count(*) over ()/row_number() over (order by p,name)) as a from t), m as (select name, p, min(a) over (order by p desc,name desc) as adjusted from r) select name, round(p,6) as p, round(adjusted,6) as adjusted, adjusted <= 0.05e0 as rejected from m"
CONCORDANCE = ctes("survival") + """
select round(sum(case when a.user_id % 7 > b.user_id % 7 then 1e0 when a.user_id % 7 = b.user_id % 7 then 0.5e0 else 0e0 end)/count(*),6) as concordance, count(*) as pairs
from survival a join survival b on a.event_type = 1 and a.time < b.time"""
INCIDENCE = ctes("survival") + """, b as (select time, count(*) as n, count(*) filter (event_type = 1) as d, count(*) filter (event_type > 0) as a from survival group by time),
r as (select *, sum(n) over (order by time desc) as risk from b), s as (select *, a/risk::double as h from r),
l as (select *, coalesce(product(1e0-h) over (order by time rows between unbounded preceding and 1 preceding),1e0) as before from s)
select time::bigint as time, risk::bigint as at_risk, round(before*(1e0-h),6) as survival, round(sum(before*d/risk::double) over (order by time),6) as incidence from l"""
COX = ctes("survival") + """, x as (select time, stratum, event_type = 1 as e, (user_id % 5)/5e0 as x, exp(0.3e0*((user_id % 5)/5e0)) as w from survival),
g as (select a.x, sum(b.w) as s0, sum(b.w*b.x) as s1, sum(b.w*b.x*b.x) as s2, any_value(a.rid) as rid from (select *, row_number() over () as rid from x) a join x b on a.stratum = b.stratum and b.time >= a.time where a.e group by a.rid, a.x)
select round(sum(0.3e0*x-ln(s0)),6) as loglik, round(sum(x-s1/s0),6) as g0, round(sum(s2/s0-power(s1/s0,2)),6) as h0_0 from g"""
KAPPA = ctes("readers") + """, s as (select avg((arm = agree)::int) as po, avg(arm) as a, avg(agree) as b from readers) select round((po-(a*b+(1-a)*(1-b)))/(1-(a*b+(1-a)*(1-b))),6) as kappa from s"""
CLUSTERS = ctes("readers") + """, x as (select row_number() over () as id, reader, agree-0.5e0 as r from readers)
select count(*)::bigint as pairs, round(sum(a.r*b.r),6) as cross from x a join x b on a.reader = b.reader and a.id <> b.id"""
_AUDIT = ctes("citations") + ", a as (select candidate, count(*) as cited, count(*) filter (in_ledger) as grounded from citations group by candidate)"
GROUNDING = _AUDIT + " select round(sum(grounded)/sum(cited)::double,6) as grounding_rate, round(1e0-sum(grounded)/sum(cited)::double,6) as hallucinated_rate, count(*) as candidates from a"
AUDIT = _AUDIT + " select candidate, cited, grounded from a"
COMPLETENESS = ctes("citations") + " select 'value' as field, count(*) filter (not in_ledger or value is null) as missing from citations"
LATEST = ctes("citations") + " select concat_ws('|', candidate::varchar, event_type) as key, max(event_id) as event_id, round(arg_max(value, event_id),6) as value from citations group by 1"
CONTRASTS = """with r as (select o_orderpriority as level, year(o_orderdate) as seed, avg(o_totalprice) as value from orders group by 1,2),
l as (select level, avg(value) as mean, coalesce(stddev_samp(value),0e0) as sd, count(*) as n from r group by level), p as (select *, lag(mean) over (order by level) as previous from l)
select level, round(mean,4) as mean, round(sd,4) as sd, n, round(previous,4) as previous, coalesce(mean >= previous-1e-12, true) as non_decreasing from p"""
SIZING = """with g as (select n, c from range(20,20001,2) r(n), (select unnest([0.3e0,0.4e0,0.5e0]) as c)),
v as (select n, c, n*0.25e0 as p, n*0.75e0 as q, 0.70e0 as a, 0.781e0 as b from g),
h as (select *, (a*(1-a)+(p-1)*(a/(2-a)-a*a)+(q-1)*(2*a*a/(1+a)-a*a))/(p*q) as va, (b*(1-b)+(p-1)*(b/(2-b)-b*b)+(q-1)*(2*b*b/(1+b)-b*b))/(p*q) as vb from v)
select c as correlation, min(n) filter (0.081e0/sqrt(va+vb-2*c*sqrt(va*vb)) >= 1.959963984540054e0+0.8416212335729143e0) as records from h group by c"""
SEEDS = "select n_name, (('0x' || substr(sha256(n_name),1,16))::ubigint % 2147483647)::bigint as seed, n_name || '|agent|' || n_regionkey::varchar as key from nation"


def _discovery() -> str:
    support = SUPPORT[: SUPPORT.rindex("\nselect")] + ", sup as (" + SUPPORT[SUPPORT.rindex("\nselect") :].replace("round(least", "(least").replace(",6) as support", ") as support") + ")"
    scores = """, base as (select 'P:' || p_partkey as candidate from part),
dep0 as (select 'P:' || l_partkey as candidate, -avg(l_quantity)/50 as effect, case when count(*) >= 28 then -avg(l_discount+0e0)*10 end as response, avg(l_tax+0e0)*10 as fx from lineitem group by l_partkey),
dscored as (select candidate, fx, least(greatest((-0.1e0-effect)/1.2e0,0e0),1e0) as b, least(greatest(-0.2e0-response,0e0),1e0) as r, response from dep0),
scores as (select b.candidate, s.support as kg, case when d.response is null then d.b else 0.6e0*d.b+0.4e0*d.r end as dep, d.fx as flux, null::double as clin, false as vulnerable
           from base b left join sup s on s.source = b.candidate left join dscored d on d.candidate = b.candidate)"""
    rest = REPORTS[REPORTS.index(",\nraw as") :]
    return support + scores + rest + "\nselect candidate, round(kg,6) as kg, round(dep,6) as dep, round(flux,6) as flux, round(betp,6) as betp, round(width,6) as width, round(total_conflict,6) as total_conflict from reports"


DISCOVERY = _discovery()


def _cox_fit(steps: int = 10) -> str:
    """Newton's steps for both causes, a CTE each. The covariate has five values, so a risk set is five counts."""
    out = [ctes("survival") + """, x as (select time, stratum, event_type, (user_id % 5)/5e0 as x from survival),
cause as (select 'interest' as cause, 1 as k union all select 'competing', 2),
d as (select cause, stratum, time, count(*) as d, sum(x) as sx from x join cause on event_type = k group by cause, stratum, time),
g as (select stratum, time, x, count(*) as n from x group by stratum, time, x),
r as (select cause, d.stratum, d.time, d, sx, x, sum(n) as n from d join g on g.stratum = d.stratum and g.time >= d.time group by cause, d.stratum, d.time, d, sx, x),
b0 as (select cause, 0e0 as b from cause)"""]
    for i in range(steps + 1):
        out.append(f"m{i} as (select cause, b, d, sx, sum(n*exp(b*x)) as w0, sum(n*x*exp(b*x)) as w1, sum(n*x*x*exp(b*x)) as w2 from r join b{i} using (cause) group by cause, b, stratum, time, d, sx)")
        out.append(f"t{i} as (select cause, b, sum(b*sx-d*ln(w0)) as loglik, sum(sx-d*w1/w0) as u, sum(d*(w2/w0-power(w1/w0,2))) as h from m{i} group by cause, b)")
        out.append(f"b{i + 1} as (select cause, b+u/h as b from t{i})")
    return ",\n".join(out[:-1]) + f"\nselect cause, round(b,6) as coefficient, round(1e0/sqrt(h),6) as error, round(loglik,6) as loglik from t{steps}"


def _gee_fit(steps: int = 15) -> str:
    """Scoring steps of the logistic fit with one correlation, two CTEs each. The arm is 0 or 1, so a reader is four counts."""
    out = [ctes("readers") + """, k as (select reader, (count(*) filter (arm = 0))::double as n0, (count(*) filter (arm = 1))::double as n1,
  (count(*) filter (arm = 0 and agree = 1))::double as y0, (count(*) filter (arm = 1 and agree = 1))::double as y1 from readers group by reader),
s0 as (select 0e0 as b0, 0e0 as b1, 0e0 as rho)"""]
    for i in range(1, steps + 1):
        out.append(f"p{i} as (select k.*, s.*, 1e0/(1e0+exp(-b0)) as u, 1e0/(1e0+exp(-b0-b1)) as w, n0+n1 as m from k, s{i - 1} s)")
        out.append(f"""c{i} as (select *, rho/(1e0+(m-1e0)*rho) as f, (y0-n0*u)/sqrt(u*(1e0-u))+(y1-n1*w)/sqrt(w*(1e0-w)) as e,
  (y0*power(1e0-u,2)+(n0-y0)*u*u)/(u*(1e0-u))+(y1*power(1e0-w,2)+(n1-y1)*w*w)/(w*(1e0-w)) as ee,
  n0*sqrt(u*(1e0-u))+n1*sqrt(w*(1e0-w)) as x0, n1*sqrt(w*(1e0-w)) as x1, y0-n0*u+y1-n1*w as r0, y1-n1*w as r1, n0*u*(1e0-u)+n1*w*(1e0-w) as v0, n1*w*(1e0-w) as v1 from p{i})""")
        out.append(f"""t{i} as (select b0, b1, sum(r0-f*x0*e)/(1e0-rho) as g0, sum(r1-f*x1*e)/(1e0-rho) as g1, sum(v0-f*x0*x0)/(1e0-rho) as h00, sum(v1-f*x0*x1)/(1e0-rho) as h01, sum(v1-f*x1*x1)/(1e0-rho) as h11,
  sum(r0*r0) as q00, sum(r0*r1) as q01, sum(r1*r1) as q11, sum(e*e-ee)/sum(m*(m-1e0))/(sum(ee)/(sum(m)-2e0)) as rho from c{i} group by b0, b1, rho)""")
        out.append(f"s{i} as (select b0+(h11*g0-h01*g1)/(h00*h11-h01*h01) as b0, b1+(h00*g1-h01*g0)/(h00*h11-h01*h01) as b1, least(greatest(rho,0e0),0.95e0) as rho from t{i})")
    rows = [
        ("intercept", "b0", "h11*h11*q00-2e0*h11*h01*q01+h01*h01*q11"),
        ("arm", "b1", "h01*h01*q00-2e0*h00*h01*q01+h00*h00*q11"),
    ]
    return ",\n".join(out) + "\n" + " union all ".join(f"select '{n}' as name, round(s.{b},6) as coefficient, round(sqrt({v})/(h00*h11-h01*h01),6) as error, round(s.rho,6) as correlation from s{steps} s, t{steps} t" for n, b, v in rows)


COX_FIT, GEE_FIT = _cox_fit(), _gee_fit()
