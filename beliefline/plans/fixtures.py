"""Views that bind the operators to the warehouse tables; their text runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "scores": """
select p.p_partkey as candidate, cast(p.p_size as double) / 50e0 as kg,
       least(greatest(avg(l.l_discount + 0e0) * 10e0, 0e0), 1e0) as dep,
       case when p.p_partkey % 4 = 3 then null else avg(l.l_quantity) / 50e0 end as flux,
       case when count(*) < 25 then null else avg(case when l.l_returnflag = 'R' then 1e0 else 0e0 end) end as clin,
       p.p_partkey % 20 < 3 as vulnerable
from part p join lineitem l on l.l_partkey = p.p_partkey group by p.p_partkey, p.p_size""",
    "records": """
select o.o_orderkey as record_id,
       case n.n_regionkey % 3 when 0 then 'Site A' when 1 then 'Site B' else 'Site C' end as site,
       case when o.o_orderdate < timestamp '2000-01-01 00:00:00' then 'retrospective' else 'prospective' end as arm,
       o.o_orderkey % 17 <> 0 as rna_yield_ok, o.o_orderkey % 31 <> 0 as outcome_ascertained,
       case when o.o_orderkey % 31 <> 0 then o.o_orderstatus = 'F' end as pcr
from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey""",
    "expression": """
select l.l_orderkey as record_id, p.p_brand as gene, avg(l.l_extendedprice / l.l_quantity) as value
from lineitem l join part p on p.p_partkey = l.l_partkey group by l.l_orderkey, p.p_brand""",
    "edges": """
select concat_ws('>', src, dst, relation) as seq, * from (
select concat('P:', p_partkey) as src, concat('T:', p_type) as dst, 'gene_pathway_membership' as relation,
       '2024-12-31' as release_date, 1e0 as weight, 'part' as source_db from part
union all
select concat('P:', l_partkey), concat('S:', l_suppkey), 'reaction_enzyme',
       substr(cast(min(l_shipdate) as varchar(30)), 1, 10), 1e0 - avg(l_discount + 0e0), 'lineitem'
from lineitem group by l_partkey, l_suppkey
union all
select concat('S:', s_suppkey), concat('N:', s_nationkey), 'metabolic_reaction', '2023-06-30', 1e0, 'supplier' from supplier
union all
select concat('N:', n_nationkey), concat('R:', n_regionkey), 'gene_disease_association', '2024-05-31', 8e-1, 'nation' from nation
union all
select distinct concat('T:', p_type), 'R:2', 'pathway_disease_association', '2024-05-31', 7e-1, 'part' from part) x""",
    "predictions": """
select 1e0 / (1e0 + exp(-(l_extendedprice - 50000e0) / 20000e0)) as p,
       case when l_returnflag = 'R' then 1e0 else 0e0 end as y, l_suppkey as grp from lineitem""",
    "survival": """
select user_id, case when least(d1, d2) >= 2 then 0 when d1 <= d2 then 1 else 2 end as event_type,
       least(d1, d2, 2) as time, user_id % 3 as stratum
from (select user_id,
             min(case when event_type = 'purchase' then extract(day from ts) end) - min(extract(day from ts)) as d1,
             min(case when event_type = 'error' then extract(day from ts) end) - min(extract(day from ts)) as d2
      from events group by user_id) t
where d1 is not null and d2 is not null""",
    "readers": """
select o_custkey % 9 as reader, o_orderkey % 2 as arm, case when o_orderstatus = 'F' then 1 else 0 end as agree
from orders""",
    "citations": """
select concat_ws('|', cast(user_id as varchar(20)), event_type, cast(event_id as varchar(20))) as key,
       user_id as candidate, event_id % 3 <> 0 as in_ledger, event_type, value, event_id from events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(SQL[name])


def ctes(*names: str) -> str:
    """``with`` clauses of the views for oracle statements."""
    return "with recursive " + ",\n".join(f"{n} as ({SQL[n]})" for n in names)
