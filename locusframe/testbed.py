"""Projections of general tables into the genomic schemas, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusframe.kernels.mixture import Mixture

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: Parameters of the mixture that fixed-parameter queries score with.
MIXTURE = Mixture(mu1=700.0, theta1=5.0, mu2=1400.0, theta2=8.0, prob0=0.01, prob1=0.85)

#: The same for the smallest tables, whose windows hold a tenth of the counts.
SMALL_MIXTURE = Mixture(mu1=110.0, theta1=6.0, mu2=260.0, theta2=12.0, prob0=0.01, prob1=0.85)

#: Stands where DuckDB's regexp_replace needs a flag to replace all matches, as Spark's does without.
ALL = "/*all*/"

VIEWS = {
    "motifs": """select o_orderkey as motif_id, concat('chr', cast(o_custkey % 5 + 1 as varchar(9))) as chrom,
       (o_orderkey*6151) % 50021 + 201 as st, (o_orderkey*6151) % 50021 + 210 + o_custkey % 16 as en,
       case when o_orderkey % 2 = 0 then '+' else '-' end as strand,
       (cast(o_orderkey % 997 as double) + 1E0) / 1E6 as score from orders""",
    "signal": """select concat('chr', cast(l_suppkey % 5 + 1 as varchar(9))) as chrom,
       (l_partkey*7919 + l_linenumber*104729) % 50021 + 1 as pos, sum(l_quantity) as val from lineitem group by 1, 2""",
    "transcripts": """select p_partkey as file_row, concat('tx', cast(p_partkey as varchar(9))) as tx,
       concat('chr', cast(p_partkey % 5 + 1 as varchar(9))) as chrom,
       case when p_size % 2 = 0 then '+' else '-' end as strand,
       (p_partkey*3571) % 50021 as tx_start, (p_partkey*3571) % 50021 + 50 + p_size*40 as tx_end,
       concat(p_brand, '|', cast(p_partkey % 20 as varchar(9))) as gene from part""",
    "maptrack": """select concat('chr', cast(c_custkey % 5 + 1 as varchar(9))) as chrom,
       (c_custkey - c_custkey % 5)*34 as start0, (c_custkey - c_custkey % 5)*34 + 170 as end0,
       (cast(c_nationkey as double) + 1E0) / 32E0 as val from customer""",
    "exclusion": """select concat('chr', cast(s_suppkey % 5 + 1 as varchar(9))) as chrom,
       (s_suppkey*4783) % 50021 as start0, (s_suppkey*4783) % 50021 + 60 as end0, s_name as name,
       case when s_nationkey % 2 = 0 then '+' else '-' end as strand from supplier""",
    "reads": """select event_id as file_row, concat('chr', cast(user_id % 2 + 1 as varchar(9))) as rname,
       case event_type when 'view' then 83 when 'click' then 147 when 'purchase' then 163 when 'signup' then 99 else 4 end as flag,
       (user_id % 3)*10 + 100 as pos, cast(floor(value) as bigint) % 61 as mapq, 36 as rlen,
       case when event_id % 17 = 0 then 1 else 0 end as is_dup from events""",
    "blocks": """select concat('chr', cast(p_partkey % 5 + 1 as varchar(9))) as chrom,
       (p_partkey - p_partkey % 5)*10 + 1000 as block_start,
       (p_partkey - p_partkey % 5)*10 + 1000 + (o.l_linenumber - 1)*5 + r_regionkey as pos,
       cast((p_partkey + o.l_linenumber*3 + r_regionkey) % 64 as double) / 64E0 as val
from part cross join (select distinct l_linenumber from lineitem where l_linenumber <= 7) o cross join region""",
    "genome": """select chrom, cast(1 + coalesce(sum(length(seq)) over (partition by chrom order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start, seq
       from (select doc_id, concat('chr', cast(doc_id % 5 + 1 as varchar(9))) as chrom, regexp_replace(translate(text, 'eaoinrtslu', 'ACGTacgtCG'), '[^ACGTacgt]', ''/*all*/) as seq from documents)""",
    "pairs_y": """select a.n_name as model, b.n_name as target, m.metric,
       cast((a.n_nationkey*7 + b.n_nationkey*13 + m.k*29) % 97 + 1 as double) / 100E0 as value
from nation a cross join nation b cross join (select r_regionkey + 1 as metric, r_regionkey as k from region
     union all select r_regionkey*2 + 7 as metric, r_regionkey + 10 as k from region where r_regionkey in (1, 2)) m""",
    "pairs_x": """select a.n_name as model, b.n_name as target, r_name as feature,
       cast((a.n_nationkey*11 + b.n_nationkey*5 + r_regionkey*17) % 89 + 1 as double) / 100E0 as pvalue
from nation a cross join nation b cross join region""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in TABLES:
        if t in VIEWS[name]:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str, more: str = "") -> str:
    """sql after the views it reads, and further common tables."""
    parts = [f"{n} as ({VIEWS[n].replace(ALL, ", 'g'")})" for n in names]
    return "with " + ",\n".join([*parts, more] if more else parts) + "\n" + sql
