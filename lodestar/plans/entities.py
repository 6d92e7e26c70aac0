"""Queries of entity recovery and rank gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.binding import table
from lodestar.plans.ranking import RANKED, ranked
from lodestar.plans.registry import query

@query("""with s as (select n_nationkey as page, c_custkey, 'F' || (c_custkey % 97) || ' L' || (c_custkey % 211) as full_name from customer join nation on n_nationkey = c_nationkey), u as (select page, split_part(full_name, ' ', 2) as last, min(c_custkey) as id from s group by 1, 2 having count(*) = 1)
  select s_suppkey, u.id as recovered, case when u.id is null then 'quarantine' else 'linked' end as status from supplier left join u on page = s_nationkey and last = 'L' || (s_suppkey % 211)""")
def rule_surname_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one word linked to the only person of their page with that last name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), "c_custkey", F.concat(F.lit("F"), (F.col("c_custkey") % 97).cast("string"), F.lit(" L"), (F.col("c_custkey") % 211).cast("string")).alias("full"))
    u = c.groupBy("page", F.element_at(F.split("full", " "), -1).alias("last")).agg(F.min("c_custkey").alias("id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("page"), F.concat(F.lit("L"), (F.col("s_suppkey") % 211).cast("string")).alias("last"))
    return s.join(u, ["page", "last"], "left").select("s_suppkey", F.col("id").alias("recovered"), F.when(F.col("id").isNull(), "quarantine").otherwise("linked").alias("status"))


@query(f"""with {RANKED}, x as (select commander_id, model, rank from ranked where model in ('hierarchical_weighted', 'hierarchical_trust_v2', 'battle_only_baseline')), w as (select commander_id, max(case when model = 'hierarchical_trust_v2' then rank end) as t, max(case when model = 'hierarchical_weighted' then rank end) as h, max(case when model = 'battle_only_baseline' then rank end) as b from x group by 1)
  select commander_id, abs(t - h) as gap_weighted, abs(t - b) as gap_battle, case when b is null then 'no_battle_rank' when abs(t - b) > abs(t - h) then 'page_scope' when abs(t - h) > 0 then 'component_weights' else 'none' end as driver, format('Rank {{}}; battle rank {{}}', t, coalesce(b::varchar, 'none')) as sentence from w where t is not null""")
def report_gap_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank gaps between models, what drives them, and a sentence from a template."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("rank")))
    w = ranked(spark, sf_dir, ["hierarchical_trust_v2", "hierarchical_weighted", "battle_only_baseline"]).groupBy("commander_id").agg(pick("hierarchical_trust_v2").alias("t"), pick("hierarchical_weighted").alias("h"), pick("battle_only_baseline").alias("b")).filter("t is not null")
    gh, gb = F.abs(F.col("t") - F.col("h")), F.abs(F.col("t") - F.col("b"))
    driver = F.when(F.col("b").isNull(), "no_battle_rank").when(gb > gh, "page_scope").when(gh > 0, "component_weights").otherwise("none")
    said = F.format_string("Rank %s; battle rank %s", F.col("t").cast("string"), F.coalesce(F.col("b").cast("string"), F.lit("none")))
    return w.select("commander_id", gh.alias("gap_weighted"), gb.alias("gap_battle"), driver.alias("driver"), said.alias("sentence"))
