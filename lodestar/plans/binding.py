"""Binds the star-schema tables to the roles of the ranking engine.

An engagement is one commander (supplier) on one page (order). Of a commander's lines on one page the
first counts, and lines on both sides make the side `multiple_sides`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.scores import era_bucket


#: What orders a commander's lines on a page.
SEQ = ("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
#: Tables of the engagements.
SOURCES = ("lineitem", "orders", "part", "customer", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcome_of(flag: Column, discount: Column) -> Column:
    big = discount >= 0.08
    return F.when(flag == "A", F.when(big, "decisive_victory").otherwise("victory")).when(flag == "R", F.when(big, "major_defeat").otherwise("defeat")).otherwise("unknown")


def page_type_of(priority: Column) -> Column:
    return F.when(priority == "1-URGENT", "battle_article").when(priority == "2-HIGH", "operation_article").when(priority == "3-MEDIUM", "campaign_article").otherwise("war_conflict_article")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its roles, before collapsing: one scan of each table, columns pruned to those used.

    Orders meet their customers before the lines, and lines meet orders last, so that lines move once by part and once by page,
    and what follows by page finds them together. A page's row is held in a table of its task, so lines are sorted once, for their order.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", *SEQ, "l_returnflag", "l_linestatus", "l_discount", "l_shipdate")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    page = order.join(cust, order.o_custkey == cust.c_custkey).join(nation, cust.c_nationkey == nation.n_nationkey).select("o_orderkey", "o_orderpriority", "n_name")
    joined = line.join(part, line.l_partkey == part.p_partkey).join(page.hint("shuffle_hash"), line.l_orderkey == page.o_orderkey)
    year = (F.year("l_shipdate") - F.lit(45) * (F.col("p_size") % 45)).cast("int")
    return joined.select(
        F.col("l_suppkey").alias("commander_id"),
        F.col("l_orderkey").alias("page_id"),
        F.struct(*SEQ).alias("seq"),
        F.when(F.col("l_linestatus") == "F", "side_a").otherwise("side_b").alias("side"),
        outcome_of(F.col("l_returnflag"), F.col("l_discount")).alias("outcome"),
        page_type_of(F.col("o_orderpriority")).alias("page_type"),
        year.alias("year"),
        F.col("p_brand").alias("conflict"),
        F.col("n_name").alias("opponent"),
        (F.col("l_quantity") >= 5).alias("strict"),
        (F.col("l_quantity") >= 2).alias("balanced"),
    )


def engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (commander_id, page_id): the first line's values, sides merged.

    The first line is told by its place in an order, not as the least struct: a least value that is no number is kept by
    sorting and merging rows one by one. The order by page serves what follows by page.
    """
    own = Window.partitionBy("page_id", "commander_id")
    order = [*(F.col(f"seq.{c}") for c in SEQ), "side", "outcome", "page_type", "year", "conflict", "opponent"]
    own = own.orderBy(*order)
    all_ = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one pass serves the place and the rest
    one = lines(spark, sf_dir).withColumns({"first": F.row_number().over(own), "lo": F.min("side").over(all_), "hi": F.max("side").over(all_), "n_lines": F.count("*").over(all_)}).filter("first = 1")
    side = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("multiple_sides")
    flat = one.select("commander_id", "page_id", side.alias("side"), "outcome", "page_type", "year", "conflict", "opponent", "strict", "balanced", "n_lines")
    return flat.withColumn("era", era_bucket(F.col("year")))


#: The same rows in SQL, as common table expressions.
ERA_SQL = """case when year is null then 'unknown' when year <= 500 then 'ancient' when year <= 1500 then 'medieval'
  when year <= 1788 then 'early_modern' when year <= 1815 then 'revolutionary_napoleonic' when year <= 1913 then 'long_nineteenth_century'
  when year <= 1945 then 'world_wars' when year <= 1991 then 'cold_war' else 'contemporary' end"""
FACT = f"""lines as (
  select l_suppkey as commander_id, l_orderkey as page_id, l_linenumber, l_partkey, l_extendedprice, l_quantity,
    case when l_linestatus = 'F' then 'side_a' else 'side_b' end as side,
    case when l_returnflag = 'A' then case when l_discount >= 0.08 then 'decisive_victory' else 'victory' end
         when l_returnflag = 'R' then case when l_discount >= 0.08 then 'major_defeat' else 'defeat' end else 'unknown' end as outcome,
    case o_orderpriority when '1-URGENT' then 'battle_article' when '2-HIGH' then 'operation_article' when '3-MEDIUM' then 'campaign_article' else 'war_conflict_article' end as page_type,
    (year(l_shipdate) - 45 * (p_size % 45))::int as year, p_brand as conflict, n_name as opponent, l_quantity >= 5 as strict, l_quantity >= 2 as balanced
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
ordered as (
  select *, row_number() over (partition by commander_id, page_id order by l_linenumber, l_partkey, l_extendedprice, l_quantity, side, outcome, page_type, year, conflict, opponent) as rn,
    count(*) over (partition by commander_id, page_id) as n_lines,
    min(side) over (partition by commander_id, page_id) as lo, max(side) over (partition by commander_id, page_id) as hi from lines),
fact as (
  select commander_id, page_id, case when lo = hi then lo else 'multiple_sides' end as side, outcome, page_type, year, conflict, opponent, strict, balanced, n_lines, {ERA_SQL} as era
  from ordered where rn = 1)"""
