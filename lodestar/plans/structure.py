"""Structural verification of engagements: blockers by typed keys, page chronology, overlaps, broad and named titles.

Stand-ins of the binding: titles are made of a page's opponent, conflict and commander; blockers come from dear orders, from lines by
tax and discount, and from suppliers' balances. Two suppliers of three have a link.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.windows import any_over
from lodestar.plans.binding import FACT, engagements, table
from lodestar.plans.registry import query

# Parts of broad titles, words of names that mean nothing, years that a war page may lie outside.
BROAD = [" wars", " war ", "campaigns", "rebellions", "revolts", "uprisings", "expeditions", "operations"]
BROAD_CAMPAIGN = ["campaign", "campaigns", "expedition", "expeditions", "operations", "offensive", "invasion"]
EMPTY_WORDS, SLACK_YEARS = ["the", "of", "and"], 5
#: The keys of a blocker of each kind, in order of precedence inside a source.
KINDS = {"page": ["page_id"], "page_url": ["page_id", "url"], "page_name": ["page_id", "name_key"], "url": ["url"], "name": ["name_key"]}
SOURCES = {"battle_row_blocker": ["page"], "commander_row_blocker": ["page_url", "page_name"], "commander_master_blocker": ["url", "name"]}


def mentions(title: Column, name: Column) -> Column:
    """Whether a title holds the name, or one of its first three words that is long enough."""
    low = F.lower(title)
    words = F.slice(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(EMPTY_WORDS)), 1, 3)
    return (title != "") & (name != "") & (F.contains(low, F.lower(name)) | F.exists(words, lambda w: (F.length(w) >= 5) & F.contains(low, w)))


def blocked(rows: DataFrame, blockers: DataFrame) -> DataFrame:
    """Adds, for each source of blockers, the issues that block the row (null: none): those of the first kind that meets it.

    blockers: kind, page_id, url, name_key, issues. One without issues, or without its key, blocks nothing. Those of a page are laid
    among its rows, which move once, by page, and are told by windows over their keys; each other kind is one join with one row a key.
    """

    def real(kind: str) -> DataFrame:
        there = [F.col(k) != "" if k != "page_id" else F.col(k).isNotNull() for k in KINDS[kind]]
        return blockers.filter(reduce(lambda x, y: x & y, there, (F.col("kind") == kind) & (F.trim("issues") != "")))

    paged = [k for k in KINDS if "page_id" in KINDS[k]]
    laid = reduce(DataFrame.unionByName, map(real, paged)).withColumnsRenamed({"kind": "\1kind", "issues": "\1issues"})
    rows = rows.unionByName(laid, allowMissingColumns=True).repartition("page_id")
    for kind in paged:
        rows = rows.withColumn(f"\1{kind}", F.max(F.when(F.col("\1kind") == kind, F.col("\1issues"))).over(Window.partitionBy(*KINDS[kind])))
    rows = rows.filter(F.col("\1kind").isNull()).drop("\1kind", "\1issues")
    for kind in [k for k in KINDS if k not in paged]:
        keys = KINDS[kind]
        rows = rows.join(real(kind).groupBy(*keys).agg(F.max("issues").alias(f"\1{kind}")), keys, "left")
    found = {source: F.coalesce(*(F.col(f"\1{k}") for k in kinds)) for source, kinds in SOURCES.items()}
    return rows.withColumns(found).drop(*(f"\1{k}" for k in KINDS))


def verified(rows: DataFrame, blockers: DataFrame) -> DataFrame:
    """Adds flags (sorted) and the status of the gravest of them."""
    has = lambda c, words: F.rlike(F.lower(c), F.lit("|".join(words)))
    kind, year, strict, title = F.col("page_type"), F.col("year"), F.col("strict"), F.col("title")
    battle, war, campaign = kind == "battle_article", kind == "war_conflict_article", kind == "campaign_article"
    own = Window.partitionBy("commander_id")
    inner = F.when(~war & strict, year)
    e = blocked(rows, blockers).withColumns({"overlap": any_over(battle & strict, "commander_id", "conflict"), "same_year": any_over(battle & strict & year.isNotNull(), "commander_id", "year"), "lo": F.min(inner).over(own), "hi": F.max(inner).over(own)})
    outside = F.coalesce(war & ((year < F.col("lo") - SLACK_YEARS) | (year > F.col("hi") + SLACK_YEARS)), F.lit(False))
    broad_war, broad_campaign = war & has(title, BROAD), campaign & has(title, BROAD_CAMPAIGN)
    doubled = campaign & (F.col("overlap") | F.col("same_year"))
    named = campaign & mentions(title, F.col("name"))
    umbrella = (broad_war & (F.col("overlap") | outside)) | (doubled & (named | broad_campaign))
    flags = {
        **{source: F.col(source).isNotNull() for source in SOURCES}, "multi_side_ambiguity": F.col("side") == "multiple_sides", "commander_outside_page_chronology": outside, "duplicate_hierarchy_credit": (~battle & F.col("overlap")) | doubled,
        "commander_attached_to_too_broad_page": broad_war | broad_campaign, "umbrella_war_inflation": umbrella, "campaign_page_not_core": campaign, "same_year_campaign_overlap": doubled, "commander_named_campaign_duplicate": named,
    }
    e = e.withColumn("flags", F.array_sort(F.array_compact(F.array(*(F.when(v, k) for k, v in flags.items())))))
    any_of = lambda *names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    status = (
        F.when(any_of(*SOURCES), "quarantined")
        .when(any_of("commander_outside_page_chronology", "umbrella_war_inflation", "commander_named_campaign_duplicate"), "structurally_suspect")
        .when(any_of("duplicate_hierarchy_credit", "commander_attached_to_too_broad_page", "campaign_page_not_core"), "verified_broad")
        .otherwise("verified_core")
    )
    return e.withColumn("status", status)


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The engagements with names, links and titles, and the blockers."""
    name = F.col("s_name")
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("commander_id"), name.alias("name"), F.lower(name).alias("name_key"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("/wiki/"), F.replace(name, F.lit("#"), F.lit("_")))).otherwise("").alias("url"), "s_acctbal")
    page, kind = F.col("page_id"), F.col("page_type")
    number = F.element_at(F.split("name", "#"), -1)
    war = F.when(page % 3 == 0, F.concat_ws(" war of ", "opponent", "conflict")).when(page % 3 == 1, F.concat(F.col("conflict"), F.lit(" rebellions"))).otherwise(F.concat(F.lit("Conflict of "), F.col("opponent")))
    campaign = F.when(page % 4 == 0, F.concat(F.col("name"), F.lit(" march"))).when(page % 4 == 1, F.concat(F.lit("Expedition to "), F.col("opponent"))).when(page % 4 == 2, F.concat(F.lit("March of "), number)).otherwise(F.concat(F.lit("Siege of "), F.col("opponent")))
    title = F.when(kind == "war_conflict_article", war).when(kind == "campaign_article", campaign).otherwise(F.concat(F.lit("Battle of "), F.col("opponent")))
    rows = engagements(spark, sf_dir).join(supp.drop("s_acctbal"), "commander_id").withColumn("title", title)
    none = F.lit("")
    orders = table(spark, sf_dir, "orders").filter("o_totalprice >= 300000 and o_orderkey % 10 = 0").select(F.lit("page").alias("kind"), F.col("o_orderkey").alias("page_id"), none.alias("url"), none.alias("name_key"), F.lit("row").alias("issues"))
    line = table(spark, sf_dir, "lineitem").join(supp.withColumnRenamed("commander_id", "l_suppkey"), "l_suppkey")
    by_url = line.filter("l_tax >= 0.08 and l_linenumber = 1").select(F.lit("page_url").alias("kind"), F.col("l_orderkey").alias("page_id"), "url", none.alias("name_key"), F.lit("url").alias("issues"))
    by_name = line.filter("l_discount >= 0.1 and l_linenumber = 2").select(F.lit("page_name").alias("kind"), F.col("l_orderkey").alias("page_id"), none.alias("url"), "name_key", F.when(F.col("l_quantity") < 10, " ").otherwise("name").alias("issues"))
    no_page = F.lit(None).cast("long").alias("page_id")
    master = supp.filter("s_acctbal < -800").select(F.lit("url").alias("kind"), no_page, "url", none.alias("name_key"), F.lit("master").alias("issues"))
    named = supp.filter("s_acctbal > 9800").select(F.lit("name").alias("kind"), no_page, none.alias("url"), "name_key", F.lit("master").alias("issues"))
    return rows, orders.unionByName(by_url).unionByName(by_name).unionByName(master).unionByName(named)


_HAS = lambda c, words: "(" + " or ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"

STRUCTURE = f"""supp as (select s_suppkey as commander_id, s_name as name, case when s_suppkey % 3 <> 0 then '/wiki/' || replace(s_name, '#', '_') else '' end as url, s_acctbal from supplier),
row0 as (select fact.*, name, url, case page_type when 'war_conflict_article' then case page_id % 3 when 0 then opponent || ' war of ' || conflict when 1 then conflict || ' rebellions' else 'Conflict of ' || opponent end
  when 'campaign_article' then case page_id % 4 when 0 then name || ' march' when 1 then 'Expedition to ' || opponent when 2 then 'March of ' || split_part(name, '#', -1) else 'Siege of ' || opponent end else 'Battle of ' || opponent end as title from fact join supp using (commander_id)),
anchor as (select distinct commander_id, conflict from row0 where page_type = 'battle_article' and strict), yearly as (select distinct commander_id, year from row0 where page_type = 'battle_article' and strict and year is not null),
span as (select commander_id, min(year) as lo, max(year) as hi from row0 where page_type <> 'war_conflict_article' and strict group by 1),
b1 as (select distinct o_orderkey as page_id from orders where o_totalprice >= 300000 and o_orderkey % 10 = 0), b2 as (select distinct l_orderkey as page_id, url from lineitem join supp on commander_id = l_suppkey where l_tax >= 0.08 and l_linenumber = 1 and url <> ''),
b3 as (select distinct l_orderkey as page_id, lower(name) as k from lineitem join supp on commander_id = l_suppkey where l_discount >= 0.1 and l_linenumber = 2 and l_quantity >= 10), b4 as (select distinct url from supp where s_acctbal < -800 and url <> ''), b5 as (select distinct lower(name) as k from supp where s_acctbal > 9800),
x as (select *, page_id in (select page_id from b1) as bad_page, (page_id, url) in (select (page_id, url) from b2) or (page_id, lower(name)) in (select (page_id, k) from b3) as bad_row, url in (select url from b4) or lower(name) in (select k from b5) as bad_master,
  (commander_id, conflict) in (select (commander_id, conflict) from anchor) as overlap, year is not null and (commander_id, coalesce(year, 0)) in (select (commander_id, year) from yearly) as same_year, page_type = 'war_conflict_article' as war, page_type = 'campaign_article' as campaign from row0 left join span using (commander_id)),
y as (select *, coalesce(war and (year < lo - {SLACK_YEARS} or year > hi + {SLACK_YEARS}), false) as outside, war and {_HAS("title", BROAD)} as broad_war, campaign and {_HAS("title", BROAD_CAMPAIGN)} as broad_campaign, campaign and (overlap or same_year) as doubled,
  campaign and (contains(lower(title), lower(name)) or len(list_filter(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w not in ('', 'the', 'of', 'and'))[:3], lambda w: length(w) >= 5 and contains(lower(title), w))) > 0) as named from x),
z as (select *, (broad_war and (overlap or outside)) or (doubled and (named or broad_campaign)) as umbrella from y)"""


@query(f"""with {FACT}, {STRUCTURE} select commander_id, page_id, title,
  case when bad_page or bad_row or bad_master then 'quarantined' when outside or umbrella or named then 'structurally_suspect' when doubled or (overlap and page_type <> 'battle_article') or broad_war or broad_campaign or campaign then 'verified_broad' else 'verified_core' end as status,
  array_to_string(list_sort(list_filter([case when bad_page then 'battle_row_blocker' end, case when bad_row then 'commander_row_blocker' end, case when bad_master then 'commander_master_blocker' end, case when side = 'multiple_sides' then 'multi_side_ambiguity' end, case when outside then 'commander_outside_page_chronology' end,
    case when doubled or (overlap and page_type <> 'battle_article') then 'duplicate_hierarchy_credit' end, case when broad_war or broad_campaign then 'commander_attached_to_too_broad_page' end, case when umbrella then 'umbrella_war_inflation' end, case when campaign then 'campaign_page_not_core' end, case when doubled then 'same_year_campaign_overlap' end, case when named then 'commander_named_campaign_duplicate' end], lambda f: f is not null)), '|') as flags from z""")
def verify_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven structural flags of each engagement and the status of the gravest, with blockers of five kinds of keys."""
    return verified(*facts(spark, sf_dir)).select("commander_id", "page_id", "title", "status", F.array_join("flags", "|").alias("flags"))
