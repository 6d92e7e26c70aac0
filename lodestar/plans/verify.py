"""Queries of verification, data quality, graph discovery, overrides and opponent profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.graph import frontier, reach
from lodestar.operators.relational import beside, first_filled, join_flags
from lodestar.operators.windows import any_over
from lodestar.plans.binding import FACT, engagements, table
from lodestar.plans.ranking import RANKED, prepared, ranked
from lodestar.plans.registry import query


@query(f"""with {FACT}, w as (select *, coalesce(bool_or(page_type = 'battle_article') over (partition by commander_id, conflict), false) as anchor, coalesce(bool_or(page_type = 'battle_article') over (partition by commander_id, year), false) as same_year,
  min(case when page_type <> 'war_conflict_article' then year end) over (partition by commander_id) as lo, max(case when page_type <> 'war_conflict_article' then year end) over (partition by commander_id) as hi from fact),
  f as (select *, n_lines > 2 as blocker, page_type = 'war_conflict_article' and (year < lo - 5 or year > hi + 5) as outside, page_type <> 'battle_article' and (anchor or page_type = 'campaign_article' and same_year) as doubled, page_type = 'campaign_article' as campaign, page_type = 'campaign_article' and same_year and opponent = 'CHINA' as inflated from w)
  select commander_id, page_id, case when blocker then 'quarantined' when coalesce(outside, false) or inflated then 'structurally_suspect' when doubled or campaign then 'verified_broad' else 'verified_core' end as status,
    array_to_string(list_sort(list_filter([case when blocker then 'row_blocker' end, case when outside then 'outside_chronology' end, case when doubled then 'duplicate_hierarchy_credit' end, case when campaign then 'campaign_not_core' end, case when inflated then 'umbrella_inflation' end], lambda x: x is not null)), ' | ') as flags from f""")
def verify_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural flags of each engagement and the status of the gravest."""
    kind, year = F.col("page_type"), F.col("year")
    battle = kind == "battle_article"
    inner = F.when(kind != "war_conflict_article", year)
    own = Window.partitionBy("commander_id")
    e = engagements(spark, sf_dir).withColumns({"anchor": any_over(battle, "commander_id", "conflict"), "same_year": any_over(battle, "commander_id", "year"), "lo": F.min(inner).over(own), "hi": F.max(inner).over(own)})
    campaign = kind == "campaign_article"
    blocker = F.col("n_lines") > 2
    outside = F.coalesce((kind == "war_conflict_article") & ((year < F.col("lo") - 5) | (year > F.col("hi") + 5)), F.lit(False))
    doubled = ~battle & (F.col("anchor") | (campaign & F.col("same_year")))
    inflated = campaign & F.col("same_year") & (F.col("opponent") == "CHINA")
    status = F.when(blocker, "quarantined").when(outside | inflated, "structurally_suspect").when(doubled | campaign, "verified_broad").otherwise("verified_core")
    flags = join_flags(F.when(blocker, "row_blocker"), F.when(outside, "outside_chronology"), F.when(doubled, "duplicate_hierarchy_credit"), F.when(campaign, "campaign_not_core"), F.when(inflated, "umbrella_inflation"))
    return e.select("commander_id", "page_id", status.alias("status"), flags.alias("flags"))


@query("""with o as (select doc_id, max(case when quality = 1 then 'kept' when toxic = 1 then 'removed' end) as decision from labels group by 1)
  select d.doc_id, coalesce(nullif(trim(o.decision), ''), case when d.n_chars > 500 then 'kept' else 'short' end) as decision, o.decision is not null and o.decision <> case when d.n_chars > 500 then 'kept' else 'short' end as overridden from documents d left join o using (doc_id)""")
def verify_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manual table overrides a computed value where it says something; rows without an override keep theirs."""
    o = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, "kept").when(F.col("toxic") == 1, "removed")).alias("o"))
    base = F.when(F.col("n_chars") > 500, "kept").otherwise("short")
    d = table(spark, sf_dir, "documents").select("doc_id", base.alias("base")).join(o, "doc_id", "left")
    final = F.coalesce(F.when(F.trim("o") != "", F.col("o")), F.col("base"))
    return d.select("doc_id", final.alias("decision"), (F.col("o").isNotNull() & (F.col("o") != F.col("base"))).alias("overridden"))


@query(f"""with {FACT}, o as (select a.commander_id, b.opponent, a.strict, a.era, a.conflict from fact a join (select distinct page_id, side, opponent from fact) b on a.page_id = b.page_id)
  select commander_id, opponent, count(*) as meetings, count_if(strict)::bigint as strict_meetings, count(distinct conflict) as conflicts, string_agg(distinct era, ' | ' order by era) as eras from o group by 1, 2""")
def score_opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each commander met, how often, in which eras."""
    e = engagements(spark, sf_dir)
    sides = e.select("page_id", "side", "opponent").distinct().drop("side")
    o = e.select("commander_id", "page_id", "strict", "era", "conflict").join(sides, "page_id")
    return o.groupBy("commander_id", "opponent").agg(F.count("*").alias("meetings"), F.count_if("strict").alias("strict_meetings"), F.countDistinct("conflict").alias("conflicts"), F.array_join(F.array_sort(F.collect_set("era")), " | ").alias("eras"))


@query(f"""with {FACT} select commander_id, count(*) as total, count_if(strict)::bigint as strict, count_if(balanced)::bigint as balanced,
  {", ".join(f"count_if(outcome = '{o}')::bigint as n_{o}, round(count_if(outcome = '{o}') / count(*)::double, 6) as share_{o}" for o in ("decisive_victory", "victory", "defeat", "major_defeat", "unknown"))},
  {", ".join(f"count_if(page_type = '{p}_article' and strict)::bigint as strict_{p}" for p in ("battle", "operation", "campaign", "war_conflict"))}, max(year) - min(year) as span,
  coalesce(max(case when page_type <> 'war_conflict_article' and strict then year end) - min(case when page_type <> 'war_conflict_article' and strict then year end), max(year) - min(year)) as span_nonwar,
  'B=' || count_if(page_type = 'battle_article' and strict) || '; O=' || count_if(page_type = 'operation_article' and strict) as mix from fact group by 1""")
def score_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, page-type and span profiles, each category counted in one scan."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    st = lambda p: F.count_if((F.col("page_type") == f"{p}_article") & F.col("strict"))
    inner = F.when((F.col("page_type") != "war_conflict_article") & F.col("strict"), F.col("year"))
    outs = ("decisive_victory", "victory", "defeat", "major_defeat", "unknown")
    return engagements(spark, sf_dir).groupBy("commander_id").agg(
        F.count("*").alias("total"), F.count_if("strict").alias("strict"), F.count_if("balanced").alias("balanced"), *(is_("outcome", o).alias(f"n_{o}") for o in outs), *(F.round(is_("outcome", o) / F.count("*"), 6).alias(f"share_{o}") for o in outs),
        *(st(p).alias(f"strict_{p}") for p in ("battle", "operation", "campaign", "war_conflict")), (F.max("year") - F.min("year")).alias("span"), F.coalesce(F.max(inner) - F.min(inner), F.max("year") - F.min("year")).alias("span_nonwar"), F.format_string("B=%d; O=%d", st("battle"), st("operation")).alias("mix"),
    )


@query(f"""with {FACT}, p as (select *, side <> 'multiple_sides' as valid, outcome <> 'unknown' as known, count_if(outcome <> 'unknown') over (partition by page_id, side) as n from fact)
  select commander_id, page_id, round(case when valid and known then 1 / sqrt(n) else 0 end, 6) as credit, n::bigint as known_same_side from p""")
def score_split_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each known outcome's share among the commanders of one side."""
    return prepared(spark, sf_dir).select("commander_id", "page_id", F.round("credit_split", 6).alias("credit"), F.col("known_n").alias("known_same_side"))


@query(f"""with {FACT}, k as (select count(*) as n, count(distinct (commander_id, page_id)) as u from fact), ri as (select count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders)), c as (select count_if(outcome = 'unknown' and credit <> 0 or outcome <> 'unknown' and side <> 'multiple_sides' and abs(credit - 1 / sqrt(k)) >= 1e-5)::bigint as n from (select *, case when side <> 'multiple_sides' and outcome <> 'unknown' then 1 / sqrt(count_if(outcome <> 'unknown') over (partition by page_id, side)) else 0 end as credit, count_if(outcome <> 'unknown') over (partition by page_id, side) as k from fact)),
  d as (select count(*) as n from fact where outcome not in ('decisive_victory', 'victory', 'defeat', 'major_defeat', 'unknown')), s as (select count(*) as n from (select distinct l_suppkey from lineitem except select s_suppkey from supplier))
  select 'unique_keys' as check_name, n = u as passed, (n - u)::bigint as bad from k union all select 'references', n = 0, n from ri union all select 'unknown_has_no_credit', n = 0, n from c union all select 'domain', n = 0, n from d union all select 'coverage', n = 0, n from s""")
def verify_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness, references, invariants, domains and coverage, a row a check."""
    p = prepared(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem")
    known = ["decisive_victory", "victory", "defeat", "major_defeat", "unknown"]
    one = p.agg(
        (F.count("*") - F.countDistinct("commander_id", "page_id")).alias("unique_keys"),
        F.count_if(((F.col("outcome") == "unknown") & (F.col("credit_split") != 0)) | (F.col("known") & F.col("valid") & (F.abs(F.col("credit_split") - 1 / F.sqrt("known_n")) >= 1e-5))).alias("unknown_has_no_credit"),
        F.count_if(~F.col("outcome").isin(known)).alias("domain"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    lost = line.join(orders, "l_orderkey", "left_anti").agg(F.count("*").alias("references"))
    uncovered = line.select("l_suppkey").distinct().join(supp, "l_suppkey", "left_anti").agg(F.count("*").alias("coverage"))
    names = ["unique_keys", "references", "unknown_has_no_credit", "domain", "coverage"]
    return beside(one, lost, uncovered).unpivot([], names, "check_name", "bad").select("check_name", (F.col("bad") == 0).alias("passed"), "bad")


@query(f"""with {RANKED}, t as (select commander_id from ranked where model = 'hierarchical_trust_v2' and rank <= 10), w as (select commander_id from ranked where model = 'hierarchical_weighted' and rank <= 10)
  select (select count(*) from t semi join w using (commander_id)) as shared, (select count(*) from t semi join w using (commander_id)) >= 6 as enough, (select count(*) from ranked where score > 100) as above, (select max(rank) from ranked where model = 'baseline_conservative')::bigint as baseline""")
def verify_regression_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on the rankings: shared leaders, score bounds, cohort size."""
    r = ranked(spark, sf_dir).select("model", "commander_id", "rank", "score")
    top = r.groupBy("commander_id").agg(F.count_if((F.col("rank") <= 10) & F.col("model").isin("hierarchical_trust_v2", "hierarchical_weighted")).alias("n"))
    both = top.agg(F.count_if(F.col("n") == 2).alias("shared"))
    rest = r.agg(F.count_if(F.col("score") > 100).alias("above"), F.max(F.when(F.col("model") == "baseline_conservative", F.col("rank"))).cast("long").alias("baseline"))
    return beside(both, rest).withColumn("enough", F.col("shared") >= 6)


@query("""with s as (select 'battle of ' || lower(p_type) as title, p_partkey from part), b as (select unnest(['battle of promo brushed steel', 'battle of small plated brass', 'battle of nowhere', 'battle of economy anodized tin']) as title)
  select b.title, min(p_partkey) as first_id, count(p_partkey) as n, count(p_partkey) > 0 as found from b left join s using (title) group by 1""")
def verify_benchmark_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which titles of a fixed list the candidates hold."""
    want = spark.createDataFrame([(t,) for t in ("battle of promo brushed steel", "battle of small plated brass", "battle of nowhere", "battle of economy anodized tin")], "title string")
    s = table(spark, sf_dir, "part").select(F.concat(F.lit("battle of "), F.lower("p_type")).alias("title"), "p_partkey").groupBy("title").agg(F.min("p_partkey").alias("first_id"), F.count("*").alias("n"))
    return want.join(s, "title", "left").select("title", "first_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("first_id").isNotNull().alias("found"))


@query("""with s as (select o_orderkey, o_custkey, case o_orderstatus when 'F' then 3 when 'P' then 2 else 1 end as priority, o_orderstatus as status from orders),
  r as (select *, row_number() over (partition by o_custkey order by priority desc, o_orderkey desc) as rn from s) select c_custkey, coalesce(status, 'new') as status, coalesce(priority, 0)::int as priority from customer left join (select * from r where rn = 1) on c_custkey = o_custkey""")
def rule_status_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of highest priority wins, the later row on ties."""
    p = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct(F.col("o_orderstatus").alias("status"), p.alias("priority")), F.struct(p, F.col("o_orderkey"))).alias("x"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left")
    return c.select("c_custkey", first_filled(F.col("x.status"), default="new").alias("status"), F.coalesce("x.priority", F.lit(0)).alias("priority"))


@query(f"""with {RANKED}, a as (select commander_id, rank as before from ranked where model = 'baseline_conservative'), b as (select commander_id, rank as after from ranked where model = 'hierarchical_trust_v2')
  select coalesce(a.commander_id, b.commander_id) as commander_id, before, after, after - before as moved, case when before is null then 'entered' when after is null then 'left' when after < before then 'rose' when after > before then 'fell' else 'kept' end as way from a full join b using (commander_id) where coalesce(before, 999) <= 50 or coalesce(after, 999) <= 50""")
def report_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after leaderboards and who moved."""
    r = ranked(spark, sf_dir, ["baseline_conservative", "hierarchical_trust_v2"])
    s = r.groupBy("commander_id").agg(F.max(F.when(F.col("model") == "baseline_conservative", F.col("rank"))).alias("before"), F.max(F.when(F.col("model") == "hierarchical_trust_v2", F.col("rank"))).alias("after"))
    b, a = F.col("before"), F.col("after")
    way = F.when(b.isNull(), "entered").when(a.isNull(), "left").when(a < b, "rose").when(a > b, "fell").otherwise("kept")
    return s.filter((F.coalesce(b, F.lit(999)) <= 50) | (F.coalesce(a, F.lit(999)) <= 50)).select("commander_id", "before", "after", (a - b).alias("moved"), way.alias("way"))


@query("""with recursive e as (select distinct c_nationkey::bigint as a, s_nationkey::bigint as b from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey where l_quantity >= 48 and c_nationkey < s_nationkey and s_nationkey <= c_nationkey + 3),
  w as (select 0::bigint as node, 0 as depth union select e.b, w.depth + 1 from w join e on e.a = w.node where w.depth < 6) select node, min(depth)::int as depth from w group by 1""")
def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first reach with a depth bound over edges found in the fact."""
    line = table(spark, sf_dir, "lineitem").filter("l_quantity >= 48")
    o, c, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    j = line.join(o, line.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, line.l_suppkey == s.s_suppkey)
    e = j.filter((F.col("c_nationkey") < F.col("s_nationkey")) & (F.col("s_nationkey") <= F.col("c_nationkey") + 3)).select(F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b")).distinct()
    return reach(e, spark.createDataFrame([(0,)], "node long"), 6)


@query()
def graph_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the order in which a queue visits them along the lines of orders, up to a quarter of them; the rest of the queue is marked.

    A part leads to the next line's part of each order, in order of the orders. No SQL: the queue is tested against a plain one.
    """
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    links = line.select("l_orderkey", F.col("l_partkey").alias("a"), after.alias("b")).filter("b is not null")
    # A part that an order leads to twice waits there once, at its first place.
    links = links.groupBy("a", "b").agg(F.min("l_orderkey").alias("place"))
    start = part.filter("p_partkey < 3").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("place"))
    return frontier(links, start, part.filter("p_size % 3 <> 0").select(F.col("p_partkey").alias("node")), part.count() // 4)


@query("""with recursive e as (select distinct p_partkey as a, (p_partkey * 7 + p_size) % (select count(*) from part) as b from part), ok as (select p_partkey as node from part where p_size % 4 <> 0),
  w as (select 0::bigint as node, 0 as depth union select e.b, w.depth + 1 from w join e on e.a = w.node join ok on ok.node = e.b where w.depth < 5) select node, min(depth)::int as depth, node % 3 = 0 as candidate from w group by 1""")
def graph_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach over categories with a depth bound, entering relevant ones only; members of a kind become candidates."""
    p = table(spark, sf_dir, "part")
    n = p.agg(F.count("*").alias("n"))
    e = beside(p, n).select(F.col("p_partkey").cast("long").alias("a"), ((F.col("p_partkey") * 7 + F.col("p_size")) % F.col("n")).cast("long").alias("b")).distinct()
    ok = p.filter("p_size % 4 <> 0").select(F.col("p_partkey").cast("long").alias("node"))
    found = reach(e, spark.createDataFrame([(0,)], "node long"), 5, ok)
    return found.select("node", "depth", (F.col("node") % 3 == 0).alias("candidate"))


@query(f"""with {RANKED}, x as (select name, model, rank, score, profile from ranked where model = 'hierarchical_trust_v2' and contains(lower(name || ' ' || profile), 'mixed') and engagements >= 10) select name, rank, round(score, 6) as score, profile from x order by score desc, rank limit 120""")
def report_filtered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameterised table view: facets, free text, sort and 120 rows."""
    r = ranked(spark, sf_dir, ["hierarchical_trust_v2"]).filter(F.contains(F.lower(F.concat_ws(" ", "name", "profile")), F.lit("mixed")) & (F.col("engagements") >= 10))
    return r.orderBy(F.desc_nulls_last("score"), "rank").limit(120).select("name", "rank", F.round("score", 6).alias("score"), "profile")
