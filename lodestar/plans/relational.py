"""Queries of the relational operators: filters, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.scores import ERAS, mapped, ratio
from lodestar.operators import relational as rel
from lodestar.operators.tables import shared_table
from lodestar.operators.windows import any_over, ordered_ranks, percentile_ranks, share_over, top_by
from lodestar.plans.binding import FACT, engagements, table
from lodestar.plans.registry import query


@query("""select l_orderkey, l_linenumber::bigint as line, round(l_extendedprice * (1 - l_discount), 4) as net,
  case when l_quantity > 25 and not l_returnflag = 'R' then 'bulk' else 'plain' end as kind
  from lineitem where l_shipdate >= timestamp '1996-01-01' and l_returnflag in ('A', 'N') and (l_discount > 0.02 or l_tax < 0.01)""")
def rel_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Select, derive, rename, mask with and/or/not, small literal sets; filters reach the scan."""
    line = table(spark, sf_dir, "lineitem")
    kept = line.filter((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & F.col("l_returnflag").isin("A", "N") & ((F.col("l_discount") > 0.02) | (F.col("l_tax") < 0.01)))
    return kept.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("line"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
        F.when((F.col("l_quantity") > 25) & ~(F.col("l_returnflag") == "R"), "bulk").otherwise("plain").alias("kind"),
    )


@query("""select c_custkey, c_name, exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') as urgent
  from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""")
def rel_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids kept because another frame has them, dropped because it has them, and flagged by key existence."""
    cust, order = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    part = order.filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    urgent = order.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return rel.flag_existing(cust.join(part, "c_custkey", "left_anti"), urgent, ["c_custkey"], "urgent").select("c_custkey", "c_name", "urgent")


@query("""select doc_id, contains(lower(text), 'the ') as has_the, regexp_matches(text, '[0-9]{3}') as has_number,
  regexp_full_match(lang, '(en|de)') as en_or_de, (contains(lower(text), 'idiot') or contains(lower(text), 'scum') or contains(lower(text), 'trash')) as any_needle
  from documents where text is not null and text <> ''""")
def rel_text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring, pattern, whole-value pattern and any-of-needles tests, null or empty removed first."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & (F.col("text") != "")).select(
        "doc_id", F.contains(low, F.lit("the ")).alias("has_the"), F.rlike("text", F.lit("[0-9]{3}")).alias("has_number"), F.rlike("lang", F.lit("^(en|de)$")).alias("en_or_de"), rel.any_needle(low, ["idiot", "scum", "trash"]).alias("any_needle")
    )


@query("""with a as (select o_custkey, o_orderpriority, sum(o_totalprice) as x from orders group by all),
  b as (select o_custkey, o_orderpriority, sum(o_totalprice * (1 + 1e-12)) + case when o_orderpriority = '5-LOW' then 0.5 else 0 end as y from orders group by o_custkey, o_orderpriority)
  select o_orderpriority, count(*) as n, count_if(abs(x - y) <= greatest(1e-9 * greatest(abs(x), abs(y)), 1e-6))::bigint as equal
  from a join b using (o_custkey, o_orderpriority) group by o_orderpriority""")
def rel_tolerant_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers equal within a relative or absolute tolerance, over a join on two keys."""
    order = table(spark, sf_dir, "orders")
    a = order.groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("x"))
    b = order.groupBy("o_custkey", "o_orderpriority").agg((F.sum(F.col("o_totalprice") * F.lit(1 + 1e-12)) + F.when(F.col("o_orderpriority") == "5-LOW", 0.5).otherwise(0.0)).alias("y"))
    return a.join(b, ["o_custkey", "o_orderpriority"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(rel.near(F.col("x"), F.col("y"))).alias("equal"))


@query("""with m as (select s_suppkey, s_nationkey, coalesce(max(l_quantity), 0) as most from supplier left join lineitem on l_suppkey = s_suppkey group by all)
  select coalesce(n_name, 'none') as nation, r_name as region, count(*) as suppliers, max(most) as most
  from m left join nation on n_nationkey = s_nationkey left join region on n_regionkey = r_regionkey group by 1, 2""")
def rel_lookup_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins to dimensions, coalesced defaults; the fact is aggregated before it meets them."""
    most = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_quantity").alias("most"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supp = table(spark, sf_dir, "supplier").join(most, "s_suppkey", "left").fillna({"most": 0.0})
    wide = supp.join(nation, supp.s_nationkey == nation.n_nationkey, "left").join(region, F.col("n_regionkey") == region.r_regionkey, "left")
    return wide.groupBy(F.coalesce("n_name", F.lit("none")).alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("suppliers"), F.max("most").alias("most"))


@query("""with b as (select o_custkey as k, count(*) as n from orders where o_orderdate < timestamp '1995-06-01' group by 1),
  a as (select o_custkey as k, count(*) as n from orders where o_orderdate >= timestamp '1995-06-01' group by 1)
  select coalesce(b.k, a.k) as k, b.n as before, a.n as after, case when a.k is null then 'left_only' when b.k is null then 'right_only' else 'both' end as found,
    b.n is distinct from a.n as changed from b full join a on b.k = a.k""")
def rel_outer_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots side by side: full join, where each row was found, null-safe change."""
    order = table(spark, sf_dir, "orders")
    cut = F.lit("1995-06-01").cast("timestamp")
    old = order.filter(F.col("o_orderdate") < cut).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("before"))
    new = order.filter(F.col("o_orderdate") >= cut).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("after"))
    return rel.compare(old, new, ["k"], "found").withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


@query("""select l.doc_id, coalesce(d.source, 'by_quality_' || l.quality) as origin, coalesce(d.n_chars, -1) as n_chars
  from labels l left join (select * from documents where n_chars > 1500) d using (doc_id)""")
def rel_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup whose misses fall back to another key's value."""
    long = table(spark, sf_dir, "documents").filter(F.col("n_chars") > 1500).select("doc_id", "source", "n_chars")
    own = table(spark, sf_dir, "labels").join(long, "doc_id", "left")
    return own.select("doc_id", F.coalesce("source", F.concat(F.lit("by_quality_"), F.col("quality").cast("string"))).alias("origin"), F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@query(f"""with {FACT} select commander_id, page_id, count(*) over (partition by page_id, side) as same_side,
  count_if(outcome <> 'unknown') over (partition by page_id, side)::bigint as known_same_side,
  coalesce(bool_or(strict and page_type = 'battle_article') over (partition by commander_id, conflict), false) as has_battle from fact""")
def rel_group_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes, conditional group sizes and existence flags on every row."""
    w = Window.partitionBy("page_id", "side")
    return engagements(spark, sf_dir).select(
        "commander_id", "page_id", F.count("*").over(w).alias("same_side"), F.count_if(F.col("outcome") != "unknown").over(w).alias("known_same_side"),
        any_over(F.col("strict") & (F.col("page_type") == "battle_article"), "commander_id", "conflict").alias("has_battle"),
    )


@query(f"""with {FACT} select a.commander_id, a.page_id, string_agg(b.commander_id::varchar, ' | ' order by b.commander_id::varchar) as opposing
  from fact a join fact b on a.page_id = b.page_id and a.side <> b.side and a.commander_id <> b.commander_id group by 1, 2""")
def rel_opposite_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stood on the other sides of each page, as a sorted list-string.

    A page's rows lie together and in order already, so a window over them needs neither a shuffle, nor a sort, nor a join of sides.
    """
    rows = engagements(spark, sf_dir).filter("commander_id is not null")
    page = rows.select("commander_id", "page_id", "side", F.collect_list(F.struct("side", F.col("commander_id").cast("string").alias("id"))).over(Window.partitionBy("page_id")).alias("all"))
    them = F.filter("all", lambda x: x["side"] != F.col("side"))["id"]
    return page.select("commander_id", "page_id", them.alias("them")).filter(F.size("them") > 0).select("commander_id", "page_id", F.array_join(F.array_sort("them"), " | ").alias("opposing"))


@query(f"""with {FACT}, span as (select commander_id, min(year) filter (page_type <> 'war_conflict_article' and strict) as lo, max(year) filter (page_type <> 'war_conflict_article' and strict) as hi from fact group by 1)
  select commander_id, page_id, year from fact join span using (commander_id) where year < lo + 300 or year > hi - 300""")
def rel_range_after_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range test against a group's own bounds, as a window instead of a join."""
    inner = F.when((F.col("page_type") != "war_conflict_article") & F.col("strict"), F.col("year"))
    w = Window.partitionBy("commander_id")
    fact = engagements(spark, sf_dir).withColumns({"lo": F.min(inner).over(w), "hi": F.max(inner).over(w)})
    return fact.filter((F.col("year") < F.col("lo") + 300) | (F.col("year") > F.col("hi") - 300)).select("commander_id", "page_id", "year")


@query(f"""with {FACT} select commander_id, count(*) as n, count_if(outcome <> 'unknown')::bigint as known, count(distinct conflict) as conflicts,
  count(distinct case when era <> 'unknown' then era end) as eras, min(year) as first_year, max(year) as last_year, sum(abs(year - 1500))::bigint as distance,
  round(median(year), 6) as mid_year, round(stddev_samp(year), 6) as sd1, round(stddev_pop(year), 6) as sd0, case when count(*) >= 2 then round(var_pop(year), 4) end as variance,
  round(quantile_cont(year, 0.25), 6) as q25, round(quantile_cont(year, 0.75), 6) as q75 from fact group by 1""")
def rel_many_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, conditional and distinct counts, extremes, spread, exact interpolated quantiles in one pass."""
    year = F.col("year").cast("double")
    at = F.percentile(year, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    eras = F.bit_count(F.bit_or(mapped(F.col("era"), {e: 1 << k for k, e in enumerate([*ERAS, "contemporary"])}, 0)))
    return engagements(spark, sf_dir).groupBy("commander_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") != "unknown").alias("known"), F.countDistinct("conflict").alias("conflicts"),
        eras.cast("long").alias("eras"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.sum(F.abs(F.col("year") - 1500)).alias("distance"), F.round(at[1], 6).alias("mid_year"), F.round(F.stddev_samp("year"), 6).alias("sd1"), F.round(F.stddev_pop("year"), 6).alias("sd0"),
        F.when(F.count("*") >= 2, F.round(F.var_pop("year"), 4)).alias("variance"), F.round(at[0], 6).alias("q25"), F.round(at[2], 6).alias("q75"),
    )


@query(f"""with {FACT}, n as (select commander_id, era, count(*) as n from fact group by 1, 2),
  o as (select commander_id, opponent, count(*) as n from fact group by 1, 2),
  a as (select commander_id, era, n, row_number() over (partition by commander_id order by n desc, era) as rn from n),
  b as (select commander_id, opponent, row_number() over (partition by commander_id order by n desc, opponent) as rn from o)
  select a.commander_id, a.era as main_era, a.n as era_n, b.opponent as main_opponent from a join b using (commander_id) where a.rn = 1 and b.rn = 1""")
def rel_mode_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of a group, ties to the smallest; the largest category with its count."""
    fact = engagements(spark, sf_dir)
    era = fact.groupBy("commander_id", "era").agg(F.count("*").alias("n"))
    era = era.groupBy("commander_id").agg(F.min_by(F.struct("era", "n"), F.struct(-F.col("n"), F.col("era"))).alias("x"))
    who = fact.groupBy("commander_id").agg(F.expr("mode() within group (order by opponent)").alias("main_opponent"))
    return era.select("commander_id", F.col("x.era").alias("main_era"), F.col("x.n").alias("era_n")).join(who, "commander_id")


@query(f"""with {FACT}, t as (select commander_id, unnest(string_split(opponent, ' ')) as word from fact)
  select commander_id, string_agg(distinct word, ' | ' order by word) as words, count(*) as tokens from t group by 1""")
def rel_collect_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List-strings: explode, count, and the sorted distinct values joined again."""
    word = engagements(spark, sf_dir).select("commander_id", F.explode(F.split("opponent", " ")).alias("word"))
    return word.groupBy("commander_id").agg(F.array_join(F.array_sort(F.collect_set("word")), " | ").alias("words"), F.count("*").alias("tokens"))


@query(f"""with {FACT}, t as (select commander_id, count(*) as n, count_if(page_type = 'battle_article')::bigint as battle, count_if(page_type = 'operation_article')::bigint as operation,
  count_if(page_type = 'campaign_article')::bigint as campaign, count_if(page_type = 'war_conflict_article')::bigint as war from fact group by 1)
  select commander_id, battle, operation, campaign, war, round(battle / n::double, 6) as battle_share, round(n / sum(n) over ()::double, 6) as of_all from t""")
def rel_pivot_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of fixed categories as columns (zero where absent), and shares of the group and of all."""
    kinds = {"battle": "battle_article", "operation": "operation_article", "campaign": "campaign_article", "war": "war_conflict_article"}
    wide = rel.pivot_fill(engagements(spark, sf_dir), ["commander_id"], "page_type", list(kinds.values()), F.count(F.lit(1)))
    wide = wide.withColumnsRenamed({v: k for k, v in kinds.items()})
    n = sum((F.col(k) for k in kinds), F.lit(0))
    return wide.select("commander_id", *kinds, F.round(ratio(F.col("battle"), n), 6).alias("battle_share"), F.round(share_over(n), 6).alias("of_all"))


@query(f"""with {FACT}, t as (select commander_id, max(year) as a, min(year) as b, avg(year)::int as c from fact group by 1), u as (select commander_id, unnest([a, b, c]) as v, unnest(['a', 'b', 'c']) as name from t)
  select commander_id, count(v) as n, min(v) as lo, max(v) as hi, max(v) - min(v) as range, count_if(v <= 1500)::bigint as early, round(quantile_cont(v, 0.25), 6) as q25, round(median(v), 6) as mid from u group by 1""")
def rel_unpivot_rowwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates across columns of a wide row: unpivoted, then grouped."""
    wide = engagements(spark, sf_dir).groupBy("commander_id").agg(F.max("year").alias("a"), F.min("year").alias("b"), F.bround(F.avg("year")).cast("int").alias("c"))
    v = F.col("v")
    return wide.unpivot("commander_id", ["a", "b", "c"], "name", "v").groupBy("commander_id").agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), (F.max("v") - F.min("v")).alias("range"), F.count_if(v <= 1500).alias("early"), F.round(F.percentile(v.cast("double"), F.lit(0.25)), 6).alias("q25"), F.round(F.median("v"), 6).alias("mid")
    )


@query(f"""with {FACT} select count(*) as rows, count(distinct commander_id) as commanders, count_if(outcome = 'unknown')::bigint as unknown,
  format('{{:.1f}}%', 100.0 * count_if(strict) / count(*)) as strict_share, (select count(*) from supplier) as suppliers, (select count(*) from orders) as pages from fact""")
def rel_global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of metrics over several frames: each is one aggregate, and one-row frames meet."""
    fact = engagements(spark, sf_dir).agg(F.count("*").alias("rows"), F.countDistinct("commander_id").alias("commanders"), F.count_if(F.col("outcome") == "unknown").alias("unknown"), F.format_string("%.1f%%", 100.0 * F.count_if("strict") / F.count("*")).alias("strict_share"))
    return rel.beside(fact, table(spark, sf_dir, "supplier").agg(F.count("*").alias("suppliers")), table(spark, sf_dir, "orders").agg(F.count("*").alias("pages")))


@query("""with r as (select user_id, event_type, event_id, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn, count(*) over (partition by user_id, event_type) as n from events)
  select user_id, event_type, event_id, round(value, 6) as value, n > 1 as repeated from r where rn = 1""")
def rel_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of a key, as a mergeable aggregate rather than a sort."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last.alias("x"), F.count("*").alias("n"))
    return rows.select("user_id", "event_type", "x.event_id", F.round("x.value", 6).alias("value"), (F.col("n") > 1).alias("repeated"))


@query("""with p as (select o_orderpriority as kind, o_custkey, max(o_totalprice) as best, count(*) as n from orders group by 1, 2),
  r as (select *, row_number() over (partition by kind order by best desc, n desc, o_custkey) as rn from p)
  select kind, o_custkey, rn, row_number() over (order by rn, kind) as place, ((rn - 1) % 4)::int as shard from r""")
def rel_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities from maxima and counts, fair interleaving of kinds, round-robin shards, over all rows.

    The place in the global order needs no global sort: before a row stand, of each kind, the rows of lower rank, and of kinds
    that sort earlier one of the same rank.
    """
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind"), "o_custkey").agg(F.max("o_totalprice").alias("best"), F.count("*").alias("n"))
    own = shared_table(own, "priorities")
    r = ordered_ranks(own, ["kind"], [F.desc("best"), F.desc("n"), F.asc("o_custkey")], "rn")
    # One row a kind, in one array.
    sizes = own.groupBy("kind").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("kind", "n")).alias("sizes"))
    ahead = F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, k: acc + F.least(k["n"], F.col("rn") - 1) + ((k["kind"] <= F.col("kind")) & (k["n"] >= F.col("rn"))).cast("long"))
    return rel.beside(r, sizes).select("kind", "o_custkey", F.col("rn").cast("long").alias("rn"), ahead.alias("place"), F.pmod(F.col("rn") - 1, F.lit(4)).cast("int").alias("shard"))


@query(f"""with {FACT} select era, page_type, outcome, count(*) as n, (grouping(era) * 4 + grouping(page_type) * 2 + grouping(outcome))::bigint as level
  from fact group by grouping sets ((era), (page_type), (outcome), (era, page_type), ())""")
def rel_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several facet counts in one pass."""
    e, p, o = F.col("era"), F.col("page_type"), F.col("outcome")
    sets = engagements(spark, sf_dir).groupingSets([[e], [p], [o], [e, p], []], e, p, o)
    return sets.agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(f"""with {FACT}, t as (select era, commander_id, count(*) as n from fact group by 1, 2)
  select era, commander_id, n, round(case when count(*) over (partition by era) = 1 then 100 else 100 * (rank() over (partition by era order by n) + (count(*) over (partition by era, n) - 1) / 2.0) / count(*) over (partition by era) end, 6) as pct,
    row_number() over (partition by era order by n desc, commander_id)::int as place from t""")
def rel_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-tie percentile ranks and unique ranks inside groups."""
    t = engagements(spark, sf_dir).groupBy("era", "commander_id").agg(F.count("*").alias("n"))
    t = percentile_ranks(shared_table(t, "sizes"), ["era"], "n", "pct")
    return ordered_ranks(t, ["era"], [F.desc("n"), F.asc("commander_id")], "place").withColumn("pct", F.round("pct", 6))


@query("""with h as (select doc_id, md5(text) as h, count(*) over (partition by md5(text)) as n, row_number() over (partition by md5(text) order by doc_id) as rn from documents)
  select doc_id, n > 1 as in_group, rn > 1 as later from h""")
def rel_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of duplicate keys, and the second and later of each."""
    w = Window.partitionBy("h")
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return d.select("doc_id", (F.count("*").over(w) > 1).alias("in_group"), (F.row_number().over(w.orderBy("doc_id")) > 1).alias("later"))


@query(f"""with {FACT}, t as (select commander_id, count(*) as n, count_if(outcome in ('victory', 'decisive_victory')) as v from fact group by 1),
  r as (select commander_id, row_number() over (order by n desc, commander_id) as a, row_number() over (order by v desc, commander_id) as b from t)
  select commander_id, a as rank_size, b as rank_wins, b - a as moved, case when b < a then 'rise' when b > a then 'fall' else 'same' end as way, abs(a - b) as gap from r where least(a, b) <= 50""")
def rel_rank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement between two rankings among the union of their top 50."""
    t = engagements(spark, sf_dir).groupBy("commander_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome").isin("victory", "decisive_victory")).alias("v"))
    r = ordered_ranks(t, [], [F.desc("n"), F.asc("commander_id")], "a")
    r = ordered_ranks(r, [], [F.desc("v"), F.asc("commander_id")], "b").withColumns({c: F.col(c).cast("long") for c in "ab"})
    way = F.when(F.col("b") < F.col("a"), "rise").when(F.col("b") > F.col("a"), "fall").otherwise("same")
    return r.filter(F.least("a", "b") <= 50).select("commander_id", F.col("a").alias("rank_size"), F.col("b").alias("rank_wins"), (F.col("b") - F.col("a")).alias("moved"), way.alias("way"), F.abs(F.col("a") - F.col("b")).alias("gap"))


@query("""with r as (select c_mktsegment, c_custkey, round(c_acctbal, 2) as bal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rn from customer),
  k as (select unnest([25, 50, 100]) as k) select k::int as k, c_mktsegment, c_custkey, bal, rn::int as rn from r join k on rn <= k""")
def rel_top_k_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 25, 50 and 100 of each group: ranked once, each row exploded to the sizes it belongs to."""
    top = top_by(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 100)
    sizes = F.array(F.lit(25), F.lit(50), F.lit(100))
    return top.select(F.explode(F.filter(sizes, lambda k: k >= F.col("rn"))).alias("k"), "c_mktsegment", "c_custkey", F.round("c_acctbal", 2).alias("bal"), "rn")


@query("""with b as (select c_mktsegment, c_custkey, case when c_acctbal > 8000 then 1 when c_acctbal > 4000 then 2 else 3 end as band, c_acctbal from customer),
  r as (select *, row_number() over (partition by c_mktsegment order by band, c_acctbal desc, c_custkey) as slot, count_if(band = 1) over (partition by c_mktsegment) as robust from b)
  select c_mktsegment, c_custkey, band, slot::int as slot from r where slot <= 12 and (band < 3 or slot > robust)""")
def rel_fill_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota by priority band: robust rows first, then strong, then fallback ones until a group has its slots."""
    bal = F.col("c_acctbal")
    b = table(spark, sf_dir, "customer").withColumn("band", F.when(bal > 8000, 1).when(bal > 4000, 2).otherwise(3))
    b = b.withColumn("robust", F.count_if(F.col("band") == 1).over(Window.partitionBy("c_mktsegment")))
    r = top_by(b, ["c_mktsegment"], [F.asc("band"), F.desc("c_acctbal"), F.asc("c_custkey")], 12).withColumnRenamed("rn", "slot")
    return r.filter((F.col("band") < 3) | (F.col("slot") > F.col("robust"))).select("c_mktsegment", "c_custkey", "band", "slot")


@query("""with c as (select l_orderkey, l_linenumber, (l_discount > 0.05)::int + (l_tax > 0.04)::int as blockers, l_quantity as evidence from lineitem),
  r as (select *, row_number() over (partition by l_orderkey order by blockers, evidence desc, l_linenumber) as rn from c)
  select l_orderkey, min(l_linenumber)::bigint as line, min(blockers)::int as blockers, min(evidence) as evidence from r where rn = 1 group by 1""")
def rel_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate with the fewest blockers, then the most evidence."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), ((F.col("l_discount") > 0.05).cast("int") + (F.col("l_tax") > 0.04).cast("int")).alias("blockers"), F.col("l_quantity").alias("evidence"))
    best = F.min_by(F.struct("line", "blockers", "evidence"), F.struct(F.col("blockers"), -F.col("evidence"), F.col("line")))
    return c.groupBy("l_orderkey").agg(best.alias("x")).select("l_orderkey", "x.line", "x.blockers", "x.evidence")


@query("""with u as (select o_custkey as k from orders where o_orderpriority = '1-URGENT' union select o_custkey from orders where o_totalprice > 200000),
  i as (select o_custkey as k from orders where o_orderpriority = '1-URGENT' intersect select o_custkey from orders where o_totalprice > 200000),
  d as (select k from u except select k from i)
  select (select count(*) from u) as united, (select count(*) from i) as shared, (select count(*) from d) as apart,
    not exists (select o_custkey from orders where o_totalprice > 400000 except select o_custkey from orders where o_totalprice > 200000) as inside,
    not exists (select o_custkey from orders where o_totalprice > 200000 except select o_custkey from orders where o_orderpriority = '1-URGENT') as chained""")
def rel_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, difference and subset tests of id sets: one pass with a flag for each set and key instead of joins.

    A set is inside another where no key has its flag alone; here one test holds by the data's limits and one does not.
    """
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.max(F.col("o_totalprice") > 200000).alias("b"), F.max(F.col("o_totalprice") > 400000).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return o.agg(F.count_if(a | b).alias("united"), F.count_if(a & b).alias("shared"), F.count_if(a != b).alias("apart"), (F.count_if(c & ~b) == 0).alias("inside"), (F.count_if(b & ~a) == 0).alias("chained"))


@query("""with e as (select user_id, event_type, unnest([lower(event_type), lower(event_type) || '_' || (event_id % 3)]) as tag, event_id from events)
  select user_id, string_agg(distinct tag, ' | ' order by tag) as tags, count(distinct event_id) as merged, min(event_id) as first_id from e group by 1""")
def rel_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one id merged, their provenance lists united."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.array(F.lower("event_type"), F.concat(F.lower("event_type"), F.lit("_"), (F.col("event_id") % 3).cast("string"))).alias("tags"))
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), " | ").alias("tags"), F.count_distinct("event_id").alias("merged"), F.min("event_id").alias("first_id"))


@query("""with d as (select *, case when l_quantity < 2 then 'removed' when l_discount > 0.09 then 'quarantine' else 'main' end as decision from lineitem)
  select decision, count(*) as n, round(sum(l_quantity), 4) as quantity, sum(count(*)) over ()::bigint = (select count(*) from lineitem) as complete from d group by 1""")
def rel_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row gets one decision, and the parts add up to the whole."""
    line = table(spark, sf_dir, "lineitem")
    parts = rel.route(line, {"removed": F.col("l_quantity") < 2, "quarantine": F.col("l_discount") > 0.09}, "main")
    n = parts.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))
    return rel.beside(n.withColumn("all", F.sum("n").over(Window.partitionBy())), line.agg(F.count("*").alias("rows"))).select("decision", "n", "quantity", (F.col("all") == F.col("rows")).alias("complete"))


@query("""select c_mktsegment, c_custkey, round(c_acctbal, 2) as bal, row_number() over (order by case c_mktsegment when 'MACHINERY' then 1 when 'BUILDING' then 2 else 3 end, case when c_acctbal < 0 then null else c_acctbal end desc nulls last, c_custkey)::int as place
  from customer""")
def rel_ordered_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort by an ordered category, mixed directions, nulls last: every row's place, by its rank in the category and the sizes of earlier ones."""
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", 1).when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(3)
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", kind.alias("kind"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("key"))
    r = ordered_ranks(c, ["kind"], [F.desc_nulls_last("key"), F.asc("c_custkey")], "rn")
    n = c.groupBy("kind").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = (F.col("rn") + F.col("before")).cast("int")
    return r.join(F.broadcast(n.select("kind", before.alias("before"))), "kind").select("c_mktsegment", "c_custkey", F.round("c_acctbal", 2).alias("bal"), place.alias("place"))


@query("""with a as (select s_suppkey, s_name, s_nationkey from supplier union all select s_suppkey + 1000000000, '  ' || upper(s_name) || ' ', s_nationkey from supplier where s_suppkey % 3 = 0),
  n as (select s_suppkey, lower(trim(s_name)) as k, s_nationkey from a), r as (select *, row_number() over (partition by s_nationkey, k order by s_suppkey) as rn, count(*) over (partition by s_nationkey, k) as n from n)
  select s_suppkey, k, s_nationkey, n as copies from r where rn = 1""")
def rel_keyed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a normalised composite key, the whole name and the nation, where a third of the names is also written with other case and blanks."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_nationkey")
    varied = s.filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 1000000000).alias("s_suppkey"), F.concat(F.lit("  "), F.upper("s_name"), F.lit(" ")).alias("s_name"), "s_nationkey")
    n = s.unionByName(varied).withColumn("k", F.lower(F.trim("s_name")))
    return n.groupBy("k", "s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"), F.count("*").alias("copies")).select("s_suppkey", "k", "s_nationkey", "copies")


@query("""select user_id, event_id, lag(event_type) over w as before, lead(value) over w as next_value, round(sum(value) over (w rows between unbounded preceding and current row), 6) as running, round(avg(value) over (w rows between 2 preceding and current row), 6) as mean3,
  count(*) over (partition by user_id order by epoch(ts)::bigint range between 3600 preceding and current row) as last_hour, ntile(4) over w as quarter from events window w as (partition by user_id order by ts, event_id)""")
def rel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring rows, running and sliding frames by rows and by range, quartile tiles; one shuffle by user serves all."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = Window.partitionBy("user_id").orderBy("second").rangeBetween(-3600, 0)
    e = table(spark, sf_dir, "events").withColumn("second", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0 + 0.5))
    return e.select(
        "user_id", "event_id", F.lag("event_type").over(w).alias("before"), F.lead("value").over(w).alias("next_value"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"),
        F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("mean3"), F.count("*").over(hour).alias("last_hour"), F.ntile(4).over(w).alias("quarter"),
    )


@query("""with v as (select p_brand, case when p_partkey % 5 = 0 then 'nan'::double when p_partkey % 7 = 0 then null else p_size::double end as x from part)
  select p_brand, count_if(x >= 20 and not isnan(x)) as large, count_if(x < 20 and not isnan(x)) as small, count_if(isnan(x)) as nans, count_if(x is null) as nulls, max(case when not isnan(x) then x end) as most from v group by 1""")
def rel_nan_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons in which NaN and null are false, though both languages sort NaN above all numbers."""
    x = F.when(F.col("p_partkey") % 5 == 0, float("nan")).when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("p_size").cast("double"))
    v = table(spark, sf_dir, "part").select("p_brand", x.alias("x"))
    real = F.nanvl("x", F.lit(None).cast("double"))
    return v.groupBy("p_brand").agg(F.count_if(real >= 20).alias("large"), F.count_if(real < 20).alias("small"), F.count_if(F.isnan("x")).alias("nans"), F.count_if(F.col("x").isNull()).alias("nulls"), F.max(real).alias("most"))


@query("select o_orderpriority, true as close, count(distinct o_custkey) as exact from orders group by 1")
def rel_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch's distinct count held against the exact one: within a tenth, with a sketch of 2 % standard error."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("about"), F.countDistinct("o_custkey").alias("exact"))
    return o.select("o_orderpriority", (F.abs(F.col("about") - F.col("exact")) <= F.greatest(0.1 * F.col("exact"), F.lit(2.0))).alias("close"), "exact")


@query("""with r as (select p_brand, p_size, row_number() over (partition by p_brand order by p_size) as rn, count(*) over (partition by p_brand) as n from part) select p_brand, max(p_size)::int as upper, n from r where rn = n // 2 + 1 group by 1, 3""")
def rel_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median, from counts of values: the first value whose running count passes half the rows."""
    v = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("k"))
    w = Window.partitionBy("p_brand")
    v = v.withColumns({"n": F.sum("k").over(w), "upto": F.sum("k").over(w.orderBy("p_size"))})
    return v.filter("upto > n div 2").groupBy("p_brand", "n").agg(F.min("p_size").cast("int").alias("upper")).select("p_brand", "upper", "n")


@query("""with up as (select 'asc' as way, c_custkey, v, row_number() over (order by v asc nulls last, c_custkey) as place from (select c_custkey, case when c_acctbal < 0 then null else round(c_acctbal, 2) end as v from customer)),
  down as (select 'desc', c_custkey, v, row_number() over (order by v desc nulls last, c_custkey) as place from (select c_custkey, case when c_acctbal < 0 then null else round(c_acctbal, 2) end as v from customer)),
  t as (select 'text' as way, c_custkey, null::double as v, row_number() over (order by lower(c_name) desc nulls last, c_custkey) as place from customer) select way, c_custkey, v, place::int as place from (select * from up union all select * from down union all select * from t) where place <= 120""")
def rel_view_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table view of 120 rows, sorted by any column in either direction, nulls last, text without regard to case."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.round("c_acctbal", 2)).alias("v"))
    views = [("asc", rel.view(c, "v", False, ["c_custkey"], 120)), ("desc", rel.view(c, "v", True, ["c_custkey"], 120)), ("text", rel.view(c, "c_name", True, ["c_custkey"], 120).withColumn("v", F.lit(None).cast("double")))]
    parts = [v.select(F.lit(way).alias("way"), "c_custkey", "v", "place") for way, v in views]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select event_id, event_type, row_number() over (order by event_id)::bigint as seq from events")
def rel_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers in input order, from the rows of each part and the sum of the parts before; no global sort."""
    return rel.numbered(table(spark, sf_dir, "events").select("event_id", "event_type"), "seq")


@query("""with a as (select s_nationkey as k, count(*) as n, round(sum(s_acctbal), 2) as total from supplier group by 1), b as (select c_nationkey as k, count(*) as n, round(sum(c_acctbal), 2) as total, max(c_custkey) as last from customer group by 1)
  select coalesce(a.k, b.k) as k, a.n as n_supplier, b.n as n_customer, a.total as total_supplier, b.total as total_customer, last from a full join b on a.k = b.k""")
def rel_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of one name on both sides get a suffix each, others keep theirs."""
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
    b = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max("c_custkey").alias("last"))
    return rel.join_suffixed(a, b, ["k"], ("_supplier", "_customer"), "full")


@query("""with a as (select o_custkey as id, count(*) as urgent from orders where o_orderpriority = '1-URGENT' group by 1), b as (select o_custkey as id, count(*) as high from orders where o_orderpriority = '2-HIGH' group by 1), c as (select o_custkey as id, round(max(o_totalprice), 2) as dearest from orders where o_totalprice > 250000 group by 1),
  spine as (select id from a union select id from b union select id from c) select id, urgent, high, dearest from spine left join a using (id) left join b using (id) left join c using (id)""")
def rel_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several frames joined onto the union of their ids."""
    o = table(spark, sf_dir, "orders")
    n = lambda p, c: o.filter(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias(c))
    dear = o.filter("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.max("o_totalprice"), 2).alias("dearest"))
    return rel.on_spine(["id"], n("1-URGENT", "urgent"), n("2-HIGH", "high"), dear)


@query("""with d as (select s_suppkey, case when s_suppkey % 3 = 0 then 'https://x/' || s_suppkey end as url, lower(s_name) as name, s_nationkey as v from supplier), l as (select s_suppkey as id, case when s_suppkey % 2 = 0 then 'https://x/' || s_suppkey end as url, upper(s_name) as name from supplier)
  select id, coalesce(a.v, b.v) as v, case when a.v is not null then 'url' when b.v is not null then 'name' else 'none' end as by_key from l left join d a on a.url = l.url left join d b on b.name = lower(l.name) and l.id % 5 <> 0""")
def rel_second_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by one key, and for misses by another."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    link = lambda n: F.when(key % n == 0, F.concat(F.lit("https://x/"), key.cast("string")))
    d = s.select(link(3).alias("url"), F.lower("s_name").alias("name"), F.col("s_nationkey").alias("v"))
    rows = s.select(key.alias("id"), link(2).alias("url"), F.when(key % 5 != 0, F.lower("s_name")).alias("name"))
    by_url = d.filter("url is not null").select("url", F.col("v").alias("v1"))
    out = rows.join(by_url, "url", "left").join(d.select("name", F.col("v").alias("v2")), "name", "left")
    return out.select("id", F.coalesce("v1", "v2").alias("v"), F.when(F.col("v1").isNotNull(), "url").when(F.col("v2").isNotNull(), "name").otherwise("none").alias("by_key"))


@query("""with p as (select p_partkey, p_size, p_name from part), r as (select p_partkey, 'http://en.x.org/wiki/' || replace(p_name, ' ', '_') || '?a=1#b' as u1, 'https://en.x.org/wiki/' || replace(p_name, ' ', '_') as u2, case p_partkey % 3 when 0 then 'TRUE' when 1 then '0' else 'yes' end as b1, case p_partkey % 2 when 0 then '1' else 'no' end as b2,
  '  ' || p_name || ' ' as t1, case when p_partkey % 4 = 0 then upper(p_name) else replace(p_name, ' ', '  ') end as t2, case when p_partkey % 6 = 0 then 'n/a' else p_size || '.0000000001' end as f1, case when p_partkey % 6 = 0 then null else p_size::varchar end as f2 from p)
  select p_partkey, true as same_url, (b1 in ('TRUE', 'yes')) = (b2 = '1') as same_flag, trim(regexp_replace(t1, '\\s+', ' ', 'g')) = trim(regexp_replace(t2, '\\s+', ' ', 'g')) as same_text, coalesce(abs(try_cast(f1 as double) - try_cast(f2 as double)) <= 1e-6, try_cast(f1 as double) is null and try_cast(f2 as double) is null) as same_number, coalesce(try_cast(f1 as double)::int, -1) as number from r""")
def rel_field_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality by kind of field: links by their canonical form, flags by meaning, text without blanks, numbers within tolerance; and numbers out of text with a default."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    path = F.replace(name, F.lit(" "), F.lit("_"))
    r = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("http://en.x.org/wiki/"), path, F.lit("?a=1#b")).alias("u1"), F.concat(F.lit("https://en.x.org/wiki/"), path).alias("u2"), F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, "0").otherwise("yes").alias("b1"), F.when(k % 2 == 0, "1").otherwise("no").alias("b2"),
        F.concat(F.lit("  "), name, F.lit(" ")).alias("t1"), F.when(k % 4 == 0, F.upper(name)).otherwise(F.replace(name, F.lit(" "), F.lit("  "))).alias("t2"), F.when(k % 6 == 0, "n/a").otherwise(F.concat(size, F.lit(".0000000001"))).alias("f1"), F.when(k % 6 != 0, size).alias("f2"),
    )
    return r.select("p_partkey", rel.same_link(F.col("u1"), F.col("u2")).alias("same_url"), rel.same_flag(F.col("b1"), F.col("b2")).alias("same_flag"), rel.same_text(F.col("t1"), F.col("t2")).alias("same_text"), rel.near(rel.number(F.col("f1")), rel.number(F.col("f2"))).alias("same_number"), F.coalesce(rel.number(F.col("f1")).cast("int"), F.lit(-1)).alias("number"))
