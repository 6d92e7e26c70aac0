"""The winner of each page from its result, sides, commanders and title, over cells made of the nations that meet in an order.

Stand-ins of the binding: a nation's number names it by NAMES, and forms of results and titles are picked by the order's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.curation import ALIASES, ALLIED, COALITION, NEUTRAL, PHRASES, STOPWORDS
from lodestar.functions.winners import ACTOR_FORMS, ACTOR_PAGES, BY_ALIAS, CLEAR, NO_SIDE, TARGET, TARGET_END, winners
from lodestar.plans.binding import page_type_of, table
from lodestar.plans.registry import query

NAMES = ["France", "Nazi Germany", "China", "Tsardom of Russia", "United Kingdom", "United States", "Ottoman Empire", "Soviet Union", "Denmark-Norway", "Poland", "Austria", "Prussia", "Sweden", "Spain", "Persia", "Iran", "Japan", "Italy", "Greece", "Serbia", "Habsburg Monarchy", "Netherlands", "Hungary", "Turkey", "Allied forces"]
CALLED = ["French", "German", "Chinese", "Russian", "British", "American", "Ottoman", "Soviet", "Dano-Norwegian", "Polish", "Austrian", "Prussian", "Swedish", "Spanish", "Persian", "Iranian", "Japanese", "Italian", "Greek", "Serbian", "Imperial", "Dutch", "Hungarian", "Turkish", "Allied"]
RESULT_FORMS = ["{A} victory", "Anti-{A} coalition victory", "Victory against {B}", "Allied victory", "Coalition victory", "Victory", "Defeat", "Decisive {B} victory", "Indecisive", "Combined fleet victory", "", "{A} victory[2] against {B} forces", "Anti-{B} victory", "Victory of the alliance", "Tactical {C} victory", "{A} and {C} victory", "Victory against {A} and {B} troops"]
TITLE_FORMS = ["{A} invasion of {B}", "Battle of {B}", "1848 {A} offensive in {B}", "{C} campaign against {A}", "{A} intervention in {B}", "1812 {A} expedition to {B}", "{C} occupation of {B}", "Siege of {A}"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page an order: the customer's nation against those of its lines' suppliers, by the lines' status."""
    named = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n")), "l_suppkey")
    sides = line.groupBy(F.col("l_orderkey").alias("page_id")).agg(
        F.max("n").alias("most"), F.min("n").alias("least"), F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "F", named(NAMES, F.col("n"))))).alias("b"), F.array_sort(F.collect_set(F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") >= 40), named(NAMES, F.col("n"))))).alias("c")
    )  # an order's lines are few
    order = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("own")), "o_custkey")
    page, a = F.col("page_id"), named(NAMES, F.col("own"))
    filled = lambda form: F.replace(F.replace(F.replace(form, F.lit("{A}"), named(CALLED, F.col("own"))), F.lit("{B}"), named(NAMES, F.col("most"))), F.lit("{C}"), named(CALLED, F.col("least")))
    rows = order.withColumnRenamed("o_orderkey", "page_id").join(sides, "page_id")
    made = rows.select(
        "page_id", filled(named(TITLE_FORMS, page)).alias("title"), page_type_of(F.col("o_orderpriority")).alias("page_type"), filled(named(RESULT_FORMS, page)).alias("result"),
        F.when(page % 9 == 0, F.concat(a, F.lit(" | Coalition forces"))).when(page % 9 == 1, F.concat(a, F.lit(" (1200 men)"))).when(page % 9 == 2, F.concat(F.lit("Flag.svg "), a, F.lit("[3]"))).otherwise(a).alias("bel_a"), F.lit(None).cast("string").alias("com_a"),
        F.array_join("b", "\n").alias("bel_b"), F.when(page % 5 == 0, F.concat(F.lit("Marshal of "), named(CALLED, F.col("own")))).alias("com_b"), F.array_join("c", "; ").alias("bel_c"), F.lit("").alias("com_c"),
    )
    low = F.lower("result")
    return made.withColumn("kind", F.when(low == "", "unknown").when(F.contains(low, F.lit("indecisive")), "indecisive").when(F.contains(low, F.lit("decisive")), "decisive_victory").when(F.contains(low, F.lit("tactical")), "tactical_victory").otherwise("victory"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rows(pairs: list[tuple[str, str]]) -> str:
    return "(values " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") t(k, v)"


def _at(text: str, token: str) -> str:
    """Where a token stands between other characters, from 0."""
    return f"case when contains({text}, {token}) and regexp_matches(' ' || {text} || ' ', '[^a-z0-9]' || {token} || '[^a-z0-9]') then length(regexp_extract(' ' || {text} || ' ', '^(.*?)[^a-z0-9]' || {token} || '[^a-z0-9]', 1)) end"


def _space(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '\[\d+\]', '', 'g'), '[\s\x{{a0}}]+', ' ', 'g'))"


def _title(c: str) -> str:
    return f"regexp_replace({_space(c)}, '[–—−]', '-', 'g')"


_NAMED = lambda values, k: f"{_list(values)}[{k} % {len(values)} + 1]"
_FILL = lambda form: f"replace(replace(replace({form}, '{{A}}', {_NAMED(CALLED, 'own')}), '{{B}}', {_NAMED(NAMES, 'most')}), '{{C}}', {_NAMED(CALLED, 'least_n')})"
_HINTS = lambda c, words: " + ".join(f"contains({c}, '{w}')::int" for w in words)
_ACTORS = "coalesce(" + ", ".join(("nullif(regexp_extract(tt, '(?i)" + f.replace(r"(?!\d{3,4}\b)", "") + "', 1), '')") if "(?!" not in f else rf"case when not regexp_matches(tt, '^\d{{3,4}}\b') then nullif(regexp_extract(tt, '(?i)" + f.replace(r"(?!\d{3,4}\b)", "") + "', 1), '') end" for f in ACTOR_FORMS) + ", '')"
_ALIAS = _rows([(k, a) for k, v in ALIASES.items() for a in v])
_PHRASE = _rows([(k, a) for k, v in PHRASES.items() for a in v])

CELLS = f"""meet as (select l_orderkey as page_id, max(s_nationkey) as most, min(s_nationkey) as least_n, array_to_string(list_sort(list_distinct(list({_NAMED(NAMES, 's_nationkey')}) filter (l_linestatus = 'F'))), chr(10)) as b, array_to_string(list_sort(list_distinct(list({_NAMED(NAMES, 's_nationkey')}) filter (l_linestatus = 'O' and l_quantity >= 40))), '; ') as c
  from lineitem join supplier on s_suppkey = l_suppkey group by 1),
raw as (select o_orderkey as page_id, c_nationkey as own, most, least_n, {_NAMED(NAMES, 'c_nationkey')} as a, b, c, case o_orderpriority when '1-URGENT' then 'battle_article' when '2-HIGH' then 'operation_article' when '3-MEDIUM' then 'campaign_article' else 'war_conflict_article' end as page_type
  from orders join customer on c_custkey = o_custkey join meet on page_id = o_orderkey),
page as (select page_id, page_type, {_FILL(_NAMED(TITLE_FORMS, 'page_id'))} as title, {_FILL(_NAMED(RESULT_FORMS, 'page_id'))} as result,
  case page_id % 9 when 0 then a || ' | Coalition forces' when 1 then a || ' (1200 men)' when 2 then 'Flag.svg ' || a || '[3]' else a end as bel_a, null as com_a, coalesce(b, '') as bel_b, case when page_id % 5 = 0 then 'Marshal of ' || {_NAMED(CALLED, 'own')} end as com_b, coalesce(c, '') as bel_c, '' as com_c from raw),
pages as (select *, case when result = '' then 'unknown' when lower(result) like '%indecisive%' then 'indecisive' when lower(result) like '%decisive%' then 'decisive_victory' when lower(result) like '%tactical%' then 'tactical_victory' else 'victory' end as kind from page)"""

WINNERS = f"""p as materialized (select page_id, page_type, kind, lower({_space('result')}) as r, {_title('title')} as tt from pages),
pa as materialized (select *, lower({_title(rf"regexp_replace({_ACTORS}, '^\d{{3,4}}\s+', '')")}) as actor from p),
side as materialized (select page_id, 'side_a' as side, bel_a as bel, com_a as com from pages union all select page_id, 'side_b', bel_b, com_b from pages union all select page_id, 'side_c', bel_c, com_c from pages),
cell as (select page_id, side, 'bel' as w, unnest(string_split_regex(bel, '[\\n|;/]+')) as x, generate_subscripts(string_split_regex(bel, '[\\n|;/]+'), 1) as i from side union all select page_id, side, 'com', unnest(string_split_regex(com, '[\\n|;/]+')), generate_subscripts(string_split_regex(com, '[\\n|;/]+'), 1) from side),
clean as (select *, {_space(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(X, '\b\w+\.svg\b', '', 'gi'), '\b\d+px\b', '', 'gi'), '\([^)]*\)', '', 'g'), '[''"“”‘’]', '', 'g')""".replace("X", _title("x")))} as e from cell),
keyed as (select *, regexp_replace(regexp_replace(lower(regexp_replace(e, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g') as key from clean where e <> ''),
ent as materialized (select * from keyed where key <> '' and not list_contains({_list(STOPWORDS)}, key) qualify row_number() over (partition by page_id, side, w, key order by i) = 1),
low as materialized (select page_id, side, w, trim(regexp_replace(regexp_replace(lower(e), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) as low, replace(trim(regexp_replace(regexp_replace(lower(e), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')), '-', ' ') as flat from ent),
word as materialized (select page_id, side, w, flat, word from (select *, unnest(string_split_regex(flat, '\\s+')) as word from low) where length(word) >= 4 and not list_contains({_list(STOPWORDS)}, word)),
tok as materialized (select distinct page_id, side, w, t from (select page_id, side, w, low as t from low union all select page_id, side, w, trim(regexp_replace(flat, '\\s+', ' ', 'g')) from low union all select page_id, side, w, word from word union all select page_id, side, w, v from word join {_ALIAS} on k = word
  union all select page_id, side, w, v from low join {_PHRASE} on contains(flat, k) union all select page_id, side, w, v from low join {_PHRASE} on k = 'denmark norway' where list_contains(string_split_regex(flat, '\\s+'), 'denmark') and list_contains(string_split_regex(flat, '\\s+'), 'norway')) where length(t) >= 4),
aim as materialized (select page_id, {_space(rf"regexp_replace(regexp_replace(m, '{TARGET_END}.*$', ''), '^[ -]+|[ -]+$', '', 'g')")} as phrase from (select page_id, unnest(regexp_extract_all(r, '{TARGET}', 1)) as m from p)),
aimed as (select page_id, phrase, unnest(string_split_regex(phrase, '[\\s-]+')) as word from aim where phrase <> ''),
target as materialized (select distinct page_id, t from (select page_id, phrase as t from aim where phrase <> '' union all select page_id, word from aimed where length(word) >= 3 and not list_contains({_list(STOPWORDS)}, word) union all select page_id, v from aimed join {_ALIAS} on k = word where not list_contains({_list(STOPWORDS)}, word) and length(word) >= 3 union all select page_id, v from aim join {_PHRASE} on contains(phrase, k)) where length(t) >= 3),
lows as materialized (select page_id, side, lower({_space('bel')}) as bel, lower({_space('com')}) as com, lower({_title('bel')}) as shown from side),
hit as (select page_id, side, min(pos) as pos, count(pos) as hits from (select page_id, side, {_at('bel', 't')} as pos from lows join target using (page_id) union all select page_id, side, {_at('com', 't')} from lows join target using (page_id)) where pos is not null group by 1, 2),
said as (select page_id, side, bool_or({_at('r', 't')} is not null) as met, bool_or(contains(r, t) and regexp_matches(r || ' ', '(anti[-\\s]+|against\\s+)' || t || '[^a-z0-9]')) as negated from tok join p using (page_id) group by 1, 2),
canon as (select page_id, side, count(distinct k) as canon from lows join (select k, unnest([k, v]) as m from {_ALIAS}) on {_at('bel', 'm')} is not null group by 1, 2),
many as (select page_id, side, count(*) as ents from ent where w = 'bel' group by 1, 2),
doer as (select page_id, unnest(string_split_regex(actor, '[^a-z0-9]+')) as word from pa where actor <> ''),
loose as (select distinct d.page_id, tok.side from doer d join {_rows([(a, k) for a, v in BY_ALIAS.items() for k in v])} on k = word join tok on tok.page_id = d.page_id and tok.w = 'bel' and tok.t = v where length(word) >= 4 and not list_contains({_list(NO_SIDE)}, word)),
f as materialized (select l.page_id, l.side, bel <> '' as there, pos, coalesce(hits, 0) as hits, coalesce(met, false) as met, coalesce(negated, false) as negated, coalesce(ents, 0) + coalesce(canon, 0) + 4 * ({_HINTS('bel', COALITION)}) as strength, ({_HINTS('bel', COALITION)}) > 0 as label,
  coalesce(ents, 0) >= 2 or coalesce(canon, 0) >= 2 or contains(bel, '*') or ({_HINTS('bel', COALITION)}) > 0 as coalition, {_HINTS('bel', ALLIED)} as allied, actor <> '' and bel <> '' and contains(shown, actor) as exact, loose.side is not null and bel <> '' as near
  from lows l join pa using (page_id) left join hit using (page_id, side) left join said using (page_id, side) left join canon using (page_id, side) left join many using (page_id, side) left join loose using (page_id, side)),
h as (select page_id, list(struct_pack(pos := pos, minus := -hits, side := side) order by pos, -hits, side) as h from f where hits > 0 group by 1),
loser as (select page_id, case when len(h) = 1 or h[1].pos + {CLEAR} <= h[2].pos or (h[1].pos < h[2].pos and h[1].minus <= h[2].minus) then h[1].side end as loser from h),
g as (select page_id, list(side order by side) filter (there) as there, coalesce(list(side) filter (negated), []) as neg, coalesce(list(side) filter (met), []) as met, coalesce(list(side) filter (there and coalition), []) as col, coalesce(list(side) filter (there and label), []) as lab, coalesce(list(side) filter (exact), []) as exact, coalesce(list(side) filter (exact or near), []) as near,
  list(struct_pack(n := allied, side := side) order by -allied, side) filter (there) as allied, list(struct_pack(n := strength, side := side) order by -strength, side) filter (there) as strong from f group by 1),
u as (select pa.*, g.* exclude (page_id), loser, case when len(neg) = 1 then neg[1] end as bad, ({_HINTS('r', COALITION)}) > 0 as hint, case when len(exact) = 1 then exact[1] when len(near) = 1 then near[1] end as acted from pa join g using (page_id) left join loser using (page_id)),
o as (select *, list_filter(there, lambda x: x <> loser) as ol, list_filter(col, lambda x: x <> loser) as cl, list_filter(there, lambda x: x <> bad) as ob, list_filter(met, lambda x: x <> bad) as mb, list_filter(col, lambda x: x <> bad) as cb, list_filter(there, lambda x: x <> acted) as oa from u),
won as (select page_id, case when r = '' or kind in ('', 'unknown', {", ".join(f"'{n}'" for n in NEUTRAL)}) then null
  when loser is not null and len(ol) = 1 then ol[1] || ' negated_target_match' when loser is not null and len(cl) = 1 then cl[1] || ' negated_target_match'
  when (contains(r, 'allied') or contains(r, 'coalition')) and allied[1].n > 0 and coalesce(allied[2].n, 0) = 0 then allied[1].side || ' allied_marker_match'
  when bad is not null then case when len(ob) = 1 then ob[1] || ' negated_target_match' when len(mb) = 1 then mb[1] || ' negated_target_match' when len(cb) = 1 then cb[1] || ' negated_target_match' end
  when len(met) = 1 then met[1] || ' unique_belligerent_match'
  when page_type in ({", ".join(f"'{n}'" for n in ACTOR_PAGES)}) and actor <> '' and r = 'victory' and acted is not null then acted || ' generic_actor_title_match'
  when page_type in ({", ".join(f"'{n}'" for n in ACTOR_PAGES)}) and actor <> '' and r = 'defeat' and acted is not null and len(oa) = 1 then oa[1] || ' generic_actor_title_match'
  when hint and len(lab) = 1 then lab[1] || ' coalition_label_match' when hint and len(col) = 1 then col[1] || ' coalition_side_heuristic'
  when hint and (len(strong) >= 2 and strong[1].n >= strong[2].n + 2 or len(strong) = 1 and strong[1].n > 0) then strong[1].side || ' coalition_strength_heuristic' end as found from o)"""


@query(f"with {CELLS}, {WINNERS} select page_id, title, result, nullif(split_part(coalesce(found, ''), ' ', 1), '') as win_side, coalesce(split_part(found, ' ', 2), 'unresolved') as method from won join pages using (page_id)")
def rule_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner of every page among up to three sides, and the method that told it."""
    return winners(cells(spark, sf_dir)).select("page_id", "title", "result", "win_side", "method")
