"""Queries of page and name curation: classifiers, result inference, name rules, candidates, rebuild decisions, audits.

The cells stand for scraped ones: each row of the part table picks a title, categories, a result and so on from short lists.
Every query is a chain of layers of named expressions, the same text for both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import curation as c
from lodestar.functions.curation import OTHER, SPARK, Dialect
from lodestar.functions.text import RESULTS
from lodestar.operators.relational import spread
from lodestar.operators.tables import shared_table
from lodestar.operators.windows import ordered_ranks
from lodestar.plans.binding import FACT, engagements, table
from lodestar.plans.registry import query

TITLES = ["Battle of Alpha", "Siege of Beta (1204)", "Operation Gamma", "Gamma campaign", "First Delta War", "List of battles 1400–1500", "Order of battle at Alpha", "General Epsilon", "1204", "Category:Sieges", "Raid on Zeta", "Eta offensive in Africa", "Theta massacre", "Air assault", "Zhang Xiu (warlord)", "Military history of Iota", "Kappa division"]
CATEGORIES = ["battles of 1204 | sieges", "military operations", "wars | conflicts", "1900 births | 1950 deaths", "lists of battles", "", "infantry | tactics"]
RESULT = ["Roman victoryDaryaee 2010", "Decisive Allied victory", "Allied operational success", "Inconclusive", "Status quo ante bellum", "Union victory", "Axis operational success", "See aftermath although some authors disagree", "", "Soviet victory", "Ottoman victory against Habsburg forces", "French victory and second British victory", "anti Swedish coalition victory", "Victory", "defeat", "Pyrrhic victory", "Draw"]
SIDES_A = ["Roman Empire", "Soviet Union; Poland", "Ottoman Empire", "Union", "First French Empire / Kingdom of Italy", "Allied powers (1915)", ""]
SIDES_B = ["Sasanian Persia", "Nazi Germany | Italy", "Habsburg monarchy", "Confederate States", "Great Britain", "Swedish Empire", "government"]
NAMES = ["General John Smith (KIA)", "Roman Empire Julius Caesar", "de Charles Martel fr", "Flag of Gaul.svg 20px", "unknown", "Colonel Ratko", '"Tiger"', "Major General", "5th Division", "according to Tacitus", "Hannibal | Hasdrubal", "Napoleon Bonaparte", "", "Bonaparte", "Admiral  Nelson [2]", "Louis II 3"]
LINKS = ["John Smith", "Julius Caesar", "Charles Martel", "Flag of Gaul", "", "Ratko Mladic", "Tiger I", "Roman Empire", "5th Division", "", "Hannibal", "Napoleon", "fr:Napoleon", "Napoleon Bonaparte", "Horatio Nelson", "Louis II"]
NAME_CATEGORIES = ["1900 births | generals", "military units", "flags | emblems", "", "kings | wars", "people | states | countries"]
DATES = ["12 March 1204", "1805", "about 1066", "edition of 1990", "", "no year", "9999"]
STRENGTHS = ["about 12,000 men", "300–500 ships", "many", "1, 22 and 333"]


def pick(d: Dialect, values: list[str], every: int) -> str:
    if d.spark:
        return f"element_at(array({', '.join(repr(v) for v in values)}), cast(1 + (p_partkey div {every}) % {len(values)} as int))"
    return f"([{', '.join(chr(39) + v + chr(39) for v in values)}])[1 + (p_partkey // {every}) % {len(values)}]"


def chain(d: Dialect, layers: list[dict[str, str]]) -> str:
    """The layers as common table expressions of the other language."""
    out = []
    for k, layer in enumerate(layers):
        out.append(f"l{k + 1} as (select *, {', '.join(f'{v} as {n}' for n, v in layer.items())} from {f'l{k}' if k else 'part'})")
    return ", ".join(out)


def built(spark: SparkSession, sf_dir: str, layers: list[dict[str, str]]) -> DataFrame:
    df = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    for layer in layers:
        df = df.selectExpr("*", *(f"{v} as {n}" for n, v in layer.items()))
    return df


def _sql(layers, columns: str, where: str = "true") -> str:
    made = layers(OTHER)
    return f"with {chain(OTHER, made)} select p_partkey, {columns} from l{len(made)} where {where}"


def pages(d: Dialect) -> list[dict[str, str]]:
    cells = {"title": pick(d, TITLES, 1), "cats": pick(d, CATEGORIES, 3), "box": "p_size % 3 = 0", "kind": "case p_size % 7 when 1 then 'person' when 2 then 'military unit' else '' end", "n_links": "p_size", "anchor": pick(d, TITLES, 2)}
    return [cells, {"t": "lower(title)"}, c.scores(d), {"page": c.page_type(d), "reasons": d.join(c.page_reasons(d)), "top": "greatest(list_score, battle_score, campaign_score, war_score, person_score, other_score, 1)"}]


@query(_sql(pages, "page, page like '%_article' as accepted, round(least(1::double, top / 6.0::double), 2) as confidence, reasons"))
def rule_page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six additive scores of a page, the first rule that holds over them, and how sure it is."""
    return built(spark, sf_dir, pages(SPARK)).selectExpr("p_partkey", "page", "page like '%_article' as accepted", "round(least(1D, top / 6D), 2) as confidence", "reasons")


def titles(d: Dialect) -> list[dict[str, str]]:
    error = pick(d, ["HTTP 429", "page is protected", "missingtitle", "timeout"], 1)
    return [*pages(d), {"meta_type": c.metadata_type(d), "battle": c.battle_type(d), "family": c.source_family(d), "list_like": c.is_list(d), "support": d.any("t", c.SUPPORT), "meta": d.like("title", "^(" + "|".join(c.META) + ")"), "asked": f"{d.any('t', c.CATEGORY_ASKED)} and not {d.any('t', c.CATEGORY_REFUSED)}", "link": c.link_score(d), "error": c.fetch_error(d, f"lower({error})")}]


@query(_sql(titles, "meta_type, battle, family, list_like, support, meta, asked, link, link >= 1 as candidate, error"))
def rule_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a title says: metadata class, battle type, source family, namespaces, candidate score; and classes of fetch errors."""
    return built(spark, sf_dir, titles(SPARK)).selectExpr("p_partkey", "meta_type", "battle", "family", "list_like", "support", "meta", "asked", "link", "link >= 1 as candidate", "error")


def origins(d: Dialect) -> list[dict[str, str]]:
    return [*titles(d), {"source": pick(d, ["roots", "lists", "categories"], 5)}]


@query(f"""with {chain(OTHER, origins(OTHER))}, o as (select title, max(link) as score, count(*) as n, string_agg(distinct source, ' | ' order by source) as sources, min(meta_type) as meta_type from l{len(origins(OTHER))} where link >= 1 group by 1)
  select title, score, n, sources, meta_type, meta_type like '%_article' as accepted, row_number() over (order by score desc, n desc, lower(title), title)::int as place from o""")
def graph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with all their origins merged, classified by metadata, in order of priority."""
    rows = built(spark, sf_dir, origins(SPARK)).filter("link >= 1")
    o = rows.groupBy("title").agg(F.max("link").alias("score"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("sources"), F.min("meta_type").alias("meta_type"))
    o = o.selectExpr("*", "meta_type like '%_article' as accepted")
    ranked = ordered_ranks(o, [], [F.desc("score"), F.desc("n"), F.lower("title").asc(), F.asc("title")], "place")
    return ranked.select("title", "score", "n", "sources", "meta_type", "accepted", "place")


def results(d: Dialect) -> list[dict[str, str]]:
    cells = {"result": pick(d, RESULT, 1), "stored": "case p_partkey % 5 when 0 then 'victory' when 1 then '' else 'unknown' end", "raw_a": pick(d, SIDES_A, 2), "raw_b": pick(d, SIDES_B, 3), "side": "case p_size % 5 when 0 then 'multiple_sides' when 1 then 'side_b' else 'side_a' end", "explicit": "case p_size % 9 when 0 then 'victory' when 1 then 'defeat' when 2 then 'draw' else '' end"}
    return [cells, {"fixed": c.repaired(d, "result")}, dict(zip(("kind", "source"), c.scoring_result(d, RESULTS), strict=True))]


def texts(d: Dialect) -> list[dict[str, str]]:
    return [*results(d), {"shown": c.clean_result(d), "said": c.conservative_outcome(d), "old": "case p_partkey % 3 when 0 then 'unknown' when 1 then 'victory' else 'stalemate' end"}, {"replaces": c.admissible("old", "said")}]


@query(_sql(texts, "fixed, kind, source, shown, said, old, replaces"))
def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result texts repaired, typed and cleaned; the conservative outcome on a text's face, and whether it may replace the stored one."""
    return built(spark, sf_dir, texts(SPARK)).select("p_partkey", "fixed", "kind", "source", "shown", "said", "old", "replaces")


def winners(d: Dialect) -> list[dict[str, str]]:
    side, method = c.winner(d)
    category, sure = c.outcome()
    return [
        *results(d), {f"ents_{s}": c.entities(d, f"raw_{s}") for s in "ab"} | {"r": d.words("fixed")}, {f"tok_{s}": c.tokens(d, f"ents_{s}") for s in "ab"},
        {"win_side": side, "win_method": method}, {"category": category, "sure": sure},
    ]


@query(_sql(winners, f"{OTHER.join('ents_a')} as entities_a, {OTHER.join('tok_a')} as tokens_a, {OTHER.join('tok_b')} as tokens_b, win_side as winner, win_method as method, category, sure as confidence"))
def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side a result names, by what, and the outcome of the commander's side: belligerents, their aliases, losers first, then coalitions."""
    return built(spark, sf_dir, winners(SPARK)).selectExpr("p_partkey", f"{SPARK.join('ents_a')} as entities_a", f"{SPARK.join('tok_a')} as tokens_a", f"{SPARK.join('tok_b')} as tokens_b", "win_side as winner", "win_method as method", "category", "sure as confidence")


def names(d: Dialect) -> list[dict[str, str]]:
    cells = {"raw": pick(d, NAMES, 1), "link": pick(d, LINKS, 1), "belligerent": "case when p_partkey % 2 = 0 then 'Roman Empire' else '' end", "cats": pick(d, NAME_CATEGORIES, 2), "page": "p_partkey % 20"}
    made = {"name": c.clean_name(d, "raw", "belligerent"), "title": c.clean_name(d, "link", "belligerent")}
    judged = {"blockers": c.name_blockers(d, "raw", "name", "(link <> '')"), "generic": c.is_generic(d, "name"), "class": c.page_class(d, "link", "cats"), "conflict": c.conflicts(d, "link", "belligerent"), "suspect": c.suspect_identity(d, "name"), "same": c.name_match(d, "name", "title")}
    return [cells, made, judged]


@query(_sql(names, f"name, {OTHER.join('blockers')} as blockers, generic, class, conflict, suspect, same"))
def rule_name_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cleaned, what speaks against each, the class of the linked page, and whether name and link agree."""
    return built(spark, sf_dir, names(SPARK)).selectExpr("p_partkey", "name", f"{SPARK.join('blockers')} as blockers", "generic", "class", "conflict", "suspect", "same")


def candidates(d: Dialect) -> list[dict[str, str]]:
    """Of a cell, the linked name counts if nothing speaks against it; else the name as it stands; else the cell is an issue."""
    display = f"case when {d.size(c.name_blockers(d, 'raw', 'name', 'true'))} = 0 and (length(name) - length(replace(name, ' ', '')) > length(title) - length(replace(title, ' ', '')) or length(name) > length(title) + 8) then name else title end"
    linked = d.concat("link_flags", d.set({"belligerent_link_not_person": "conflict", "linked_page_nonperson": "class = 'nonperson'"}))
    return [
        *names(d), {"chosen": display}, {"link_flags": c.name_blockers(d, "raw", "chosen", "true"), "text_flags": c.name_blockers(d, "raw", "name", "false")}, {"all_flags": d.unique(linked)},
        {"by_link": f"link <> '' and {d.size('all_flags')} = 0", "by_text": f"(link = '' or {d.size('all_flags')} > 0) and {d.size('text_flags')} = 0"},
        {"decision": "case when by_link or by_text then 'accepted' when raw <> '' then 'no_valid_commander_candidates' else 'empty' end", "method": "case when by_link then 'linked_article' when by_text then 'cleaned_segment_text' else '' end",
         "found": "case when by_link then chosen when by_text then name else '' end", "identity": "case when by_link and class = 'person' then 'high' when by_link or by_text then 'medium' else '' end"},
    ]


@query(_sql(candidates, f"decision, method, found, identity, case when link <> '' and not by_link then {OTHER.join('all_flags')} else '' end as link_rejected, case when not by_link and not by_text then {OTHER.join(OTHER.unique('text_flags'))} else '' end as text_rejected"))
def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commander candidates of a cell: accepted by link or text, or rejected with reasons."""
    return built(spark, sf_dir, candidates(SPARK)).selectExpr("p_partkey", "decision", "method", "found", "identity", f"case when link <> '' and not by_link then {SPARK.join('all_flags')} else '' end as link_rejected", f"case when not by_link and not by_text then {SPARK.join(SPARK.unique('text_flags'))} else '' end as text_rejected")


@query(f"""with {chain(OTHER, candidates(OTHER))}, a as (select p_partkey, raw, found as name, case when by_link then 'https://en.wikipedia.org/wiki/' || replace(link, ' ', '_') end as url from l{len(candidates(OTHER))} where decision = 'accepted'),
  k as (select lower(name) as low, max(url) as only from a where url is not null group by 1 having count(distinct url) = 1), r as (select a.*, coalesce(a.url, k.only) as resolved from a left join k on low = lower(name)),
  g as (select coalesce('url:' || lower(resolved), 'name:' || lower(name)) as key, * from r), n as (select key, name, row_number() over (partition by key order by count(*) desc, name) as rn from g group by 1, 2)
  select 'cmd_' || substr(sha1(g.key), 1, 12) as commander_id, max(n.name) as name_primary, string_agg(distinct raw, ' | ' order by raw) as variants, max(resolved) as page, count(*) as rows, case when max(resolved) is null then 'exact_cleaned_name' else 'linked_article' end as method, bool_or(url is null and resolved is not null) as promoted
  from g join n on n.key = g.key and n.rn = 1 group by g.key""")
def rule_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a commander: names with one known link take it, keys are links or else names, variants are united."""
    a = built(spark, sf_dir, candidates(SPARK)).selectExpr("p_partkey", "raw", "found as name", "case when by_link then concat('https://en.wikipedia.org/wiki/', replace(link, ' ', '_')) end as url", "decision")
    # Written once: a filter or a join key on these columns would repeat their whole chain of rules.
    a = shared_table(a, "accepted").filter("decision = 'accepted'").drop("decision")
    only = a.filter("url is not null").groupBy(F.lower("name").alias("low")).agg(F.max("url").alias("only"), F.min("url").alias("least")).filter("only = least").select("low", "only")
    r = a.join(only, F.lower("name") == F.col("low"), "left").withColumn("resolved", F.coalesce("url", "only"))
    g = r.withColumn("key", F.coalesce(F.concat(F.lit("url:"), F.lower("resolved")), F.concat(F.lit("name:"), F.lower("name"))))
    n = g.groupBy("key", "name").agg(F.count("*").alias("n")).groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name_primary"))
    m = g.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("raw")), " | ").alias("variants"), F.max("resolved").alias("page"), F.count("*").alias("rows"), F.max(F.col("url").isNull() & F.col("resolved").isNotNull()).alias("promoted"))
    return m.join(n, "key").select(F.concat(F.lit("cmd_"), F.substring(F.sha1("key"), 1, 12)).alias("commander_id"), "name_primary", "variants", "page", "rows", F.when(F.col("page").isNull(), "exact_cleaned_name").otherwise("linked_article").alias("method"), "promoted")


@query("""with b as (select o_orderkey as id, o_orderpriority as battle_name, year(o_orderdate) as year from orders where o_orderkey % 50 <> 0),
  r as (select l_orderkey as battle_id, l_linenumber::bigint as line, case when l_linenumber = 7 then 'side_x' else 'side_a' end as side, case when l_quantity < 3 then 'other' else o_orderpriority end as battle_name, year(o_orderdate) + (l_tax > 0.07)::int as year, case l_returnflag when 'A' then 'victory' when 'R' then 'defeat' else 'retreat' end as result from lineitem join orders on o_orderkey = l_orderkey),
  f as (select battle_id, line, case when b.id is null then ['missing_battle_reference'] when side not in ('side_a', 'side_b', 'side_c') then ['invalid_side'] else list_filter([case when r.battle_name <> b.battle_name then 'battle_name_mismatch' end, case when result not in ('victory', 'defeat', 'draw', 'stalemate', 'indecisive', 'disputed', 'unknown') then 'invalid_side_result' end, case when r.year <> b.year then 'year_mismatch' end], lambda x: x is not null) end as flags from r left join b on b.id = battle_id)
  select battle_id, line, array_to_string(flags, ' | ') as blockers, case when len(flags) = 0 then 'main' else 'quarantine' end as moved_to from f""")
def rule_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows held against the table they refer to: lost references end the check, disagreements are listed, blocked rows move to quarantine."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    b = o.filter("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("b_name"), F.col("y").alias("b_year"))
    side = F.when(F.col("l_linenumber") == 7, "side_x").otherwise("side_a")
    result = F.when(F.col("l_returnflag") == "A", "victory").when(F.col("l_returnflag") == "R", "defeat").otherwise("retreat")
    r = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("battle_id"), F.col("l_linenumber").cast("long").alias("line"), side.alias("side"), F.when(F.col("l_quantity") < 3, "other").otherwise(F.col("o_orderpriority")).alias("battle_name"), (F.col("y") + (F.col("l_tax") > 0.07).cast("int")).alias("year"), result.alias("result"))
    r = r.join(b, r.battle_id == b.id, "left")
    known = ["victory", "defeat", "draw", "stalemate", "indecisive", "disputed", "unknown"]
    more = F.filter(F.array(F.when(F.col("battle_name") != F.col("b_name"), "battle_name_mismatch"), F.when(~F.col("result").isin(known), "invalid_side_result"), F.when(F.col("year") != F.col("b_year"), "year_mismatch")), lambda x: x.isNotNull())
    flags = F.when(F.col("id").isNull(), F.array(F.lit("missing_battle_reference"))).when(~F.col("side").isin("side_a", "side_b", "side_c"), F.array(F.lit("invalid_side"))).otherwise(more)
    return r.select("battle_id", "line", F.array_join(flags, " | ").alias("blockers"), F.when(F.size(flags) == 0, "main").otherwise("quarantine").alias("moved_to"))


def rebuilt(d: Dialect) -> list[dict[str, str]]:
    """Two versions of a page's row, judged alike; the first without blockers is valid."""
    cells = {"title": pick(d, TITLES, 1), "cats": pick(d, CATEGORIES, 3), "date_raw": pick(d, DATES, 2), "raw_a": pick(d, SIDES_A, 2), "raw_b": pick(d, SIDES_B, 3), "cell": "case when p_size % 2 = 0 then 'X' else '' end", "place": "case when p_size % 3 = 0 then 'Y' else '' end", "war": "case when p_size % 4 = 0 then 'Z' else '' end"}
    out = [cells, {"t": "lower(title)", "page": f"case when {d.any('lower(title)', ['general', 'category', 'list of'])} then 'biography_page' else 'battle_article' end", "year": f"cast(nullif({d.extract('date_raw', '([0-9]{3,4})')}, '') as int)"}]
    for v, result, box in (("one", pick(d, RESULT, 1), "p_size % 5 = 0"), ("two", pick(d, RESULT, 2), "p_size % 2 = 0")):
        out += [{f"result_{v}": result, f"box_{v}": box}, {f"kind_{v}": f"case when p_partkey % 6 = 0 then 'victory' else {c.result_type(d, f'result_{v}', RESULTS)} end"}]
        found = c.row_blockers(d, RESULTS)
        for name in ("result", "box", "kind"):
            found = _own(found, name, v)
        out += [{f"flags_{v}": found}]
    return out


def _own(text: str, name: str, v: str) -> str:
    import re

    return re.sub(rf"(?<![\w'_]){name}(?![\w'_])", f"{name}_{v}", text)


def _decision(d: Dialect) -> dict[str, str]:
    best = f"case when {d.size('flags_two')} < {d.size('flags_one')} then flags_two else flags_one end"
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    generic = d.filter(best, "x", f"x in ({listed(c.GENERIC)})")
    decision = f"case when {d.size('flags_one')} = 0 or {d.size('flags_two')} = 0 then 'valid' when page = 'biography_page' then 'remove_false_positive' when {d.size(generic)} > 0 and ({d.size(generic)} = {d.size(best)} or {d.exists(best, 'x', f'x in ({listed(c.STRONG)})')}) then 'remove_false_positive' else 'quarantine' end"
    mode = f"case when {d.size('flags_one')} = 0 then 'wikitext' when {d.size('flags_two')} = 0 then 'full_parse' when page = 'biography_page' then 'none' when {d.size('flags_two')} < {d.size('flags_one')} then 'full_parse' else 'wikitext' end"
    return {"decision": decision, "mode": mode, "best_flags": d.join(best)}


@query(f"with {chain(OTHER, [*rebuilt(OTHER), _decision(OTHER)])} select p_partkey, decision, mode, case when decision = 'valid' then '' when mode = 'none' then 'biography_page' else best_flags end as reasons from l{len(rebuilt(OTHER)) + 1}")
def rule_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision over two versions of a row: valid, removed or quarantined, with the reasons of the better version."""
    return built(spark, sf_dir, [*rebuilt(SPARK), _decision(SPARK)]).selectExpr("p_partkey", "decision", "mode", "case when decision = 'valid' then '' when mode = 'none' then 'biography_page' else best_flags end as reasons")


def audited(d: Dialect) -> list[dict[str, str]]:
    """Stored values that disagree here and there with what the row's texts say."""
    numbers = d.fn("transform(regexp_extract_all(strength, r'[0-9][0-9,]*', 0), x -> cast(replace(x, ',', '') as bigint))", "list_transform(regexp_extract_all(strength, '[0-9][0-9,]*'), lambda x: replace(x, ',', '')::bigint)")
    cells = {"title": pick(d, TITLES, 1), "date_raw": pick(d, DATES, 2), "strength": pick(d, STRENGTHS, 3), "result": pick(d, RESULT, 1), "box": "p_size % 3 = 0"}
    derived = {"year": f"cast(nullif({d.extract('date_raw', '([0-9]{3,4})')}, '') as int)", "kind": c.result_type(d, "result", RESULTS), "nums": numbers, "name": d.sub("title", r"\s*\([^)]*\)$")}
    off = lambda v, n: f"case when p_partkey % {n} = 0 then {v} else"
    stored = {
        "s_year": f"{off('year + 1', 5)} year end", "s_century": f"{off('99', 7)} cast(floor((year - 1) / {d.fn('100', '100.0')}) + 1 as int) end", "s_kind": f"{off(repr('rout'), 11)} {off(repr('draw'), 6)} kind end end", "s_lo": f"{off('0', 8)} {d.least('nums')} end",
        "s_hi": f"{off('0', 9)} {d.fn('array_max', 'list_max')}(nums) end", "s_name": f"{off('title', 4)} name end", "lat": "p_size * 2.5", "lon": "p_size * 4.5", "s_page": f"{off(repr('page'), 13)} 'battle_article' end", "s_url": f"{off(repr('other'), 10)} replace(title, ' ', '_') end",
    }
    diff = lambda a, b: f"{a} is distinct from {b}"
    kinds = ", ".join(f"'{k}'" for k, _ in RESULTS) + ", 'unknown'"
    flags = d.set({
        "source_url_title_mismatch": "s_url <> replace(title, ' ', '_')", "battle_name_normalization_mismatch": "s_name <> name", "invalid_page_type": "s_page not in ('battle_article', 'campaign_article', 'operation_article', 'war_conflict_article')", "invalid_result_type": f"s_kind not in ({kinds})", "result_type_mismatch": diff("s_kind", "kind"),
        "date_field_mismatch:year": diff("s_year", "year"), "date_field_mismatch:century": diff("s_century", f"cast(floor((year - 1) / {d.fn('100', '100.0')}) + 1 as int)"), "numeric_range_mismatch:min": diff("s_lo", d.least("nums")), "numeric_range_mismatch:max": diff("s_hi", d.fn("array_max(nums)", "list_max(nums)")),
        "latitude_out_of_range": "lat not between -90 and 90", "longitude_out_of_range": "lon not between -180 and 180", "weak_row_no_infobox_no_result": "not box and result = ''", "likely_false_positive_generic_topic": "lower(title) in ('air assault', 'airborne warfare')",
    })
    return [cells, derived, stored, {"flags": flags}]


@query(_sql(audited, f"{OTHER.size('flags')}::int as n, {OTHER.join('flags')} as issues"))
def rule_row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fields held against what their own texts say, a list of issues a row."""
    return built(spark, sf_dir, audited(SPARK)).selectExpr("p_partkey", f"{SPARK.size('flags')} as n", f"{SPARK.join('flags')} as issues")


# --- overrides and reviews ---------------------------------------------------------------------------


@query(f"""with {FACT}, w as (select commander_id, min(page_id) as page_id from fact group by 1 having count(*) > 0), o as (select commander_id, page_id, 'defeat' as new_outcome from w where commander_id % 4 = 0)
  select f.commander_id, f.page_id, f.outcome as old_outcome, new_outcome, (f.outcome <> new_outcome and (f.outcome = 'unknown' or f.outcome = 'victory')) as applies from fact f join o using (commander_id, page_id)""")
def verify_exact_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated outcomes by commander and page: each must meet exactly one row, or the query fails."""
    e = engagements(spark, sf_dir)
    o = e.filter("commander_id % 4 = 0").groupBy("commander_id").agg(F.min("page_id").alias("page_id")).withColumn("new_outcome", F.lit("defeat"))
    return exact_overrides(e, o)


def exact_overrides(e: DataFrame, o: DataFrame) -> DataFrame:
    """Overrides (commander_id, page_id, new_outcome) with what they replace; one that does not meet exactly one row raises an error."""
    met = o.join(e.select("commander_id", "page_id", "outcome"), ["commander_id", "page_id"], "left").groupBy("commander_id", "page_id", "new_outcome").agg(F.count("outcome").alias("n"), F.first("outcome").alias("old_outcome"))
    sure = F.coalesce(F.assert_true(F.col("n") == 1, F.concat(F.lit("override without exactly one row: "), F.col("commander_id").cast("string"))).cast("string"), F.col("old_outcome"))
    old, new = F.col("old_outcome"), F.col("new_outcome")
    return met.select("commander_id", "page_id", sure.alias("old_outcome"), "new_outcome", ((old != new) & old.isin("unknown", "victory")).alias("applies"))


_STATUS = "case when n_lines > 2 then 'quarantined' when page_type = 'war_conflict_article' and n_lines > 1 then 'structurally_suspect' when page_type <> 'battle_article' then 'verified_broad' else 'verified_core' end"


@query(f"""with {FACT}, s as (select *, {_STATUS} as status from fact), m as (select commander_id, status, row_number() over (partition by commander_id order by count(*) desc, status) as rn from s group by 1, 2),
  k as (select commander_id, count(*) as total, count_if(status = 'structurally_suspect') as suspect, count_if(status = 'verified_broad') as broad, count_if(status = 'verified_core') as core, count_if(n_lines > 1 and outcome <> 'unknown') as changed, count_if(outcome = 'unknown' and strict) as open,
    'B=' || count_if(strict and page_type = 'battle_article') || '; O=' || count_if(strict and page_type = 'operation_article') || '; C=' || count_if(strict and page_type = 'campaign_article') || '; W=' || count_if(strict and page_type = 'war_conflict_article') as mix,
    'V=' || count_if(strict and outcome = 'victory') || '; D=' || count_if(strict and outcome in ('defeat', 'major_defeat')) || '; U=' || count_if(strict and outcome = 'unknown') as profile from fact join s using (commander_id, page_id) group by 1)
  select k.commander_id, case when changed > 0 and open > 0 then 'corrected_but_partially_unresolved' when changed > 0 then 'corrected' when open > 0 then 'unresolved_after_review' else 'confirmed_no_change' end as review,
    case when status = 'structurally_suspect' and (suspect >= 3 or suspect / total::double >= 0.4) then 'high_priority_manual_concern' when core = 0 and total >= 2 then 'high_priority_manual_concern' when suspect >= 1 or broad >= 3 or broad / total::double >= 0.5 then 'materially_inflated' when broad >= 1 then 'mildly_inflated' else 'structurally_clean' end as structure,
    mix, profile from k join m on m.commander_id = k.commander_id and rn = 1""".replace("from fact join s using (commander_id, page_id) group by 1)", "from s group by 1)"))
def rule_review_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review and structure classes of each commander, with the mixes of strict rows as text."""
    s = engagements(spark, sf_dir).withColumn("status", F.expr(_STATUS))
    n = lambda cond: F.count_if(F.expr(cond))
    statuses = ["quarantined", "structurally_suspect", "verified_broad", "verified_core"]
    kinds = {"B": "battle_article", "O": "operation_article", "C": "campaign_article", "W": "war_conflict_article"}
    outcomes = {"V": "outcome = 'victory'", "D": "outcome in ('defeat', 'major_defeat')", "U": "outcome = 'unknown'"}
    text = lambda items: F.concat_ws("; ", *(F.concat(F.lit(f"{k}="), n(f"strict and {v}").cast("string")) for k, v in items.items()))
    top = F.array_min(F.array(*(F.struct((-n(f"status = '{x}'")).alias("n"), F.lit(x).alias("s")) for x in statuses)))["s"]
    k = s.groupBy("commander_id").agg(F.count("*").alias("total"), n("status = 'structurally_suspect'").alias("suspect"), n("status = 'verified_broad'").alias("broad"), n("status = 'verified_core'").alias("core"), n("n_lines > 1 and outcome <> 'unknown'").alias("changed"), n("outcome = 'unknown' and strict").alias("open"), top.alias("status"), text({k: f"page_type = '{v}'" for k, v in kinds.items()}).alias("mix"), text(outcomes).alias("profile"))
    review = F.expr("case when changed > 0 and open > 0 then 'corrected_but_partially_unresolved' when changed > 0 then 'corrected' when open > 0 then 'unresolved_after_review' else 'confirmed_no_change' end")
    structure = F.expr("case when status = 'structurally_suspect' and (suspect >= 3 or suspect / total >= 0.4) then 'high_priority_manual_concern' when core = 0 and total >= 2 then 'high_priority_manual_concern' when suspect >= 1 or broad >= 3 or broad / total >= 0.5 then 'materially_inflated' when broad >= 1 then 'mildly_inflated' else 'structurally_clean' end")
    return k.select("commander_id", review.alias("review"), structure.alias("structure"), "mix", "profile")


# --- evidence, identities, kinds of overrides --------------------------------------------------------


def evidence(d: Dialect) -> list[dict[str, str]]:
    """Four sources of a page's row, each with its own cells, blockers and score."""
    cells = {"title": pick(d, TITLES, 1), "cats": pick(d, CATEGORIES, 3), "raw_a": pick(d, SIDES_A, 2), "raw_b": pick(d, SIDES_B, 3), "cell": "case when p_size % 2 = 0 then 'X' else '' end", "place": "case when p_size % 3 = 0 then 'Y' else '' end", "war": "case when p_size % 4 = 0 then 'Z' else '' end", "side": "case when p_size % 2 = 0 then 'side_a' else 'side_b' end", "sources": d.list("0", "1", "2", "3")}
    return [cells, {"t": "lower(title)", "source": d.fn("explode(sources)", "unnest(sources)")}, {"n": "p_partkey + source * 3"}, {"page": "'battle_article'", "date_raw": pick(d, DATES, 2).replace("p_partkey", "n"), "result": pick(d, RESULT, 1).replace("p_partkey", "n"), "box": "n % 3 = 0"},
            {"year": f"cast(nullif({d.extract('date_raw', '([0-9]{3,4})')}, '') as int)", "kind": c.result_type(d, "result", RESULTS)}, {"flags": c.row_blockers(d, RESULTS), "score": c.evidence_score(), "own": c.side_result(d)}, {"blockers": d.size("flags"), "strong": d.exists("flags", "x", f"x in ({', '.join(repr(s) for s in c.STRONG)})")}]


@query(f"""with {chain(OTHER, evidence(OTHER))}, r as (select *, row_number() over (partition by p_partkey order by case when blockers = 0 then 0 else 1 end, case when blockers = 0 then source else blockers end, -score, source) as rn, bool_or(strong) over (partition by p_partkey) as any_strong from l7)
  select p_partkey, source, blockers::int as blockers, score::int as score, own, case when blockers = 0 then 'restored' when any_strong then 'removed' else 'quarantine' end as decision from r where rn = 1""")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of four sources of a row: without blockers by priority and evidence, else with the fewest; and its side's result."""
    rows = built(spark, sf_dir, evidence(SPARK)).select("p_partkey", "source", "blockers", "score", "own", "strong")
    b = F.col("blockers")
    key = F.struct((b > 0).alias("a"), F.when(b == 0, F.col("source")).otherwise(b).alias("b"), (-F.col("score")).alias("c"), F.col("source").alias("d"))
    best = rows.groupBy("p_partkey").agg(F.min_by(F.struct("source", "blockers", "score", "own"), key).alias("x"), F.max("strong").alias("any_strong"))
    decision = F.when(F.col("x.blockers") == 0, "restored").when(F.col("any_strong"), "removed").otherwise("quarantine")
    return best.select("p_partkey", "x.source", "x.blockers", "x.score", "x.own", decision.alias("decision"))


def identities(d: Dialect) -> list[dict[str, str]]:
    cells = {"raw": pick(d, NAMES, 1), "link": f"case when p_size % 3 = 0 then '' else {pick(d, [*LINKS, 'Ministry of War', 'Newsweek'], 1)} end", "title": pick(d, [*TITLES, "Hannibal at the gates", "John Smith and the sea"], 2)}
    return [cells, {"name": c.clean_name(d, "raw", "''")}, {"low": "lower(name)", "url": "case when link <> '' then concat('https://en.wikipedia.org/wiki/', replace(link, ' ', '_')) end", "no_person": c.non_person_link(d, "name", "link"), "named": c.mentions(d, "title", "name")}]


@query(f"""with {chain(OTHER, identities(OTHER))}, r as (select * from l3 where name <> '' or link <> ''), m as (select distinct low from r where url is null and low <> '' and p_partkey % 4 <> 1), u as (select distinct url from r where p_partkey % 5 <> 2 and url is not null),
  k as (select r.*, case when u.url is not null then 'linked_wikipedia_url' when m.low is not null then 'normalized_raw_name' else 'synthetic_fallback' end as source, coalesce('url:' || r.url, 'name:' || r.low) as key from r left join u on u.url = r.url left join m on m.low = r.low),
  n as (select key, name, row_number() over (partition by key order by count(*) desc, name) as rn from k where name <> '' group by 1, 2)
  select 'acmd_' || substr(sha1(k.key), 1, 12) as id, count(*) as rows, max(n.name) as name, max(url) as url, string_agg(distinct source, ' | ' order by source) as sources, bool_or(no_person) as no_person, bool_or(named) as named, case when max(url) is not null and not bool_or(no_person) then 'high' when max(url) is not null then 'medium' when bool_or(source = 'synthetic_fallback') then 'low' else 'medium' end as reliability
  from k left join n on n.key = k.key and n.rn = 1 group by k.key""")
def rule_identity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities by known link, else by known name, else made up; the bridge's commonest name, link and reliability."""
    r = built(spark, sf_dir, identities(SPARK)).select("p_partkey", "name", "low", "link", "url", "no_person", "named")
    r = shared_table(r, "identities").filter("name <> '' or link <> ''").drop("link")
    m = r.filter("url is null and low <> '' and p_partkey % 4 <> 1").select("low").distinct().withColumn("by_name", F.lit(True))
    u = r.filter("url is not null and p_partkey % 5 <> 2").select("url").distinct().withColumn("by_url", F.lit(True))
    k = r.join(u, "url", "left").join(m, "low", "left")
    k = k.withColumns({"source": F.when(F.col("by_url"), "linked_wikipedia_url").when(F.col("by_name"), "normalized_raw_name").otherwise("synthetic_fallback"), "key": F.coalesce(F.concat(F.lit("url:"), "url"), F.concat(F.lit("name:"), "low"))})
    n = k.filter("name <> ''").groupBy("key", "name").agg(F.count("*").alias("n")).groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"))
    g = k.groupBy("key").agg(F.count("*").alias("rows"), F.max("url").alias("url"), F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("sources"), F.max("no_person").alias("no_person"), F.max("named").alias("named"), F.max(F.col("source") == "synthetic_fallback").alias("made"))
    linked = F.col("url").isNotNull()
    reliability = F.when(linked & ~F.col("no_person"), "high").when(linked, "medium").when(F.col("made"), "low").otherwise("medium")
    return g.join(n, "key", "left").select(F.concat(F.lit("acmd_"), F.substring(F.sha1("key"), 1, 12)).alias("id"), "rows", "name", "url", "sources", "no_person", "named", reliability.alias("reliability"))


@query(f"""with {FACT}, b as (select page_id, case when page_id % 5 = 0 then 'campaign_article' else ' ' end as o_type, case when page_id % 7 = 0 then '1800' end as o_year from (select distinct page_id from fact where page_id % 5 = 0 or page_id % 7 = 0)), k as (select distinct commander_id, case when commander_id % 3 = 0 then 'side_b' else '' end as o_side from fact where commander_id % 2 = 0),
  o as (select commander_id, page_id, case when page_id % 11 = 0 then 'draw' else '' end as o_outcome from fact where (commander_id + page_id) % 9 = 0)
  select commander_id, page_id, coalesce(nullif(trim(o_type), ''), page_type) as page_type, coalesce(try_cast(nullif(trim(o_year), '') as int), year) as year, coalesce(nullif(trim(o_side), ''), side) as side, coalesce(nullif(trim(o_outcome), ''), outcome) as outcome, (b.page_id is not null)::int + (k.commander_id is not null)::int + (o.page_id is not null)::int as overrides
  from fact left join b using (page_id) left join k using (commander_id) left join o using (commander_id, page_id)""")
def verify_override_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of pages, of commanders and of single outcomes, each by its key; what they leave blank stays as it was."""
    f = engagements(spark, sf_dir)
    p, w = F.col("page_id"), F.col("commander_id")
    b = f.filter("page_id % 5 = 0 or page_id % 7 = 0").select("page_id").distinct().select("page_id", F.when(p % 5 == 0, "campaign_article").otherwise(" ").alias("o_type"), F.when(p % 7 == 0, "1800").alias("o_year"), F.lit(1).alias("b"))
    k = f.filter("commander_id % 2 = 0").select("commander_id").distinct().select("commander_id", F.when(w % 3 == 0, "side_b").otherwise("").alias("o_side"), F.lit(1).alias("k"))
    o = f.filter("(commander_id + page_id) % 9 = 0").select("commander_id", "page_id", F.when(p % 11 == 0, "draw").otherwise("").alias("o_outcome"), F.lit(1).alias("o"))
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    r = f.join(b, "page_id", "left").join(k, "commander_id", "left").join(o, ["commander_id", "page_id"], "left")
    n = sum((F.coalesce(c, F.lit(0)) for c in ("b", "k", "o")), F.lit(0))
    return r.select("commander_id", "page_id", F.coalesce(said("o_type"), "page_type").alias("page_type"), F.coalesce(said("o_year").try_cast("int"), "year").alias("year"), F.coalesce(said("o_side"), "side").alias("side"), F.coalesce(said("o_outcome"), "outcome").alias("outcome"), n.alias("overrides"))
