"""Queries of the text, date and rule functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import dates, text
from lodestar.functions.curation import RESULT_WORDS
from lodestar.operators.relational import join_flags, spread
from lodestar.plans.binding import table
from lodestar.plans.registry import query

#: Free-text cells made from the part table, the same in both languages.
_RESULT = ["Decisive Roman victory", "victory of the north", "Pyrrhic victory", "The army was defeated", "Indecisive", "draw", "Tactical allied victory", "disputed claims", "see text", "stalemate on both sides"]
_DATE = ["12 March 480 BC", "AD 43", "1415-10-25", "June 18, 1815 to July 3, 1815", "5/7/1943", "about 1066", "unknown", ""]
MESSY_SQL = f"""messy as (select p_partkey, p_size, ({_RESULT!r})[1 + p_partkey % 10] as result, ({_DATE!r})[1 + p_partkey % 8] as date_raw, 'General  ' || p_name || ' [' || p_size || '] (' || p_brand || ')' as name,
  'Battle of ' || p_type || case when p_partkey % 3 = 0 then ' (' || (900 + p_size * 20) || ')' else '' end as title, p_name || '; ' || upper(p_name) || ' and ' || p_brand || ' / ' || p_type as cell,
  case when p_partkey % 4 = 0 then 'about ' || p_size || ',000 men' when p_partkey % 4 = 1 then p_size || '–' || (p_size + 25) || ' ships' when p_partkey % 4 = 2 then 'many' else '1, 22 and 333' end as strength from part)"""


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda xs, n: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.lit(1) + F.pmod(key, F.lit(n))).cast("int"))
    s = size.cast("string")
    return p.select(
        "p_partkey", "p_size", pick(_RESULT, 10).alias("result"), pick(_DATE, 8).alias("date_raw"),
        F.concat(F.lit("General  "), "p_name", F.lit(" ["), s, F.lit("] ("), "p_brand", F.lit(")")).alias("name"),
        F.concat(F.lit("Battle of "), "p_type", F.when(key % 3 == 0, F.concat(F.lit(" ("), (900 + size * 20).cast("string"), F.lit(")"))).otherwise("")).alias("title"),
        F.concat("p_name", F.lit("; "), F.upper("p_name"), F.lit(" and "), "p_brand", F.lit(" / "), "p_type").alias("cell"),
        F.when(key % 4 == 0, F.concat(F.lit("about "), s, F.lit(",000 men"))).when(key % 4 == 1, F.concat(s, F.lit("–"), (size + 25).cast("string"), F.lit(" ships"))).when(key % 4 == 2, "many").otherwise("1, 22 and 333").alias("strength"),
    )


@query(f"""with {MESSY_SQL} select p_partkey, trim(regexp_replace(regexp_replace(name, '\\[[^\\]]*\\]', '', 'g'), '\\s+', ' ', 'g')) as spaced, regexp_replace(regexp_replace(lower(trim(title)), '[^\\w\\s-]', '', 'g'), '[\\s-]+', '_', 'g') as slug,
  trim(regexp_replace(regexp_replace(regexp_replace(name, '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '^(General)\\s+', ''), '\\s+', ' ', 'g')) as person, 'acmd_' || substr(sha1(title), 1, 12) as id from messy""")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space, slugs, person names and hashed ids."""
    m = messy(spark, sf_dir)
    return m.select("p_partkey", text.clean_space(F.col("name")).alias("spaced"), text.slug(F.col("title")).alias("slug"), text.person_name(F.col("name")).alias("person"), text.short_id(F.col("title"), "acmd_").alias("id"))


@query(f"""with {MESSY_SQL}, t as (select p_partkey, case {" ".join(f"when regexp_matches(result, '{p}') then '{n}'" for n, p in text.RESULTS)} else 'unknown' end as kind from messy)
  select p_partkey, kind, case when kind like '%victory' then 'Victory' when kind = 'defeat' then 'Defeat' when kind = 'unknown' then 'Unknown' else upper(kind[1]) || kind[2:] end as label from t""")
def text_result_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result type by ordered patterns, and its label."""
    m = messy(spark, sf_dir).select("p_partkey", text.result_type(F.col("result")).alias("kind"))
    return m.select("p_partkey", "kind", text.result_label(F.col("kind")).alias("label"))


@query(f"""with {MESSY_SQL}, n as (select p_partkey, list_transform(regexp_extract_all(strength, '\\b\\d[\\d,]*\\b'), lambda x: replace(x, ',', '')::bigint) as f from messy)
  select p_partkey, list_min(f) as lo, list_max(f) as hi, case when len(f) >= 2 then round_even((list_min(f) + list_max(f)) / 2, 0)::bigint else list_min(f) end as mid, case len(f) when 0 then 0::double when 1 then 0.8::double when 2 then 0.8::double else 0.55::double end as confidence from n""")
def text_number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest, largest and middle number of a strength text."""
    r = text.number_range(F.col("strength"))
    return messy(spark, sf_dir).select("p_partkey", r.alias("r")).select("p_partkey", "r.*")


@query(f"""with {MESSY_SQL}, s as (select p_partkey, list_filter(list_transform(regexp_split_to_array(cell, '[•;]| / | and '), lambda x: trim(x)), lambda x: x <> '') as f from messy)
  select p_partkey, array_to_string(list_filter(f, lambda x, i: not list_contains(list_transform(f[1:i - 1], lambda y: lower(y)), lower(x))), ' | ') as names from s""")
def text_split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells cut into names, distinct in order."""
    return messy(spark, sf_dir).select("p_partkey", F.array_join(text.split_names(F.col("cell")), " | ").alias("names"))


@query(f"""with {MESSY_SQL}, h as (select *, nullif(regexp_extract(title, '\\((\\d{{3,4}})\\)', 1), '')::int as hint, nullif(regexp_extract(date_raw, '(?i)\\b(\\d{{1,4}})\\s*(BC|BCE)\\b', 1), '')::int as bc,
  coalesce(nullif(regexp_extract(date_raw, '(?i)\\b(AD|CE)\\s*(\\d{{1,4}})\\b', 2), ''), nullif(regexp_extract(date_raw, '(?i)\\b(\\d{{1,4}})\\s*(AD|CE)\\b', 1), ''))::int as ad, case when p_partkey % 5 = 0 then 1500 + p_size when p_partkey % 5 = 1 then 99999 end as parsed,
  list_filter(list_transform(regexp_extract_all(date_raw, '\\b\\d{{1,4}}\\b'), lambda x: x::int), lambda y: y between 1 and 2027) as likely from messy),
  g as (select *, list_filter(likely, lambda y: abs(y - hint) <= 5) as close from h),
  k as (select *, case when bc is not null or ad is not null then 'high' when hint is not null and parsed is not null and abs(parsed - hint) >= 50 then 'title_year_override' when parsed between -5000 and 2027 then 'medium' when hint is not null and len(close) > 0 then 'low'
    when hint is not null and len(likely) > 0 and len(list_filter(likely, lambda y: abs(y - hint) < 50)) = 0 then 'title_far' when len(likely) > 0 then 'low_last' when hint is not null then 'title_year_fallback' else 'none' end as way from g)
  select p_partkey, case when bc is not null then -bc when ad is not null then ad when way in ('title_year_override', 'title_far', 'title_year_fallback') then hint when way = 'medium' then parsed when way = 'low' then close[-1] when way = 'low_last' then likely[-1] end::int as year,
  case way when 'title_far' then 'title_year_override' when 'low_last' then 'low' when 'none' then 'low' else way end as confidence from k""")
def text_analytic_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year ladder, with how sure each step is."""
    key = F.col("p_partkey")
    parsed = F.when(key % 5 == 0, 1500 + F.col("p_size")).when(key % 5 == 1, 99999)
    y = dates.analytic_year(F.col("title"), F.col("date_raw"), parsed)
    return messy(spark, sf_dir).select("p_partkey", y.alias("y")).select("p_partkey", "y.*")


_FORMS = [("\\d{4}-\\d{2}-\\d{2}", "%Y-%m-%d"), ("\\d{1,2} [A-Z][a-z]+ \\d{4}", "%d %B %Y"), ("[A-Z][a-z]+ \\d{1,2}, \\d{4}", "%B %d, %Y"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "%m/%d/%Y")]


def _date_sql(c: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime(nullif(regexp_extract({c}, '({p})', 1), ''), '{f}')" for p, f in _FORMS) + ")::date"


@query(f"""with {MESSY_SQL}, d as (select p_partkey, date_raw, nullif(regexp_extract(date_raw, '\\b(\\d{{3,4}})\\b', 1), '')::int as year, regexp_split_to_array(date_raw, ' to | – ') as parts from messy), e as (select *, {_date_sql("parts[1]")} as start, case when len(parts) > 1 then {_date_sql("parts[-1]")} end as "end" from d)
  select p_partkey, year, (floor((year - 1) / 100.0) + 1)::int as century, start, "end", 0.25::double + 0.25::double * ((year is not null)::int + (start is not null)::int + ("end" is not null)::int) as confidence,
    case when trim(date_raw) = '' then 'missing_date' else array_to_string(list_filter([case when contains(lower(date_raw), 'unknown') or contains(lower(date_raw), 'tbd') then 'suspicious_date_text' end, case when year is null then 'unparsed_year' when year not between 1 and 2100 then 'year_out_of_range' end, case when start > "end" then 'start_after_end' end], lambda x: x is not null), ' | ') end as reasons from e""")
def text_date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end, year and century of a date text, and what is wrong with it."""
    return messy(spark, sf_dir).select("p_partkey", dates.date_range(F.col("date_raw")).alias("r"), F.array_join(dates.date_reasons(F.col("date_raw")), " | ").alias("reasons")).select("p_partkey", "r.*", "reasons")


@query("""with e as (select event_id, json_extract_string(props, '$.k')::bigint as k, 'B=' || (event_id % 7) || '; O=' || (event_id % 3) || '; C=' || (event_id % 5) as summary from events)
  select event_id, k, regexp_extract(summary, 'B=(\\d+)', 1)::int as b, regexp_extract(summary, 'O=(\\d+)', 1)::int as o, contains('a | b | ' || summary, 'b') as flagged, printf('%+d', (event_id % 7 - event_id % 3)::int) as delta from e""")
def text_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON fields, k=v summaries, flag membership and signed deltas."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    s = F.concat(F.lit("B="), (i % 7).cast("string"), F.lit("; O="), (i % 3).cast("string"), F.lit("; C="), (i % 5).cast("string"))
    kv = text.key_values(s)
    flags = F.split(F.concat(F.lit("a | b | "), s), r" \| ")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), kv["B"].cast("int").alias("b"), kv["O"].cast("int").alias("o"), F.array_contains(flags, "b").alias("flagged"), F.format_string("%+d", (i % 7 - i % 3).cast("int")).alias("delta"))


@query("""with r as (select l_orderkey, l_linenumber, list_filter([case when l_quantity < 3 then 'insufficient_source_evidence' end, case when l_discount > 0.08 then 'unsupported_result_text' end, case when l_tax > 0.07 then 'disallowed_page_type' end, case when l_quantity < 3 and l_discount > 0.05 then 'no_infobox_and_no_result' end], lambda x: x is not null) as b from lineitem)
  select l_orderkey, l_linenumber::bigint as line, len(b)::int as blockers, array_to_string(list_sort(b), ' | ') as reasons, case when len(b) = 0 then 'valid' when list_contains(b, 'disallowed_page_type') then 'removed' else 'quarantine' end as decision from r""")
def rule_row_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against a row as a list, and the decision that follows."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    flags = [F.when(q < 3, "insufficient_source_evidence"), F.when(d > 0.08, "unsupported_result_text"), F.when(t > 0.07, "disallowed_page_type"), F.when((q < 3) & (d > 0.05), "no_infobox_and_no_result")]
    b = F.filter(F.array(*flags), lambda x: x.isNotNull())
    decision = F.when(F.size(b) == 0, "valid").when(F.array_contains(b, "disallowed_page_type"), "removed").otherwise("quarantine")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.size(b).alias("blockers"), join_flags(*flags).alias("reasons"), decision.alias("decision"))


@query("""with r as (select s_suppkey, s_name, case when s_acctbal > 0 then 'https://en.wikipedia.org/wiki/' || s_suppkey end as url, s_nationkey from supplier),
  k as (select *, coalesce(url, 'name:' || lower(s_name)) as key from r), b as (select key, count(*) as n, min(s_suppkey) as first_id, max(url) as url from k group by 1)
  select 'acmd_' || substr(sha1(key), 1, 12) as id, n, first_id, case when url is not null then 'high' else 'low' end as reliability, url is not null as linked from b""")
def rule_identity_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities by link, else by name; one bridge row an identity."""
    s = table(spark, sf_dir, "supplier")
    url = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.col("s_suppkey").cast("string")))
    k = s.select("s_suppkey", url.alias("url"), F.coalesce(url, F.concat(F.lit("name:"), F.lower("s_name"))).alias("key"))
    b = k.groupBy("key").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first_id"), F.max("url").alias("url"))
    return b.select(text.short_id(F.col("key"), "acmd_").alias("id"), "n", "first_id", F.when(F.col("url").isNotNull(), "high").otherwise("low").alias("reliability"), F.col("url").isNotNull().alias("linked"))


_KEPT = "url_encode(replace(title, ' ', '_'))"
for _mark, _code in (("(", "28"), (")", "29"), (",", "2C"), (":", "3A"), ("!", "21"), ("*", "2A")):
    _KEPT = f"replace({_KEPT}, '%{_code}', '{_mark}')"


@query(f"""with {MESSY_SQL}, t as (select p_partkey, trim(regexp_replace(replace(title || ' – é+?', '–', '-'), '\\s+', ' ', 'g')) as title from messy) select p_partkey, title, 'https://en.wikipedia.org/wiki/' || {_KEPT} as url, title as back, true as same from t""")
def text_url_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles folded, turned into page links and back."""
    t = messy(spark, sf_dir).select("p_partkey", text.fold_title(F.concat("title", F.lit(" – é+?"))).alias("title"))
    u = t.withColumn("url", text.title_link(F.col("title")))
    return u.withColumn("back", text.link_title(F.col("url"))).withColumn("same", F.col("back") == F.col("title"))


_BOX_SQL = "select p_partkey, p_brand || ' victory' as result, p_name || ' | ' || p_brand as names, p_type as side_a, p_brand || ' league' as side_b, 2::int as links, 'Page of ' || p_name || '.' as lead from part"


@query(_BOX_SQL)
def text_wikitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infoboxes written in wiki text, with nested templates, links, comments and references, taken apart again."""
    p = table(spark, sf_dir, "part")
    lit = F.lit
    source = F.concat(
        lit("<!-- {{Infobox no}} -->{{short|x}}\n{{Infobox military conflict\n|conflict=Battle\n|result='''"), F.col("p_brand"), lit("''' {{small|victory}}<ref>a|b</ref>\n|combatant1={{flag|"), F.col("p_type"), lit("}}\n|combatant2=[[Home|"), F.col("p_brand"), lit("]] league\n|commander1={{plainlist|"),
        lit("\n* [[A of B|"), F.col("p_name"), lit("]]}}\n|commander2=[["), F.col("p_brand"), lit("]]<br/>\n}}\n\nPage of '''"), F.col("p_name"), lit("'''.\n\nMore.\n== Head ==\nText"),
    )
    return _sides(spread(p.select("p_partkey", source.alias("source")), "p_partkey").select("p_partkey", text.infobox("source").alias("b")))


@query(_BOX_SQL.replace("'Page of ' || p_name || '.'", "''"))
def text_html_infobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infoboxes as HTML tables, section by section."""
    p = table(spark, sf_dir, "part")
    lit = F.lit
    source = F.concat(
        lit('<table><tr><td>no</td></tr></table><table class="infobox vevent"><tr><td>Result</td><td><b>'), F.col("p_brand"), lit("</b> victory</td></tr><tr><th>Belligerents</th></tr><tr><td>"), F.col("p_type"), lit("</td><td>"), F.col("p_brand"), lit(" <i>league</i></td></tr><tr><th>Commanders and leaders</th></tr><tr><td><a title='A of B' href='/wiki/A'>"),
        F.col("p_name"), lit("</a></td><td><ul><li><a title='Home'>"), F.col("p_brand"), lit("</a></li></ul></td></tr><tr><th>Strength</th></tr><tr><td>1</td><td>2</td></tr></table>"),
    )
    return _sides(spread(p.select("p_partkey", source.alias("source")), "p_partkey").select("p_partkey", text.html_infobox("source").alias("b")))


def _sides(b: DataFrame) -> DataFrame:
    """The columns of both infobox queries."""
    s = F.col("b.sides")
    names = F.array_join(F.flatten(F.transform(s, lambda x: x["segments"])), " | ")
    links = F.size(F.flatten(F.transform(s, lambda x: x["links"])))
    return b.select("p_partkey", "b.result", names.alias("names"), s[0]["belligerent"].alias("side_a"), s[1]["belligerent"].alias("side_b"), links.alias("links"), "b.lead")


_SAID = ["They met in the morning. The town was captured by night! Nobody knows more.", "A quiet year? Nothing of note.", "Repulsed at dawn. Victory at dusk.", ""]


@query(f"""with t as (select p_partkey, ({_SAID!r})[1 + p_partkey % 4] as body, case when p_partkey % 3 = 0 then '1204–1206 war' else 'on 12 March 1805 near' end as dated from part),
  s as (select *, list_filter(regexp_split_to_array(regexp_replace(body, '([.!?])\\s+', '\\1|', 'g'), '[|]'), lambda x: regexp_matches(lower(x), 'victory|defeat|stalemate|indecisive|draw|repulsed|repelled|captured|suppressed|overran')) as hits from t)
  select p_partkey, coalesce(hits[1], '') as sentence, regexp_extract(dated, '\\b(\\d{{1,2}}\\s+[A-Z][a-z]+\\s+\\d{{3,4}}|[A-Z][a-z]+\\s+\\d{{1,2}},\\s+\\d{{3,4}}|[A-Z][a-z]+\\s+\\d{{3,4}}|\\d{{3,4}}\\s*[–-]\\s*\\d{{3,4}})\\b', 0) as date_hint from s""")
def text_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in for a missing infobox: the first sentence that tells a result, and the first date-like words."""
    key = F.col("p_partkey")
    body = F.element_at(F.array(*map(F.lit, _SAID)), (key % 4 + 1).cast("int"))
    dated = F.when(key % 3 == 0, "1204–1206 war").otherwise("on 12 March 1805 near")
    told = F.filter(F.split(body, r"(?<=[.!?])\s+"), lambda x: F.rlike(F.lower(x), F.lit("|".join(RESULT_WORDS))))
    # Fixed value: the forms of a date.
    hint = r"\b(\d{1,2}\s+[A-Z][a-z]+\s+\d{3,4}|[A-Z][a-z]+\s+\d{1,2},\s+\d{3,4}|[A-Z][a-z]+\s+\d{3,4}|\d{3,4}\s*[–-]\s*\d{3,4})\b"
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.get(told, F.lit(0)), F.lit("")).alias("sentence"), F.regexp_extract(dated, hint, 0).alias("date_hint"))


@query("""select p_partkey, format('{:.1f}%', p_size / 3.0) as percent, printf('%+d', (p_size - 25)::int) as delta, case when p_size % 9 = 0 then 'n/a' else '#' || p_size end as rank, (p_size - 2) || '-' || (p_size + 2) as interval, upper(p_brand[1]) || lower(p_brand[2:]) as title, printf('%.6f', round(p_retailprice / 7, 6)) as fixed, try_cast(case when p_size % 4 = 0 then 'x' else p_size::varchar end as int) is null as no_number from part""")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages, signed changes, ranks, intervals, titles and fixed decimals as text."""
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.format_string("%.1f%%", n / F.lit(3.0)).alias("percent"), F.format_string("%+d", n - 25).alias("delta"), F.when(n % 9 == 0, "n/a").otherwise(F.concat(F.lit("#"), n.cast("string"))).alias("rank"), F.concat_ws("-", (n - 2).cast("string"), (n + 2).cast("string")).alias("interval"),
        F.initcap("p_brand").alias("title"), F.format_string("%.6f", F.round(F.col("p_retailprice") / 7, 6)).alias("fixed"), F.when(n % 4 == 0, "x").otherwise(n.cast("string")).try_cast("int").isNull().alias("no_number"),
    )


@query()
def text_page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body text, links and lead paragraph of each page's markup."""
    p = table(spark, sf_dir, "pages").select("page_id", text.page_parts("html").alias("p"))
    return p.select("page_id", F.char_length("p.text").alias("n_text"), F.size("p.links").alias("n_links"), "p.lead")


def alias_pairs(p: DataFrame, least: int = 92) -> DataFrame:
    """Pairs of names (p_name, p_partkey) whose ratio is at least `least`, of the lesser id first.

    Lossless filter: two texts of n and m characters with that ratio are at most d = (100 - least)(n + m) / 100 insertions
    and deletions apart, so that of d + 1 pieces of the shorter text one at least stands unchanged in the other, moved by d at most.
    """
    words = F.array_sort(F.filter(F.split(F.lower("p_name"), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    p = p.groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", "p_name", F.array_join(words, " ").alias("name"))
    p = p.withColumn("size", F.char_length("name"))
    more, less = 200 - least, least
    pieces = ["n", "m", "i", "piece"]

    def cut(df: DataFrame) -> DataFrame:
        df = df.withColumn("d", F.expr(f"int({100 - least} * (n + m) div 100)")).withColumn("i", F.explode(F.expr("sequence(0, d)")))
        return df.withColumn("at", F.expr("int(i * n div (d + 1))")).withColumn("len", F.expr("int((i + 1) * n div (d + 1)) - at"))

    short = cut(p.select("*", F.col("size").alias("n"), F.explode(F.expr(f"sequence(size, int({more} * size div {less}))")).alias("m")))
    short = short.select(*pieces[:3], F.expr("substring(name, at + 1, len)").alias("piece"), F.struct("id", "p_name", "name").alias("a"))
    long = cut(p.select("*", F.col("size").alias("m"), F.explode(F.expr(f"sequence(int(({less} * size + {more - 1}) div {more}), size)")).alias("n")))
    long = long.withColumn("at", F.explode(F.expr("sequence(greatest(0, at - d), least(at + d, m - len))")))
    long = long.select(*pieces[:3], F.expr("substring(name, at + 1, len)").alias("piece"), F.struct("id", "p_name", "name").alias("b"))
    met = short.join(long, pieces).filter("a.id <> b.id or a.p_name <> b.p_name")
    near = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    scored = near.select(F.col("a.id").alias("left"), F.col("b.id").alias("right"), text.token_sort_ratio(F.col("a.name"), F.col("b.name")).alias("ratio"))
    return scored.filter(F.col("ratio") >= least)


@query()
def text_fuzzy_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names alike by their sorted words. Names meet where they share a piece that no pair alike can lack."""
    return alias_pairs(table(spark, sf_dir, "part"))


@query("""with o as (select o_orderkey as page_id, min(o_orderdate)::date as a, greatest(max(l_shipdate)::date, min(o_orderdate)::date) as b from orders join lineitem on l_orderkey = o_orderkey group by 1),
  k as (select *, page_id % 10 as form, extract(year from a) = extract(year from b) as one_year, strftime(a, '%Y-%m') = strftime(b, '%Y-%m') as one_month from o)
  select page_id, case when form in (5, 6) then strftime(a, '%Y-01-01') when form = 7 then strftime(a, '%Y-%m-01') else a::varchar end as start,
    case when form in (0, 1, 8, 9) then a::varchar when form in (2, 3) then b::varchar when form = 4 then case when one_month then b::varchar else a::varchar end when form in (5, 6) then strftime(b, '%Y-01-01') else strftime(b, '%Y-%m-01') end as "end" from k""")
def text_date_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders and shipments written out in ten forms, and read back by the grammar of dates."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    o = table(spark, sf_dir, "orders").join(line, "o_orderkey").groupBy(F.col("o_orderkey").alias("page_id")).agg(F.min("o_orderdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("last"))
    o = o.withColumn("b", F.greatest("last", "a"))
    form = F.col("page_id") % 10
    day = lambda c, f: F.date_format(c, f)
    long, month = "d MMMM yyyy", F.date_format("a", "yyyy-MM") == F.date_format("b", "yyyy-MM")
    span = F.when(month, F.concat(day("a", "d"), F.lit("–"), day("b", long))).otherwise(day("a", long))
    text = (
        F.when(form == 0, day("a", long)).when(form == 1, day("a", "MMMM d, yyyy")).when(form == 2, F.concat_ws(" – ", day("a", long), day("b", long))).when(form == 3, F.concat_ws(" to ", day("a", "yyyy-MM-dd"), day("b", "yyyy-MM-dd"))).when(form == 4, span)
        .when(form == 5, F.concat_ws("–", day("a", "yyyy"), day("b", "yyyy"))).when(form == 6, F.concat_ws("–", day("a", "yyyy"), day("b", "yy"))).when(form == 7, F.concat_ws(" – ", day("a", "MMMM yyyy"), day("b", "MMM yyyy"))).when(form == 8, day("a", "d/M/yyyy")).otherwise(F.concat(day("a", "d MMM yyyy"), F.lit(" (O.S.)[1]")))
    )
    made = dates.with_date_span(o.select("page_id", text.alias("text")), "text", "s")
    ends = {w: dates.span_text(F.col(f"s.{w}_year"), F.col(f"s.{w}_month"), F.col(f"s.{w}_day")) for w in ("start", "end")}
    return made.select("page_id", *(v.alias(w) for w, v in ends.items()))
