"""Links of the given pages: by container, and assigned to the segments of a page's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.curation import FLANKS, GENERIC_TOKENS, META, NON_PERSON, RANK_PREFIX
from lodestar.functions.links import HREF, MARKS, TEXT, TITLE, candidates, entries, links
from lodestar.plans.binding import table
from lodestar.plans.registry import query

ARTICLE, CUTS = r"(?s)<article>(.*?)</article>", r"(?i)<br\s*/?>|</?p[^>]*>|</?h1[^>]*>|\|"


def _plain(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def _name(c: str) -> str:
    out = rf"regexp_replace(regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '\([^)]*\)', '', 'g'), '\[[^\]]+\]', '', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?i){RANK_PREFIX}', ''), '[†‡#*?]+', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '(?i)\b(c\.|ca\.)\b', '', 'g'), '\s+', ' ', 'g'))"


def _generic(low: str) -> str:
    words = ", ".join(f"'{w}'" for w in [*GENERIC_TOKENS, *FLANKS])
    return rf"(length(regexp_replace({low}, '[^a-zà-öø-ÿ]', '', 'g')) < 2 or {low} in ({words}) or regexp_matches({low}, '{'|'.join(NON_PERSON)}') or {low} like '%:' or (regexp_matches({low}, '[0-9]') and not regexp_matches({low}, '\b(i|ii|iii|iv|v|vi|vii|viii|ix|x)\b')))"


LINKS = rf"""mark as (select page_id, unnest(regexp_extract_all(html, '{MARKS}')) as mark, generate_subscripts(regexp_extract_all(html, '{MARKS}'), 1) - 1 as place from pages),
kinds as (select *, case when regexp_matches(mark, '(?i)^<a') then 0 when mark like '</%' then -1 else 1 end as kind from mark),
sums as (select *, sum(kind) over (partition by page_id order by place) as s from kinds),
deep as (select *, s - least(min(s) over (partition by page_id order by place), 0) as depth from sums),
held as (select *, count_if(kind = 1 and depth = 1) over (partition by page_id order by place) as container from deep),
cut as (select page_id, place, case when depth > 0 then container end as container, regexp_replace(regexp_extract(mark, '{HREF}', 1), '#.*$', '') as href, {_plain(f"regexp_extract(mark, '{TEXT}', 1)")} as text, nullif(regexp_extract(mark, '{TITLE}', 1), '') as given from held where kind = 0),
named as (select page_id, place, container, trim(regexp_replace(coalesce(given, replace(replace(substr(href, 2), '_', ' '), '%20', ' ')), '\s+', ' ', 'g')) as title, href, text from cut),
link as materialized (select * from named where href like '/%' and title <> '' and title not like 'Edit section%' and not regexp_matches(title, '^({"|".join(META)})'))"""


@query(f"with {LINKS} select page_id, place::int as place, container::bigint as container, title, href, text from link where container is not null qualify row_number() over (partition by page_id, lower(title) order by place) = 1")
def text_container_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate links of every page: those inside a list item or table row, each title once."""
    return candidates(links(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


@query(rf"""with {LINKS}, cell as (select page_id, regexp_extract(html, '{ARTICLE}', 1) as body from pages),
seg as (select page_id, unnest(string_split_regex(body, '{CUTS}')) as x, generate_subscripts(string_split_regex(body, '{CUTS}'), 1) as i from cell),
clean as (select page_id, i, {_name(_plain("x"))} as segment from seg), real as (select * from clean where not {_generic("lower(segment)")} qualify row_number() over (partition by page_id, lower(segment) order by i) = 1),
l as (select page_id, row_number() over (partition by page_id order by place) as j, title, href, text, {_name("title")} as name, lower({_name("title")}) as a, lower({_name("text")}) as b from link),
met as (select r.page_id, i, j, coalesce(nullif({_name("coalesce(nullif(text, ''), segment)")}, ''), name) as raw, name, href as url, 'linked_article' as method from real r join l on l.page_id = r.page_id and ((a <> '' and contains(lower(segment), a)) or (b <> '' and contains(lower(segment), b)))
  union all select page_id, i, 0, segment, segment, '', 'cleaned_segment_text' from real where page_id not in (select page_id from l)),
one as (select * from met where not {_generic("lower(name)")} qualify row_number() over (partition by page_id, lower(name), url order by i, j) = 1)
select page_id, (row_number() over (partition by page_id order by i, j) - 1)::int as place, raw, name, url, method from one""")
def text_cell_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page assigned to the segments of its text, and the segments alone where a page has no links."""
    pages = table(spark, sf_dir, "pages")
    own = links(pages, "page_id", "html").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "title", F.col("href").alias("url"), "text"))).alias("links"))  # one page's links
    body = F.split(F.regexp_extract("html", ARTICLE, 1), CUTS)
    segments = F.transform(body, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "(?s)<[^>]*>", " "), r"\s+", " ")))
    cells = pages.select("page_id", segments.alias("segments")).join(own, "page_id", "left")
    none = F.array().cast("array<struct<place:int,title:string,url:string,text:string>>")
    return entries(cells.withColumn("links", F.coalesce("links", none)), "page_id")
