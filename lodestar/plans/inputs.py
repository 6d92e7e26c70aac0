"""Queries of scans, sinks and incremental runs: each writes to the shared folder and reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.relational import ensure_columns, numbered, route
from lodestar.operators.tables import shared_folder
from lodestar.plans.binding import table
from lodestar.plans.registry import query
from lodestar.sources import files
from lodestar.streaming.incremental import run_available, windowed_counts
from lodestar.streaming.ledger import committed, run_routed


@query("""select s_suppkey::varchar as s_suppkey, s_name || ', "quoted"' || chr(10) || 'line' as s_name, s_nationkey::varchar as s_nationkey, '' as note from supplier""")
def io_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with quotes and line breaks, nulls as empty text, all columns text; appended in two parts."""
    path = shared_folder(spark, "csv")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "quoted"\nline')).alias("s_name"), "s_nationkey", F.lit(None).cast("string").alias("note"))
    files.write_csv(s.filter("s_suppkey % 2 = 0"), path)
    files.write_csv(s.filter("s_suppkey % 2 = 1"), path, "append")
    return files.read_csv(spark, path, s.columns)


@query("select 0::bigint as n, 0::bigint as rows where false")
def io_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing table is an empty one with its columns, and defaults fill columns it lacks."""
    none = files.read_optional_csv(spark, shared_folder(spark, "none"), ["n"])
    return ensure_columns(none.select(F.col("n").cast("long")), {"rows": 0}).withColumn("rows", F.col("rows").cast("long"))


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def io_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as a script's list, a file a part, and read back."""
    path = shared_folder(spark, "script")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    files.write_script_json(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name"), path)
    return files.read_script_rows(spark, path, "n_nationkey int, n_name string, r_name string")


@query("select count(*) as pages, count(distinct o_custkey) as commanders, round(max(o_totalprice), 2) as dearest from orders")
def io_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of metrics: one nested JSON value, written wrapped in a script and as it is, both read by schema."""
    path = shared_folder(spark, "document")
    o = table(spark, sf_dir, "orders").agg(F.struct(F.count("*").alias("pages"), F.countDistinct("o_custkey").alias("commanders")).alias("counts"), F.round(F.max("o_totalprice"), 2).alias("dearest"))
    schema = "counts struct<pages:bigint,commanders:bigint>, dearest double"
    # One row of aggregates, so one file.
    o.coalesce(1).write.json(f"{path}/plain")
    plain = files.read_json(spark, f"{path}/plain", schema)
    plain.select(F.concat(F.lit("window.METRICS = "), F.to_json(F.struct(*plain.columns)), F.lit(";")).alias("value")).coalesce(1).write.text(f"{path}/script")
    both = files.read_script_json(spark, f"{path}/script", schema).unionByName(plain).distinct()
    return both.select("counts.*", "dearest")


@query("select p_partkey, p_size, round(p_retailprice, 2) as price, p_partkey % 2 = 0 as even from part")
def io_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV scan with the types of its schema; a cell that is no such value is null, and one with a default takes it."""
    path = shared_folder(spark, "typed")
    p = table(spark, sf_dir, "part")
    files.write_csv(p.select("p_partkey", F.concat("p_size", F.lit("")).alias("p_size"), F.round("p_retailprice", 2).alias("price"), (F.col("p_partkey") % 2 == 0).alias("even")), path, mark=False)
    schema = "p_partkey long, p_size int, price double, even boolean"
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


@query("select c_custkey, row_number() over (order by c_custkey)::bigint - 1 as place from customer")
def io_paginated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source in pages of ten, each with the token of the next, followed from the first to the end."""
    path = shared_folder(spark, "paged")
    c = numbered(table(spark, sf_dir, "customer").select("c_custkey"), "n").withColumn("page", F.floor((F.col("n") - 1) / 10).cast("int"))
    token = lambda p: F.concat(F.lit("t"), p.cast("string"))
    pages = c.groupBy("page").agg(F.array_sort(F.collect_list("c_custkey")).alias("items"))
    pages = pages.select(token(F.col("page")).alias("token"), F.when(F.col("page") < c.agg(F.max("page")).first()[0], token(F.col("page") + 1)).alias("next"), "items")
    pages.write.json(path)
    got = files.paged(spark, path, "token string, next string, items array<bigint>", "t0")
    return got.select(F.col("item").alias("c_custkey"), (F.col("page") * 10 + F.col("place")).cast("long").alias("place"))


@query("""select page_id, 'page_' || page_id as slug, len(url) as n_url, len(regexp_extract_all(html, '<a [^>]*href=')) as links, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') as lang, contains(html, '<article>') as has_article from pages""")
def io_page_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a bundle (title, links, properties), written to a folder of its slug and read back by the index of folders."""
    path = shared_folder(spark, "bundles")
    p = table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    bundle = p.select("page_id", F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("slug"), "url", links.alias("links"), F.create_map(F.lit("lang"), F.when(lang != "", lang), F.lit("article"), F.contains("html", F.lit("<article>")).cast("string")).alias("props"))
    files.write_pages(bundle, path, "slug")
    back = files.read_pages(spark, path, "page_id long, url string, links array<string>, props map<string,string>", "slug")
    return back.select("page_id", "slug", F.char_length("url").alias("n_url"), F.size("links").alias("links"), F.col("props")["lang"].alias("lang"), (F.col("props")["article"] == "true").alias("has_article"))


@query("""with t as (select n_name, n_nationkey, row_number() over (order by n_name) as rn from nation) select 0 as line, '| n_name | n_nationkey |' as text union all select 1, '| --- | --- |' union all select (rn + 1)::int, '| ' || n_name || ' | ' || n_nationkey || ' |' from t where rn <= 10""".replace("'| --- | --- |'", "'| --- | --- |'"))
def io_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of a table as Markdown."""
    return files.markdown(table(spark, sf_dir, "nation"), ["n_name", "n_nationkey"], [F.asc("n_name")], 10)


@query("""select sha1('[{"key":"id","value":"' || r_regionkey || '"},{"key":"op","value":"get"}]') as key, case when r_regionkey % 2 = 0 then 'cached ' else 'fetched ' end || r_regionkey as body, case when r_regionkey % 2 = 0 then 0 else 1 end as tries from region""")
def io_cached_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from a cache by content address, else fetched, with tries counted."""
    params = table(spark, sf_dir, "region").select(F.create_map(F.lit("op"), F.lit("get"), F.lit("id"), F.col("r_regionkey").cast("string")).alias("params"))
    cache = params.filter(F.col("params")["id"].cast("int") % 2 == 0).select(files.cached_by(F.col("params")).alias("key"), F.concat(F.lit("cached "), F.col("params")["id"]).alias("body"))
    return files.cached_fetch(params, cache, lambda p: f"fetched {p['id']}")


@query("""with d as (select c_custkey, case when c_acctbal < 0 then 'removed' when c_acctbal > 9000 then 'quarantine' else 'main' end as decision from customer) select decision, count(*) as n from d group by 1""")
def io_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One routed write, read back by partition."""
    path = shared_folder(spark, "routed")
    files.write_routed(route(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), {"removed": F.col("c_acctbal") < 0, "quarantine": F.col("c_acctbal") > 9000}, "main"), path)
    return spark.read.parquet(path).groupBy("decision").agg(F.count("*").alias("n"))


@query("""select 'part ' || p_partkey as title, coalesce(p2.p_name, 'missing') as name from (select p_partkey from part union all select -1) q left join part p2 on p2.p_partkey = case when q.p_partkey % 10 = 0 then q.p_partkey - 1 else q.p_partkey end""".replace("'part ' || p_partkey", "'part ' || q.p_partkey"))
def io_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles looked up through redirects, with defaults for misses."""
    p = table(spark, sf_dir, "part")
    name = lambda c: F.concat(F.lit("part "), c.cast("string"))
    key = F.col("p_partkey")
    titles = p.select(name(key).alias("title")).unionByName(spark.range(1).select(F.lit("part -1").alias("title")))
    aliases = p.filter(key % 10 == 0).select(name(key).alias("alias"), name(key - 1).alias("target"))
    pages = p.select(name(key).alias("title"), F.col("p_name").alias("name"))
    return files.with_aliases(titles, aliases, pages, {"name": "missing"}).select("title", "name")


@query("select r_regionkey, upper(r_name) as r_name, (select count(*) from nation) as nations from region")
def io_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new snapshot of two tables of which one changed."""
    path = shared_folder(spark, "snapshots")
    one = files.Snapshots(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("region", "nation")})
    two = one.next(path, {"region": one.read("region").withColumn("r_name", F.upper("r_name"))})
    n = two.read("nation").agg(F.count("*").alias("nations"))
    return two.read("region").join(F.broadcast(n), how="cross").select("r_regionkey", "r_name", "nations")


@query("select event_id, user_id, event_type from events")
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two incremental runs over overlapping files keep each key once."""
    path = shared_folder(spark, "stream")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    for cut in ("event_id % 2 = 0", "event_id % 3 >= 0"):
        e.filter(cut).write.mode("append").parquet(f"{path}/in")
        run_available(spark, f"{path}/in", e.schema, f"{path}/out", f"{path}/state", ["event_id"], "ts", "3650 days")
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id", "event_type")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by hour and type; the same plan runs on a stream."""
    w = windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])
    return w.select("start", "event_type", "n", F.round("total", 4).alias("total"))


_DECISION = "case when value is null then 'quarantined' when user_id % 7 = 0 then 'removed' when event_type = 'click' then 'repaired' else 'kept' end"


@query(f"select event_id, user_id, event_type, {_DECISION} as decision from events where event_id % 5 <> 4")
def stream_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events routed by decision in two resumable runs over overlapping files: each key stands once, in one table."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    source, out = shared_folder(spark, "arriving"), shared_folder(spark, "routed")
    schema, routes = events.schema, ["kept", "repaired", "quarantined", "removed"]
    decide = lambda rows: rows.withColumn("decision", F.expr(_DECISION))
    for k, rows in enumerate((events.filter("event_id % 5 < 3"), events.filter("event_id % 5 in (2, 3)"))):
        rows.write.mode("append" if k else "overwrite").parquet(source)
        run_routed(spark, source, schema, out, ["event_id"], decide, routes, files=4)
    whole = [committed(spark, out, name, events.withColumn("decision", F.lit("")).schema) for name in routes]
    return reduce(DataFrame.unionByName, whole).select("event_id", "user_id", "event_type", "decision")
