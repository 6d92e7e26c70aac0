"""Scans and sinks of the snapshot formats: CSV (plain or gzip), JSON, JSON wrapped in a script, Parquet."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.operators.tables import shared_table

#: Characters of pages that a reading task sends on at once.
CHUNK = 4_000_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> bool:
    """Deletes a folder of any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text with null as the empty text; quoted line breaks stay, a leading byte-order mark is dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", True).csv(path)
    first = columns[0]
    return df.na.fill("").withColumn(first, F.regexp_replace(first, "^﻿", ""))


def read_optional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The CSV, its gzip twin if only that is there, or an empty table of the same columns."""
    for p in (path, f"{path}.gz"):
        if exists(spark, p):
            return read_csv(spark, p, columns)
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_script_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The value of `window.NAME = {...};` files."""
    body = F.regexp_extract("value", r"(?s)=\s*(.*?);?\s*$", 1)
    return spark.read.option("wholetext", True).text(path).select(F.from_json(body, schema).alias("x")).select("x.*")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", mark: bool = True) -> None:
    """One folder of CSV parts with headers, quotes only where needed; each part begins with a byte-order mark unless told not to; mode append resumes."""
    named = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
    named.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_script_json(df: DataFrame, path: str, name: str = "DATA") -> None:
    """Rows as scripts that each add their JSON to a list, a file a part, so that no task holds them all."""
    df.select(F.concat(F.lit(f"(window.{name} = window.{name} || []).push("), F.to_json(F.struct(*df.columns)), F.lit(");")).alias("value")).write.mode("overwrite").text(path)


def read_script_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of write_script_json."""
    body = F.regexp_extract("value", r"(?s)\.push\((.*)\);$", 1)
    return spark.read.text(path).select(F.from_json(body, schema).alias("x")).select("x.*")


def _folder(slug: str, value: str | None) -> str:
    """A page's folder, named and escaped as Spark names that of a partition."""
    escaped = re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value or "")
    return f"{slug}={escaped or '__HIVE_DEFAULT_PARTITION__'}"


def write_pages(df: DataFrame, path: str, slug: str) -> None:
    """One folder of JSON for each page, named by its slug, and an index of them, a table under `_pages`.

    Each task writes the folders of its pages, a file a slug, and tells of them to the index; a task that is tried again
    writes the same names. The store is one that Arrow knows (local, HDFS, S3 and the like). Spark's own partitioned
    write would move each folder again in the driver, and its reader list them all there. Rows of one slug stand in one
    file; rows without one share a folder. Spark can still read the folders as partitions.
    """
    _delete(df.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        last, out, draft = None, None, ""
        for batch in batches:
            new: dict[str, str | None] = {}
            for value, line in zip(batch.column("slug").to_pylist(), batch.column("line").to_pylist(), strict=True):
                name = _folder(slug, value)
                if name != last:
                    if out:
                        out.close()
                        store.move(draft, f"{base}/{last}/pages.json")
                    store.create_dir(f"{base}/{name}", recursive=True)
                    # A name with a dot in front is passed over by readers.
                    last, draft = name, f"{base}/{name}/.{uuid.uuid4().hex}"
                    out, new[name] = store.open_output_stream(draft), value
                out.write(line.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(list(new.values()), pa.string()), pa.array(list(new), pa.string())], names=["slug", "folder"])
        if out:
            out.close()
            store.move(draft, f"{base}/{last}/pages.json")

    # The empty slug and none have one folder.
    rows = df.select(F.nullif(F.col(slug).cast("string"), F.lit("")).alias("slug"), F.to_json(F.struct(*(c for c in df.columns if c != slug))).alias("line"))
    rows.repartition("slug").sortWithinPartitions("slug").mapInArrow(write, "slug string, folder string").write.parquet(f"{path}/_pages")


def read_pages(spark: SparkSession, path: str, schema: str, slug: str) -> DataFrame:
    """The pages of write_pages, with their slugs: tasks share the index and read the files it names, so the driver lists none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            slugs, lines, size = [], [], 0
            for value, folder in zip(batch.column("slug").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{folder}/pages.json") as src:
                    found = src.read().decode().split("\n")[:-1]
                lines += found
                slugs += [value] * len(found)
                size += sum(map(len, found))
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(slugs, pa.string()), pa.array(lines, pa.string())], names=["slug", "line"])
                    slugs, lines, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(slugs, pa.string()), pa.array(lines, pa.string())], names=["slug", "line"])

    lines = spark.read.schema("slug string, folder string").parquet(f"{path}/_pages").mapInArrow(read, "slug string, line string")
    return lines.select(F.from_json("line", schema).alias("x"), F.col("slug").alias(slug)).select("x.*", slug)


def markdown(df: DataFrame, columns: list[str], order: list[Column], rows: int) -> DataFrame:
    """The first rows as lines of a Markdown table (line, text): a bounded report."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    top = df.orderBy(*order).limit(rows).withColumn("line", F.row_number().over(Window.orderBy(*order)) + 1).select("line", line.alias("text"))
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return df.sparkSession.createDataFrame(list(enumerate(head)), "line int, text string").unionByName(top)


def paged(spark: SparkSession, path: str, schema: T.StructType | str, first: str) -> DataFrame:
    """Items of a source that answers in pages (token, next, items), followed from the first token to a page without a next one.

    The chain is walked by pointer doubling: a table of what lies 2^k pages after each token is joined with itself, and the
    pages reached so far, with their numbers, double each round; both are a few bytes a page and written, so n pages take
    log2 n rounds and none comes to the driver. A chain that returns to a token, or names one that the source does not
    have, raises an error; a source without pages has no items.
    """
    pages = spark.read.schema(schema).json(path)
    jump = shared_table(pages.select("token", F.col("next").alias("to")), "jumps")
    tokens, n = jump.select("token"), jump.count()
    reached, step = spark.createDataFrame([(first, 0)] if n else [], "token string, page long"), 1
    while step <= n:
        ahead = reached.join(jump, "token").filter("to is not null").select(F.col("to").alias("token"), (F.col("page") + step).alias("page"))
        reached = shared_table(reached.unionByName(ahead), "reached")
        on = jump.select(F.col("token").alias("to"), F.col("to").alias("far")).filter("far is not null")
        jump = shared_table(jump.join(on, "to").select("token", F.col("far").alias("to")), "jumps")
        step *= 2
    lost = reached.join(tokens, "token", "left_anti").first()
    if lost:
        raise ValueError(f"the source has no page of token {lost.token}")
    if reached.filter(F.col("page") >= n).first():
        raise ValueError("the chain of pages returns to one of its tokens")
    return pages.join(reached, "token").select("page", F.posexplode("items").alias("place", "item"))


def cached_fetch(params: DataFrame, cache: DataFrame, fetch, tries: int = 4) -> DataFrame:
    """Answers (key, body, tries) of requests (params map): from the cache by content address, else fetched with doubling waits.

    `fetch` takes the parameters as a dict and returns the body, or raises to be tried again; each task fetches its own misses.
    """
    keyed = params.withColumn("key", cached_by(F.col("params")))
    hit = keyed.join(cache.select("key", "body"), "key", "left")

    def run(batches):
        import time

        import pandas as pd

        for rows in batches:
            out = []
            for key, p in zip(rows["key"], rows["params"], strict=True):
                for k in range(tries):
                    try:
                        out.append((key, fetch(dict(p)), k + 1))
                        break
                    except OSError:
                        if k + 1 == tries:
                            out.append((key, None, tries))
                        else:
                            time.sleep(0.001 * 2**k)
            yield pd.DataFrame(out, columns=["key", "body", "tries"])

    missed = hit.filter("body is null").select("key", "params").dropDuplicates(["key"]).mapInPandas(run, "key string, body string, tries int")
    return hit.filter("body is not null").select("key", "body", F.lit(0).alias("tries")).distinct().unionByName(missed)


def write_routed(df: DataFrame, path: str, by: str = "decision") -> None:
    """One folder a decision, in one pass."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def cached_by(params: Column) -> Column:
    """A content address of a request: the hash of its sorted parameters."""
    return F.sha1(F.to_json(F.array_sort(F.map_entries(params))))


def with_aliases(titles: DataFrame, aliases: DataFrame, pages: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Looks titles up through an alias table (redirects), with default values for misses."""
    hop = titles.join(aliases.select(F.col("alias").alias("title"), "target"), "title", "left")
    hop = hop.withColumn("target", F.coalesce("target", "title"))
    found = hop.join(pages.withColumnRenamed("title", "target"), "target", "left")
    return found.fillna(dict(defaults))


class Snapshots:
    """A directory of named tables; a new snapshot lists unchanged tables by their old paths and writes only what changed."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, str] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.tables[name])

    def next(self, folder: str, changed: Mapping[str, DataFrame]) -> Snapshots:
        tables = dict(self.tables)
        for name, df in changed.items():
            path = f"{folder}/{name}"
            df.write.mode("errorifexists").parquet(path)
            tables[name] = path
        return Snapshots(self.spark, tables)
