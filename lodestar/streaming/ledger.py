"""Resumable routing of new files to several tables: a batch counts once all its parts are written, and each key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.files import exists

ACTIONS, LEDGER = "actions", "ledger"
_LEDGER = "batch long, rows long, processed long"


def _part(out: str, name: str, batch: int) -> str:
    return f"{out}/{name}/batch={batch}"


def committed(spark: SparkSession, out: str, name: str, schema) -> DataFrame:
    """The rows of a routed table in whole batches only, with their batch. A batch that was cut off is not seen until it is run again."""
    ledger = f"{out}/{LEDGER}"
    if not exists(spark, ledger) or not exists(spark, f"{out}/{name}"):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    whole = spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").parquet(ledger).select("batch")  # a row a batch
    rows = spark.read.schema(schema).option("basePath", f"{out}/{name}").parquet(f"{out}/{name}/*").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(F.broadcast(whole), "batch", "left_semi")


def run_routed(spark: SparkSession, source: str, schema, out: str, keys: list[str], decide: Callable[[DataFrame], DataFrame], routes: list[str], files: int = 1) -> None:
    """Reads new files, at most `files` a batch, adds `decision` to rows by decide(), and appends each to the table of its decision.

    A row whose keys an earlier whole batch, or an earlier row of this one, has is left out. A batch writes its part of each
    route and of the keys it has processed, each over what an attempt before may have left, and last its line of the ledger.
    Structured Streaming repeats an unfinished batch with the same files and number, so a run that was killed between any two
    writes ends with the same tables as one that ran through.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    own = ",".join(f"`{k}` {spark.createDataFrame([], schema).schema[k].dataType.simpleString()}" for k in keys)

    def write(batch: DataFrame, number: int) -> None:
        before = committed(spark, out, ACTIONS, own).filter(F.col("batch") != number).select(*keys)
        fresh = batch.dropDuplicates(keys).join(before, keys, "left_anti")
        decided = decide(fresh)
        fresh_path = _part(out, "decided", number)
        decided.write.mode("overwrite").parquet(fresh_path)
        decided = spark.read.schema(decided.schema).parquet(fresh_path)
        for name in routes:
            decided.filter(F.col("decision") == name).write.mode("overwrite").parquet(_part(out, name, number))
        decided.select(*keys).write.mode("overwrite").parquet(_part(out, ACTIONS, number))
        line = decided.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("processed")).withColumn("rows", F.lit(batch.count()).cast("long"))
        line.select("batch", "rows", "processed").write.mode("overwrite").parquet(_part(out, LEDGER, number))

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
