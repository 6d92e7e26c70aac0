"""The corpus pipeline: five filtering and rewriting stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Nulls: a null text counts as empty and is kept as it is; a null id is a value like any other;
repeated rows are copies of each other, of which the near-duplicate stage keeps one; an empty table
passes through all stages as an empty table; a very long text is a chunk of its own; further columns stay,
but for ones named toxic_score, ids or n_tokens, which the stages make anew.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontam, jaccard, secrets, toxicity
from lodestar.llm.queries import BYTE_BPE
from lodestar.llm.shared import shared_dir, small_batches


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score 0.5 or more go."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(F.col("toxic_score") < 0.5).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates the document of least id stays."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents in which a benchmark item is found go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: secrets in a text are replaced by a mark; n_chars follows the text."""
    found = secrets.scan(docs, secrets.train(secrets.labelled_strings(docs)), into="\1secrets")
    clean = secrets.redact(found, "\1secrets")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.size("\1secrets") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return clean.select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the token ids of each text, in place of the text."""
    small_batches(spark)
    coded = bpe.encode(docs, public_tokenizers.path(BYTE_BPE))
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("encoding", encoding_stage),
]

#: No SQL expresses the networks and the exact tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is a table in the shared folder, read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return docs
