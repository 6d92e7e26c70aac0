"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontam, dualtree, jaccard, lm, packing, periodic, pii, secrets, sketch, tokenbin, toxicity, unigram
from lodestar.llm.shared import documents, fold

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_trigram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.cross_scored(documents(spark, sf_dir))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.digests(pii.find(docs, pii.fit(docs)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.digests(secrets.scan(docs.select("doc_id", "text"), secrets.train(secrets.labelled_strings(docs))))


def op6_bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.neighbours(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_files(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op11_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.hard_negatives(dualtree.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.runs(periodic.planted(documents(spark, sf_dir))))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_trigram_trie, op2_template_decontamination, op3_personal_data, op4_toxicity, op5_secrets, op6_bottom_k_sketch, op7_jaccard_join, op8_token_files, op9_unigram_counts, op10_bpe_round_trip, op11_dual_tree_negatives, op12_periodic_runs, op13_best_fit_packing]
    return {f.__name__: f for f in found}


#: Exact Jaccard over shared shingles, and the classes by transitive closure.
JACCARD_SQL = """with recursive w as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as t from documents),
s as (select distinct doc_id, unnest(case when len(t) = 0 then [] when len(t) < 5 then [array_to_string(t, ' ')] else list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where i >= 0.8 * (a.n + b.n - i) union select a.doc_id, b.doc_id from w a join w b on a.text = b.text and a.doc_id <> b.doc_id),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
c as (select x, least(x, min(y)) as class_id from r group by 1), k as (select x, count(*) as n_links from l group by 1)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0) as n_links from documents left join c on c.x = doc_id left join k on k.x = doc_id"""


#: All inner products of the anchors, their best positives, and the best of what scores closely below each.
NEGATIVES_SQL = """with e as (select row_number() over (order by vec_id) as u, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.u, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select *, row_number() over (partition by u order by score desc, id) as k from s where same qualify k <= 5),
n as (select p.anchor_id, p.id as positive_id, cast(row_number() over (partition by p.u, p.k order by s.score desc, s.id) as integer) as "rank", s.id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.u = p.u and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select * from n where "rank" <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op7_jaccard_join": JACCARD_SQL, "op11_dual_tree_negatives": NEGATIVES_SQL}
