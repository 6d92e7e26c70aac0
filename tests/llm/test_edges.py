"""Every operator and stage on odd rows and on empty tables."""

import math

import public_tokenizers
import pytest

import corpus_pipeline
from lodestar.llm import bpe, decontam, jaccard, lm, pii, secrets, sketch, tokenbin, toxicity, unigram

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def quick():
    return pii.train(["some words here to fill a text with them"], 2), toxicity.train(["bad one here", "good one here"] * 4, [1, 0] * 4, 3)


def run(spark, op, df, quick):
    bench = spark.createDataFrame([(1, "same words in this text as in that text"), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    if op == "lm":
        return lm.cross_scored(df)
    if op == "decontam":
        return decontam.contaminated(df, bench)
    if op == "pii":
        return pii.digests(pii.find(df, quick[0]))
    if op == "toxicity":
        return toxicity.score(df, quick[1])
    if op == "secrets":
        return secrets.digests(secrets.scan(df, secrets.train(secrets.labelled_strings(df))))
    if op == "sketch":
        return sketch.neighbours(df)
    if op == "jaccard":
        return jaccard.join(df)
    if op == "tokenbin":
        return tokenbin.token_files(df, BYTE)
    if op == "unigram":
        return unigram.token_counts(df, PIECE)
    return bpe.digests(df, BYTE)


OPS = ["lm", "decontam", "pii", "toxicity", "secrets", "sketch", "jaccard", "tokenbin", "unigram", "bpe"]


@pytest.mark.parametrize("op", OPS)
def test_odd_rows(spark, odd, quick, op):
    rows = run(spark, op, odd, quick).collect()
    if op == "decontam":
        assert {r.doc_id for r in rows} == {3, 4} and all(r.item_id == 1 for r in rows)
        return
    assert len(rows) == odd.count()
    if op == "jaccard":
        by = {(r.doc_id, r.node): r for r in rows}
        assert {(r.class_id, r.n_links) for r in rows if r.doc_id in (3, 4)} == {(3, 2)}
        assert {(r.class_id, r.n_links) for r in rows if r.doc_id is None} == {(None, 1)}
        assert {(r.class_id, r.n_links) for r in rows if r.doc_id in (1, 2)} == {(1, 1)}
        assert len(by) == 8
    if op == "lm":
        assert {(r.doc_id, r.n_tokens) for r in rows} == {(1, 1), (2, 1), (None, 12), (3, 10), (4, 10), (5, 30001), (6, 2), (7, 8)}
        assert len({round(r.score, 9) for r in rows if r.doc_id in (1, 2)}) == 1
    if op == "sketch":
        prints = {i: {r.fingerprint for r in rows if r.doc_id == i} for i in (1, 2, 3, 4, 5)}
        assert prints[1] == prints[2] and prints[3] == prints[4] and len(prints[4]) == 1 and prints[5] != prints[4]
        assert [r.n_chars for r in rows if r.doc_id in (1, 2)] == [0, 0] and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    if op == "tokenbin":
        sizes = sorted((r.start, r.n_tokens) for r in rows)
        assert [a for a, _ in sizes] == [sum(n for _, n in sizes[:k]) for k in range(len(sizes))]
        assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [1, 1] and len({r.ids_crc32 for r in rows if r.doc_id in (3, 4)}) == 1
    if op in ("unigram", "bpe"):
        n = "n_tokens"
        assert [r[n] for r in rows if r.doc_id in (1, 2)] == [0, 0] and len({r[n] for r in rows if r.doc_id in (3, 4)}) == 1 and all(r[n] > 1000 for r in rows if r.doc_id in (5, 6))
    if op == "toxicity":
        assert all(0 <= r.toxic_score <= 1 and not math.isnan(r.toxic_score) for r in rows)
        assert rows[0].asDict().keys() >= {"node", "label", "text"}
    if op == "pii":
        assert [r.n_email for r in rows if r.doc_id == 7] == [1]
    if op == "secrets":
        assert [(r.n_assign, r.n_hex) for r in rows if r.doc_id == 7] == [(1, 1)]


@pytest.mark.parametrize("op", OPS)
def test_empty_table(spark, none, quick, op):
    assert run(spark, op, none, quick).collect() == []


def test_stages(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.collect()


def test_stage_decisions(spark, odd, sf_dir):
    kept = corpus_pipeline.near_duplicate_stage(spark, odd, sf_dir)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 3, 5, 6, 7)] + [(True, 0)]
    clean = corpus_pipeline.decontamination_stage(spark, odd, sf_dir)
    assert sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))
    mild = corpus_pipeline.toxicity_stage(spark, odd, sf_dir)
    assert {(r.doc_id, r.text) for r in mild.collect()} == {(r.doc_id, r.text) for r in odd.collect()}
    text = corpus_pipeline.secret_stage(spark, odd, sf_dir).filter("doc_id = 7").first()
    assert "[SECRET]" in text.text and "abcdef0123" not in text.text and text.n_chars == len(text.text)
    assert corpus_pipeline.encoding_stage(spark, odd, sf_dir).filter("n_tokens >= 0").count() == odd.count()
