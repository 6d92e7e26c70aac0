"""Chains of pages: any length, and errors for broken ones."""

import pytest

from lodestar.sources import files

SCHEMA = "token string, next string, items array<bigint>"


def source(spark, tmp_path, rows):
    path = str(tmp_path / "source")
    spark.createDataFrame(rows, SCHEMA).write.json(path)
    return path


def test_all_pages_of_a_long_chain(spark, tmp_path):
    n = 25_000
    path = str(tmp_path / "source")
    spark.range(n).selectExpr("'t' || id as token", f"if(id < {n - 1}, 't' || (id + 1), null) as next", "array(id * 2, id * 2 + 1) as items").write.json(path)
    got = files.paged(spark, path, SCHEMA, "t0")
    assert got.count() == 2 * n and got.filter("item <> 2 * page + place").count() == 0


def test_pages_off_the_chain_are_left_alone(spark, tmp_path):
    path = source(spark, tmp_path, [("a", "b", [1]), ("b", None, [2, 3]), ("x", "b", [9]), ("y", "y", [8])])
    assert sorted(tuple(r) for r in files.paged(spark, path, SCHEMA, "a").collect()) == [(0, 0, 1), (1, 0, 2), (1, 1, 3)]


def test_a_chain_that_returns_raises(spark, tmp_path):
    path = source(spark, tmp_path, [("a", "b", [1]), ("b", "c", [2]), ("c", "b", [3])])
    with pytest.raises(ValueError, match="returns"):
        files.paged(spark, path, SCHEMA, "a")


def test_a_lost_token_raises(spark, tmp_path):
    path = source(spark, tmp_path, [("a", "b", [1]), ("b", "gone", [2])])
    with pytest.raises(ValueError, match="gone"):
        files.paged(spark, path, SCHEMA, "a")


def test_a_source_without_pages(spark, tmp_path):
    assert files.paged(spark, source(spark, tmp_path, []), SCHEMA, "a").collect() == []
