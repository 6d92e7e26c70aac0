"""Changes by field between written snapshots with added, lost and retyped columns."""

from lodestar.operators.snapshots import field_changes, schema_changes


def test_changes_by_field(spark, tmp_path):
    old = [(1, "a", 1.0, 5, [1], "x"), (2, "b", 0.1 + 0.2, 6, [1], None), (3, None, None, 7, None, "z"), (None, "n", 1.0, 8, [2], "q"), (5, "gone", 1.0, 9, [3], "w")]
    new = [(1, "a", 1.0, "5", [1], 4.5), (2, "B", 0.3, "6.0", [1, 2], None), (3, "c", 2.0, "x", [], 1.5), (None, "n", 1.5, None, [2], 0.0), (6, "new", 1.0, "9", [3], 1.0)]
    paths = [str(tmp_path / n) for n in ("old", "new")]
    spark.createDataFrame(old, "k int, name string, v double, n int, list array<int>, lost string").write.parquet(paths[0])
    spark.createDataFrame(new, "k int, name string, v double, n string, list array<int>, extra double").write.parquet(paths[1])
    a, b = (spark.read.parquet(p) for p in paths)
    got = {tuple(r) for r in field_changes(a, b, ["k"]).collect()}
    assert got == {
        (1, "lost", "field_lost", "x", None), (1, "extra", "field_added", None, "4.5"),
        (2, "name", "value", "b", "B"), (2, "list", "value", "[1]", "[1,2]"),
        (3, "name", "value", None, "c"), (3, "v", "value", None, "2.0"), (3, "n", "value", "7", "x"), (3, "list", "value", None, "[]"), (3, "lost", "field_lost", "z", None), (3, "extra", "field_added", None, "1.5"),
        (None, "v", "value", "1.0", "1.5"), (None, "n", "value", "8", None), (None, "lost", "field_lost", "q", None), (None, "extra", "field_added", None, "0.0"),
        (5, None, "row_lost", None, None), (6, None, "row_added", None, None),
    }
    assert schema_changes(a, b) == [("n", "retyped", "int", "string"), ("lost", "lost", "string", ""), ("extra", "added", "", "double")]


def test_equal_and_empty_snapshots(spark):
    df = spark.createDataFrame([(1, float("nan"), {"a": 1})], "k int, v double, m map<string,int>")
    assert field_changes(df, df, ["k"]).collect() == [] and field_changes(df.limit(0), df.limit(0), ["k"]).collect() == []
    assert [r.change for r in field_changes(df.limit(0), df, ["k"]).collect()] == ["row_added"]
