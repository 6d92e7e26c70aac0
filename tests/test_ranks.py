"""Ranks by sampled ranges: exact on any distribution, and no task with much more than its share."""

from statistics import median

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import windows


@pytest.fixture(scope="module")
def skewed(spark):
    """Two cohorts, one with nearly all rows; columns of four values, of one outlier, of one value for a third of the rows."""
    i = F.col("id")
    return spark.range(40_000).select(
        F.when(i % 100 == 0, "b").otherwise("a").alias("kind"), i, (i % 4).cast("double").alias("few"), F.when(i == 17, 1e9).otherwise(F.hash(i) % 5000 / 7).alias("far"), F.when(i % 3 == 0, 5.0).otherwise(F.hash(i).cast("double")).alias("hot")
    )


@pytest.mark.parametrize("value", ["few", "far", "hot"])
def test_ranks_equal_windows(skewed, value):
    plain = skewed.withColumns({"p": windows.percentile_rank(F.col(value), ["kind"]), "o": F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(value), "id"))})
    made = windows.ordered_ranks(windows.percentile_ranks(skewed, ["kind"], value, "p2"), ["kind"], [F.desc(value), F.asc("id")], "o2")
    both = plain.join(made.select("id", "p2", "o2"), "id")
    assert both.count() == 40_000 and both.filter("p <> p2 or o <> o2").count() == 0


@pytest.mark.parametrize("value", ["few", "far", "hot"])
def test_no_range_holds_much_more_than_its_share(skewed, value):
    for rows, order in ((skewed, [F.desc(value), F.asc("id")]), (skewed.groupBy("kind", value).count(), [F.asc(value)])):
        ranged, sums = windows._ranges(rows, ["kind"], order)
        sizes = [r["count"] for r in ranged.groupBy("\1range").count().collect()]
        assert max(sizes) <= max(4, 2 * median(sizes)) and sums.count() <= len(sizes) + 2


def test_ranks_when_many_values_meet_in_a_join(skewed, monkeypatch):
    monkeypatch.setattr(windows, "SENT", 10)
    made = windows.percentile_ranks(skewed, ["kind"], "hot", "p2")
    plain = skewed.withColumn("p", windows.percentile_rank(F.col("hot"), ["kind"]))
    assert plain.join(made.select("id", "p2"), "id").filter("p = p2").count() == 40_000


def test_ranks_of_an_empty_table(skewed):
    none = skewed.limit(0)
    assert windows.ordered_ranks(windows.percentile_ranks(none, ["kind"], "few", "p"), [], [F.asc("id")], "o").collect() == []
