"""Window idioms: percentile ranks with averaged ties, unique ranks, first and last rows of a key, flags of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.tables import shared_table

#: Distinct values up to which ranks are sent to the rows instead of the rows to the ranks.
SENT = 200_000


def percentile_rank(value: Column, partition: list[str]) -> Column:
    """100 x the average rank of tied values / rows; a cohort of one row scores 100. Nulls count as 0. A window over each whole cohort: for cohorts of a bounded size."""
    v = F.coalesce(value, F.lit(0.0))
    low = F.rank().over(Window.partitionBy(*partition).orderBy(v))
    tied = F.count("*").over(Window.partitionBy(*partition, v))
    rows = F.count("*").over(Window.partitionBy(*partition))
    return F.lit(100.0) * (low + (tied - 1) / F.lit(2.0)) / rows


def _ranges(df: DataFrame, keys: list[str], order: list[Column], weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of one global order by (keys, order), as a written table with the range's number, and for each
    cohort and range the weight of the cohort's rows in the ranges before.

    The splitters are sampled from the rows themselves, so ranges hold about equally many rows whatever the values are and
    however the rows spread over cohorts; a cohort has at most as many ranges as there are partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = shared_table(df.repartitionByRange(parts, *keys, *order).withColumn("\1range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "\1range").agg((F.count("*") if weight is None else F.sum(weight)).alias("\1n"))
    own = Window.partitionBy(*keys)
    before = F.sum("\1n").over(own.orderBy("\1range").rowsBetween(Window.unboundedPreceding, -1))
    return ranged, sums.select(*keys, "\1range", F.coalesce(before, F.lit(0)).alias("\1before"), F.sum("\1n").over(own).alias("\1all"))


def value_ranks(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, int]:
    """(keys, value, rows, before, all): of each distinct value of a cohort its rows, those with lesser values and all of the cohort; and how many values there are.

    Equal rows are counted, never sorted; only distinct values are put in ranges and summed up there.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("rows"))
    ranged, sums = _ranges(counts, keys, [F.col(value)], F.col("rows"))
    lesser = F.sum("rows").over(Window.partitionBy(*keys, "\1range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    own = ranged.withColumn("\1lesser", F.coalesce(lesser, F.lit(0))).join(sums, [*keys, "\1range"])
    return own.select(*keys, value, "rows", (F.col("\1before") + F.col("\1lesser")).alias("before"), F.col("\1all").alias("all")), ranged.count()


def percentile_ranks(df: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """percentile_rank() of a column without nulls, from counts of its distinct values.

    Few distinct values are counted and sent to all tasks; many meet the rows in a join, in which a frequent one is a skewed
    partition that the engine splits.
    """
    values, n = value_ranks(df, keys, value)
    ranks = values.select(*keys, value, (F.lit(100.0) * (F.col("before") + (F.col("rows") + 1) / F.lit(2.0)) / F.col("all")).alias(into))
    return df.join(F.broadcast(ranks) if n <= SENT else ranks, [*keys, value]).select(*df.columns, into)


def ordered_ranks(df: DataFrame, keys: list[str], order: list[Column], into: str) -> DataFrame:
    """1, 2, 3, ... inside each cohort by a total order: the rows of earlier ranges and the place in the own range."""
    ranged, sums = _ranges(df, keys, order)
    place = F.row_number().over(Window.partitionBy(*keys, "\1range").orderBy(*order))
    return ranged.withColumn("\1place", place).join(sums, [*keys, "\1range"]).withColumn(into, (F.col("\1before") + F.col("\1place")).cast("int")).select(*df.columns, into)


def unique_rank(partition: list[str], order: list[Column]) -> Column:
    """1, 2, 3, ... by an order that must be total."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank; pruned per task before the shuffle (WindowGroupLimit)."""
    return df.withColumn("rn", unique_rank(keys, order)).filter(F.col("rn") <= k)


def any_over(flag: Column, *keys: str) -> Column:
    """Whether any row of the group has the flag."""
    return F.coalesce(F.max(flag.cast("int")).over(Window.partitionBy(*keys)), F.lit(0)) == 1


def share_over(value: Column, *keys: str) -> Column:
    """The row's share of its group's total, 0 where the total is 0."""
    return F.coalesce(F.try_divide(value, F.sum(value).over(Window.partitionBy(*keys))), F.lit(0.0))
