"""Relational helpers over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def any_needle(text: Column, needles: list[str]) -> Column:
    """Whether the text contains any of the needles as a substring."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in needles))


def near(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-6) -> Column:
    """Equal within either tolerance; two nulls are equal, a null and a number are not."""
    gap = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(gap)


def flag_existing(df: DataFrame, other: DataFrame, keys: list[str], into: str) -> DataFrame:
    """Adds whether the keys exist in the other frame."""
    return df.join(other.select(*keys).distinct().withColumn(into, F.lit(True)), keys, "left").fillna({into: False})


def compare(old: DataFrame, new: DataFrame, keys: list[str], into: str) -> DataFrame:
    """Full join of two frames on keys, with where each row was found."""
    a = old.withColumn("\1old", F.lit(True))
    b = new.withColumn("\1new", F.lit(True))
    found = F.when(F.col("\1new").isNull(), "left_only").when(F.col("\1old").isNull(), "right_only").otherwise("both")
    return a.join(b, keys, "full").withColumn(into, found).drop("\1old", "\1new")


def pivot_fill(df: DataFrame, keys: list[str], by: str, values: list[str], value: Column) -> DataFrame:
    """One column for each given value, 0 where a group has none; given values keep the schema stable."""
    return df.groupBy(*keys).pivot(by, values).agg(value).fillna(0, values)


def beside(first: DataFrame, *ones: DataFrame) -> DataFrame:
    """Columns of one-row frames beside every row of the first; each is broadcast, being an aggregate's single row."""
    return reduce(lambda a, b: a.join(F.broadcast(b), how="cross"), ones, first)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt to all tasks by a distinct key: a small file is read by one task or a few, however long each row's work is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def route(df: DataFrame, rules: Mapping[str, Column], otherwise: str, into: str = "decision") -> DataFrame:
    """One decision a row: the first rule that holds."""
    out = F.lit(otherwise)
    for name, rule in reversed(list(rules.items())):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return df.withColumn(into, out)


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Adds the columns that are missing, with their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def first_filled(*columns: Column, default: str = "") -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns), F.lit(default))


def join_flags(*flags: Column) -> Column:
    """Flags that are set, sorted and distinct, in one list-string."""
    kept = F.filter(F.array(*flags), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " | ")


def view(df: DataFrame, column: str, falling: bool, ties: list[str], rows: int) -> DataFrame:
    """The first rows of a table by a column, nulls last, text without regard to case, and their places; a bounded top-k."""
    key = F.lower(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    order = [F.desc_nulls_last("\1k") if falling else F.asc_nulls_last("\1k"), *map(F.asc, ties)]
    top = df.withColumn("\1k", key).orderBy(*order).limit(rows)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("\1k")


def numbered(df: DataFrame, into: str) -> DataFrame:
    """Adds 1, 2, 3, ... in input order. The table must give the same parts each time, as scans do; only the parts' sizes meet in one place."""
    own = df.withColumns({"\1p": F.spark_partition_id(), "\1i": F.monotonically_increasing_id()})
    size = own.groupBy("\1p").agg(F.count("*").alias("\1n"), F.min("\1i").alias("\1first"))
    before = F.coalesce(F.sum("\1n").over(Window.orderBy("\1p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = size.select("\1p", (before - F.col("\1first")).alias("\1shift"))
    return own.join(F.broadcast(start), "\1p").withColumn(into, F.col("\1i") + F.col("\1shift") + 1).select(*df.columns, into)


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str], how: str = "left") -> DataFrame:
    """A join in which columns of one name on both sides get the suffixes."""
    both = {c for c in left.columns if c in right.columns and c not in keys}
    return left.withColumnsRenamed({c: c + suffixes[0] for c in both}).join(right.withColumnsRenamed({c: c + suffixes[1] for c in both}), keys, how)


def on_spine(keys: list[str], *frames: DataFrame) -> DataFrame:
    """All frames left-joined onto the distinct union of their keys."""
    spine = reduce(DataFrame.unionByName, (f.select(*keys) for f in frames)).distinct()
    return reduce(lambda a, b: a.join(b, keys, "left"), frames, spine)


def canonical_link(c: Column) -> Column:
    """A link without query and fragment, by https."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[?#].*$", ""), "^http:", "https:")


def same_link(a: Column, b: Column) -> Column:
    return canonical_link(F.coalesce(a, F.lit(""))) == canonical_link(F.coalesce(b, F.lit("")))


def flag(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("1", "true", "yes")


def same_flag(a: Column, b: Column) -> Column:
    return flag(a) == flag(b)


def same_text(a: Column, b: Column) -> Column:
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return plain(a) == plain(b)


def number(c: Column) -> Column:
    """A number out of text; null where it is none."""
    return F.trim(c).try_cast("double")
