"""The steps of the winners: short cuts for plain names change nothing, and no step is worked out more than once for a page."""

import regex
from pyspark.sql import functions as F

from lodestar.functions import winners as w

NAMES = ["Nazi Germany", "Denmark-Norway", "France", "The", "a  b", "a - b", "Tsardom of Russia[2]", "[[1]2] Foo", "20px Spain", "Flag.svg Spain", "20PX", "Kingdom (1200 men)", "“Free” French", "Köln", "a—b", "a\xa0b", " x ", "-x-", "x_y", "[3]", "(all)", "New  - York", "A1 B2-C3", "Ελλάδα", "tab\there"]


def spaced(c):
    return regex.sub(r"[ \t\n\x0b\f\r]+", " ", regex.sub(r"\[[0-9]+\]", "", c).replace("\xa0", " ")).strip(" ")


def titled(c):
    return regex.sub("[–—−]", "-", spaced(c))


def plainly(piece):
    """The name and key of a piece by all patterns, one after the other."""
    name = regex.sub(r"(?i)\b[A-Za-z0-9_]+\.svg\b|\b[0-9]+px\b", "", titled(piece))
    name = spaced(regex.sub(r"\([^)]*\)|['\"“”‘’]", "", name))
    key = regex.sub(r"[^\p{L}\p{N}_\s-]", "", titled(name)).lower()
    return name, regex.sub("^-+|-+$", "", regex.sub(r"[-\s]+", "-", key))


def test_short_cuts_of_names_change_nothing(spark):
    df = spark.createDataFrame(list(enumerate(NAMES)), "n int, c string").withColumn("m", w._members(F.col("c"))).withColumn("p", F.transform("m", lambda x: w._plain(x["name"])))
    for r in df.collect():
        name, key = plainly(NAMES[r.n])
        want = [(name, key)] if name and key and key not in w.STOPWORDS else []
        assert [tuple(x) for x in r.m] == want
        assert r.p == [regex.sub(r"\s+", " ", regex.sub(r"[^a-z0-9\s-]", " ", x.lower())).strip(" ") for x, _ in want]


def test_known_names_of_a_side_are_counted_once(spark):
    rows = [("", 0), ("french franco france", 1), ("anglo forces", 2), ("austro-hungarian", 2), ("xfrench french1", 0), ("british. persian;", 3), ("french spain french", 2)]
    text = F.concat(F.lit(" "), F.regexp_replace("c", "[^a-z0-9]", " "), F.lit(" "))
    df = spark.createDataFrame([(c,) for c, _ in rows], "c string")
    found = F.regexp_extract_all(text, F.lit(f" ({'|'.join(w.BY_NAME)})(?= )"), F.lit(1))
    got = df.select("c", F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: w._known(w.BY_NAME, x))))).alias("n")).collect()
    assert {r.c: r.n for r in got} == dict(rows)


def test_a_target_and_a_title_are_cleaned_once(spark):
    plan = lambda c: spark.createDataFrame([("x",)], "c string").select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(w.targets(F.col("c"))).count("troops") == 1
    assert plan(w.actor(F.col("c"))).count("{3,4}\\s+") == 1
