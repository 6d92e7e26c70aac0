"""Text functions, graph reach, cap factor and page parsing on small cases."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.functions.dates import date_reasons
from lodestar.functions.scores import cap_factor
from lodestar.operators.graph import reach
from lodestar.operators.relational import first_filled, near, numbered, view
from lodestar.operators.windows import ordered_ranks, percentile_rank, percentile_ranks, unique_rank
from lodestar.sources import files


def test_url_round_trip(spark):
    titles = ["Battle of X (1204)", "é+?", "a,b:c'!~*-.", "100% sure", "tab\there", "ü–—−x", "#1/2&3=4;5"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(text.fold_title(F.col("t")).alias("t"))
    rows = df.select("t", text.title_link(F.col("t")).alias("u"), text.link_title(text.title_link(F.col("t"))).alias("back")).collect()
    assert all(r.back == r.t for r in rows) and rows[0].u == "https://en.wikipedia.org/wiki/Battle_of_X_(1204)"
    odd = spark.createDataFrame([("https://en.wikipedia.org/wiki/A_b?x=1#c",), ("https://other.org/A",), (None,)], "u string")
    assert [r[0] for r in odd.select(text.link_title(F.col("u"))).collect()] == ["A b", "", None]


@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_ratio_is_symmetric(a, b):
    assert text.indel_ratio(a, b) == text.indel_ratio(b, a)
    assert 0 <= text.indel_ratio(a, b) <= 100


def test_ratio_ignores_word_order():
    assert text.indel_ratio("north army", "army north") == 100
    assert text.indel_ratio("abc", "abd") < 100


def test_wikitext():
    block = text.balanced("x {{Infobox|a={{b|c}}|d=[[e|f]]}} y", 2)
    assert block == "{{Infobox|a={{b|c}}|d=[[e|f]]}}"
    assert text.template_params(block) == {"a": "{{b|c}}", "d": "[[e|f]]"}
    assert text.balanced("{{never", 0) == ""
    assert text.render("{{ubl|[[A|b]]|c}} {{plainlist|\n* x\n* y}} {{flag|z|w}} {{other|1|2}}") == "[[A|b]]<br>c x<br>y w 1"
    assert text.strip_markup("'''A''' {{small|b}}<ref>no</ref> [[C|d]] <!-- x -->e") == "A b d e"


def test_page():
    got = text.parse_page("<html><script>no</script><p> </p><p>Lead <a href='/wiki/X'>the x</a>.</p></html>")
    assert got == {"text": "Lead the x .", "links": [{"href": "/wiki/X", "label": "the x"}], "lead": "Lead the x."}
    assert text.parse_page(None)["links"] == []


def test_native_text(spark):
    df = spark.createDataFrame([("[[Rome|the city]] and [[Gaul]] [[Gaul]]", "10,000–20,000", "")], "a string, n string, e string")
    r = df.select(text.number_range(F.col("n")).alias("r"), first_filled(F.col("e"), F.lit("x")).alias("f"), date_reasons(F.col("e")).alias("d")).first()
    assert [tuple(x.values()) for x in text.links_of("[[Rome|the city]] and [[Gaul]] [[Gaul]]")] == [("Rome", "the city"), ("Gaul", "Gaul")]
    assert (r.r.lo, r.r.hi, r.r.mid, r.f, r.d) == (10000, 20000, 15000, "x", ["missing_date"])


def test_scores(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (1.0,)], "x double")
    got = [r[0] for r in df.select(cap_factor(F.col("x"))).collect()]
    assert got[0] == 1 and math.isclose(got[1], 0.5 + 0.5 * 0.4 / 0.6) and got[2] == 0
    pair = spark.createDataFrame([(1.0, 1.0 + 1e-12), (None, None), (None, 1.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in pair.select(near(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]
    one = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    rows = one.select("g", "v", percentile_rank(F.col("v"), ["g"]).alias("p")).collect()
    assert sorted((r.g, r.v, round(r.p, 6)) for r in rows) == [("a", 5.0, 100.0), ("b", 1.0, 50.0), ("b", 1.0, 50.0), ("b", 3.0, 100.0)]


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "a long, b long")
    got = reach(edges, spark.createDataFrame([(1,)], "node long"), 3)
    assert sorted((r.node, r.depth) for r in got.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_gzip_fallback(spark, tmp_path):
    path = f"file://{tmp_path}/x.csv"
    spark.createDataFrame([("1", "two, three")], "a string, b string").coalesce(1).write.option("header", True).option("compression", "gzip").csv(f"{path}.gz")
    assert [tuple(r) for r in files.read_optional_csv(spark, path, ["a", "b"]).collect()] == [("1", "two, three")]


def test_content_address(spark):
    df = spark.range(1)
    a = df.select(files.cached_by(F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")))).first()[0]
    b = df.select(files.cached_by(F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1")))).first()[0]
    assert a == b and len(a) == 40


@pytest.mark.parametrize("missing", ["corpus_pipeline", "lodestar.llm", "zstandard"])
def test_entry_without_optional_parts(monkeypatch, missing):
    import importlib
    import sys

    import __spark_entry__ as e

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("lodestar.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    fresh = importlib.util.module_from_spec(importlib.util.spec_from_file_location("fresh_entry", e.__file__))
    fresh.__spec__.loader.exec_module(fresh)
    assert not any(k.startswith("op") for k in fresh.queries())


def test_ranks_by_buckets_equal_windows(spark):
    import random

    rng = random.Random(3)
    rows = [(k % 3, i, float(rng.choice([0, 0, 1, 2.5, 7, rng.random() * 9]))) for i, k in enumerate(rng.choices(range(9), k=400))] + [(9, 1000, 4.0)]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    plain = {r.i: (round(r.p, 9), r.k) for r in df.select("i", percentile_rank(F.col("v"), ["g"]).alias("p"), unique_rank(["g"], [F.desc("v"), F.asc("i")]).alias("k")).collect()}
    pct = percentile_ranks(df, ["g"], "v", "p")
    both = ordered_ranks(pct, ["g"], [F.desc("v"), F.asc("i")], "k")
    assert {r.i: (round(r.p, 9), r.k) for r in both.collect()} == plain


def test_numbered_and_view(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") % 10).alias("v"))
    assert [r.n for r in numbered(df, "n").orderBy("id").collect()] == list(range(1, 1001))
    top = view(spark.createDataFrame([("b", 1), (None, 2), ("A", 3)], "s string, i int"), "s", False, ["i"], 2).collect()
    assert [(r.s, r.place) for r in top] == [("A", 1), ("b", 2)]


def test_common_length():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    import random

    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd é", k=rng.randrange(90))) for _ in range(2))
        assert text.common_length(a, b) == plain(a, b)


def test_exact_override_fails_on_no_row(spark, sf_dir):
    from lodestar.plans.binding import engagements
    from lodestar.plans.curation import exact_overrides

    fact = engagements(spark, sf_dir)
    row = fact.first()
    kind = "commander_id long, page_id long, new_outcome string"
    good = spark.createDataFrame([(row.commander_id, row.page_id, "defeat")], kind)
    assert [(r.old_outcome, r.new_outcome) for r in exact_overrides(fact, good).collect()] == [(row.outcome, "defeat")]
    for bad, rows in ((spark.createDataFrame([(row.commander_id, -1, "defeat")], kind), fact), (good, fact.unionByName(fact))):
        with pytest.raises(Exception, match="override without exactly one row"):
            exact_overrides(rows, bad).collect()


def test_cached_fetch_tries_again(spark):
    seen = spark.createDataFrame([({"id": "1"},), ({"id": "2"},), ({"id": "1"},)], "params map<string,string>")

    def fetch(p):
        import os
        import tempfile

        mark = os.path.join(tempfile.gettempdir(), f"lodestar-try-{os.getpid()}-{p['id']}")
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("once more")
        os.remove(mark)
        return "body " + p["id"]

    got = files.cached_fetch(seen, spark.createDataFrame([], "key string, body string"), fetch).collect()
    assert sorted((r.body, r.tries) for r in got) == [("body 1", 2), ("body 2", 2)]
