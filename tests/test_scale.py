"""Work that has to grow no faster than the tables: chains of rules are made once, and small files are dealt to all tasks."""

import pytest
from pyspark.sql import functions as F

from lodestar.plans import catalog
from lodestar.plans.binding import engagements
from lodestar.plans.ranking import SETS, cells, metrics, prepared
from lodestar.plans.synthesis import rollups


@pytest.mark.parametrize("name", ["rule_master", "rule_identity_sources"])
def test_rules_are_made_once(spark, sf_dir, name):
    """The joins and groups read what the rules gave, not the part table from which they are made."""
    assert not any("part.parquet" in f for f in catalog.queries()[name](spark, sf_dir).inputFiles())


@pytest.mark.parametrize("name", ["text_wikitext", "text_html_infobox", "rule_candidates"])
def test_small_files_are_dealt_to_all_tasks(spark, sf_dir, name):
    rows = catalog.queries()[name](spark, sf_dir)
    assert rows.select(F.spark_partition_id().alias("task")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_first_lines_are_not_merged_as_structs(spark, sf_dir):
    assert "SortAggregate" not in engagements(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_the_fact_is_made_once(spark, sf_dir):
    """Metrics, roll-ups, eras and checks read one kept table instead of joining the lines again."""
    files = prepared(spark, sf_dir).inputFiles()
    assert files and not any("lineitem.parquet" in f for f in files)
    assert sorted(files) == sorted(prepared(spark, sf_dir).inputFiles())


def test_lines_move_once_by_page(spark, sf_dir):
    """What a page's lines are told by needs no further shuffle after the join with orders, even where no table is sent whole."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = engagements(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        opposing = catalog.queries()["rel_opposite_side"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    above = plan[: plan.index("ShuffledHashJoin")]
    assert "Exchange" not in above and above.count("Sort ") == 1 and plan.count("Exchange hashpartitioning(l_") == 2
    # Sides of a page are told from its rows as they lie, not from a join of the engagements with themselves.
    assert opposing.count("lineitem.parquet") == plan.count("lineitem.parquet") == 1 and opposing.count("Sort [") == plan.count("Sort [")


def test_sums_by_commander_read_the_cells(spark, sf_dir):
    """Metrics and roll-ups go over the summed cells, of which there are fewer than rows, and give what the weighted rows give."""
    both = [metrics(cells(spark, sf_dir), list(SETS)), rollups(spark, sf_dir)]
    assert all(f for f in (df.inputFiles() for df in both)) and not any("/fact-" in f for df in both for f in df.inputFiles())
    rows, got = prepared(spark, sf_dir), both[0]
    for name, (gate, scores, presence, credit) in SETS.items():
        w = F.col(f"weight_{gate}")
        o = w * F.col(f"credit_{credit}")
        sums = [F.count("*"), F.count_if("known"), F.countDistinct("conflict"), F.countDistinct("page_type"), F.round(F.sum(w * F.col(f"presence_{presence}")), 9), F.round(F.sum(o), 9), F.round(F.sum(o * F.col(f"score_{scores}")), 9), F.min("year"), F.max("year")]
        want = rows.filter(w > 0).groupBy("commander_id").agg(*sums).collect()
        own = got.filter(F.col("set") == name).select("commander_id", "engagements", "known", "conflicts", "page_types", *(F.round(c, 9) for c in ("presence", "outcome_weight", "outcome_value")), "first_year", "last_year").collect()
        assert len(want) > 0 and sorted(map(tuple, own)) == sorted(map(tuple, want))
