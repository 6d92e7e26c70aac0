"""Structural flags on hand-worked engagements, and blockers by their keys."""

import pytest

from lodestar.plans import catalog
from lodestar.plans.structure import verified

ROWS = "n int, commander_id long, name string, url string, page_id long, page_type string, side string, conflict string, year int, strict boolean, title string"
BLOCKERS = "kind string, page_id long, url string, name_key string, issues string"
B, W, C, O = "battle_article", "war_conflict_article", "campaign_article", "operation_article"  # noqa: E741
CASES = [
    # commander 1: battles of 1800 and 1810 in "k"
    ((1, "Ada Longname", "/ada", 1, B, "side_a", "k", 1800, True, "Battle of X"), "verified_core", []),
    ((1, "Ada Longname", "/ada", 2, B, "multiple_sides", "k", 1810, True, "Battle of Y"), "verified_core", ["multi_side_ambiguity"]),
    ((1, "Ada Longname", "/ada", 3, O, "side_a", "k", 1805, True, "Crossing"), "verified_broad", ["duplicate_hierarchy_credit"]),
    ((1, "Ada Longname", "/ada", 4, O, "side_a", "other", 1805, True, "Crossing"), "verified_core", []),
    ((1, "Ada Longname", "/ada", 5, W, "side_a", "other", 1815, True, "Conflict"), "verified_core", []),
    ((1, "Ada Longname", "/ada", 6, W, "side_a", "other", 1816, True, "Conflict"), "structurally_suspect", ["commander_outside_page_chronology"]),
    ((1, "Ada Longname", "/ada", 7, W, "side_a", "other", None, True, "Conflict"), "verified_core", []),
    ((1, "Ada Longname", "/ada", 8, W, "side_a", "other", 1805, True, "The K wars"), "verified_broad", ["commander_attached_to_too_broad_page"]),
    ((1, "Ada Longname", "/ada", 9, W, "side_a", "k", 1805, True, "The K wars"), "structurally_suspect", ["commander_attached_to_too_broad_page", "duplicate_hierarchy_credit", "umbrella_war_inflation"]),
    ((1, "Ada Longname", "/ada", 10, W, "side_a", "other", 1790, True, "Revolts"), "structurally_suspect", ["commander_attached_to_too_broad_page", "commander_outside_page_chronology", "umbrella_war_inflation"]),
    ((1, "Ada Longname", "/ada", 11, C, "side_a", "other", 1803, True, "March"), "verified_broad", ["campaign_page_not_core"]),
    ((1, "Ada Longname", "/ada", 12, C, "side_a", "other", 1800, True, "March"), "verified_broad", ["campaign_page_not_core", "duplicate_hierarchy_credit", "same_year_campaign_overlap"]),
    ((1, "Ada Longname", "/ada", 13, C, "side_a", "other", 1803, True, "Expedition"), "verified_broad", ["campaign_page_not_core", "commander_attached_to_too_broad_page"]),
    ((1, "Ada Longname", "/ada", 14, C, "side_a", "k", 1803, True, "Expedition"), "structurally_suspect", ["campaign_page_not_core", "commander_attached_to_too_broad_page", "duplicate_hierarchy_credit", "same_year_campaign_overlap", "umbrella_war_inflation"]),
    ((1, "Ada Longname", "/ada", 15, C, "side_a", "other", 1803, True, "Longname in Asia"), "structurally_suspect", ["campaign_page_not_core", "commander_named_campaign_duplicate"]),
    ((1, "Ada Longname", "/ada", 16, C, "side_a", "k", 1803, True, "March of LONGNAME"), "structurally_suspect", ["campaign_page_not_core", "commander_named_campaign_duplicate", "duplicate_hierarchy_credit", "same_year_campaign_overlap", "umbrella_war_inflation"]),
    # a word of under five letters, and a fourth word, name no one
    ((2, "Eve of Roe and Sun Tremendous", "", 17, C, "side_a", "k", 1803, True, "Sun march of Tremendous"), "verified_broad", ["campaign_page_not_core"]),
    # a battle that is not strict anchors nothing
    ((3, "Cid", "", 18, B, "side_a", "k", 1700, False, "Battle"), "verified_core", []),
    ((3, "Cid", "", 19, O, "side_a", "k", 1700, True, "Crossing"), "verified_core", []),
    # blockers: by page, by page and link, by page and name, by link, by name; blank issues and blank links block nothing
    ((4, "Dora", "/dora", 20, B, "side_a", "q", 1, True, "Battle"), "quarantined", ["battle_row_blocker"]),
    ((4, "Dora", "/dora", 21, B, "side_a", "q", 1, True, "Battle"), "quarantined", ["commander_row_blocker"]),
    ((5, "Emil", "", 22, B, "side_a", "q", 1, True, "Battle"), "quarantined", ["commander_row_blocker"]),
    ((5, "Emil", "", 23, B, "side_a", "q", 1, True, "Battle"), "verified_core", []),
    ((6, "Finn", "/finn", 24, B, "side_a", "q", 1, True, "Battle"), "quarantined", ["commander_master_blocker"]),
    ((7, "Gus", "", 25, B, "side_a", "q", 1, True, "Battle"), "quarantined", ["commander_master_blocker"]),
    ((8, "Hal", "", 26, B, "side_a", "q", 1, True, "Battle"), "verified_core", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(n, *own) for n, (own, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "lower(name) as name_key")
    blockers = [("page", 20, "", "", "a"), ("page", 20, "", "", "b"), ("page_url", 21, "/dora", "", "a"), ("page_name", 22, "", "emil", "a"), ("page_name", 23, "", "emil", " "), ("url", None, "/finn", "", "a"), ("url", None, "", "", "a"), ("name", None, "", "gus", "a"), ("name", None, "", "hal", ""), ("page", None, "", "", "a")]
    return {r.n: (r.status, r.flags) for r in verified(df, spark.createDataFrame(blockers, BLOCKERS)).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(found, n):
    assert found[n] == (CASES[n][1], CASES[n][2]), CASES[n][0]
    assert len(found) == len(CASES)


def test_the_query_meets_all_eleven_flags(spark):
    rows = catalog.queries()["verify_blockers"](spark, "/root/testdata/sf0.01").selectExpr("explode(split(flags, '[|]')) as f").distinct().collect()
    assert len({r.f for r in rows} - {""}) == 11


def test_rows_move_once_by_page(spark, sf_dir):
    """Blockers of a page are met without a shuffle of the rows for each kind of key."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["verify_blockers"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin [page_id" not in plan and plan.count("Exchange hashpartitioning(page_id") <= 1
