"""Hand-worked cases of the winning side, one or more for every branch, with the answers worked out from the rules' description."""

import pytest

from lodestar.functions.winners import winners
from lodestar.functions import curation

COLUMNS = "n int, title string, page_type string, result string, kind string, bel_a string, com_a string, bel_b string, com_b string, bel_c string, com_c string"
W, BATTLE = "war_conflict_article", "battle_article"
#: title, page type, result, kind, side a, its commanders, side b, its commanders, side c, its commanders; winner, method.
CASES = [
    # no result, no type, neutral ends
    (("", BATTLE, "", "victory", "France", "", "Spain", "", "", ""), (None, "unresolved")),
    (("", BATTLE, None, "victory", "France", "", "Spain", "", "", ""), (None, "unresolved")),
    (("", BATTLE, "French victory", "", "France", "", "Spain", "", "", ""), (None, "unresolved")),
    (("", BATTLE, "French victory", "unknown", "France", "", "Spain", "", "", ""), (None, "unresolved")),
    (("", BATTLE, "Indecisive, French withdrawal", "indecisive", "France", "", "Spain", "", "", ""), (None, "unresolved")),
    (("", BATTLE, "Disputed", "disputed", "France", "", "Spain", "", "", ""), (None, "unresolved")),
    # a named target: the other side of two
    (("", BATTLE, "Anti-French victory", "victory", "France", "", "Spain", "", "", ""), ("side_b", "negated_target_match")),
    (("", BATTLE, "Victory against Spain", "victory", "France", "", "Spain", "", "", ""), ("side_a", "negated_target_match")),
    # a target named by a commander's cell
    (("", BATTLE, "Victory against Ney", "victory", "France", "Michel Ney", "Prussia", "Blucher", "", ""), ("side_b", "negated_target_match")),
    # the target stands in both cells: the side that names it first, twenty characters ahead
    (("", BATTLE, "Anti-Spanish victory", "victory", "Spanish", "", "Royal army of the north and Spanish exiles", "", "", ""), ("side_b", "negated_target_match")),
    # first by less than twenty, and as often named
    (("", BATTLE, "Anti-Spanish victory", "victory", "Spanish", "", "Free Spanish", "", "", ""), ("side_b", "negated_target_match")),
    # three sides: the one coalition among the rest
    (("", BATTLE, "Anti-Spartan victory", "victory", "Sparta", "", "Athens\nThebes", "", "Corinth", ""), ("side_b", "negated_target_match")),
    # three sides without a single coalition: the result's own words decide later on
    (("", BATTLE, "Theban victory against Sparta", "victory", "Sparta", "", "Theban League", "", "Corinth", ""), ("side_b", "negated_target_match")),
    (("", BATTLE, "Victory against Sparta", "victory", "Sparta", "", "Thebes", "", "Corinth", ""), (None, "unresolved")),
    # marks of the allied powers on one side only
    (("", BATTLE, "Allied victory", "victory", "Nazi Germany", "", "United Kingdom\nCanada", "", "", ""), ("side_b", "allied_marker_match")),
    (("", BATTLE, "Coalition victory", "victory", "Soviet Union", "", "Finland", "", "", ""), ("side_a", "allied_marker_match")),
    # marks on both: the side that calls itself allied
    (("", BATTLE, "Allied victory", "victory", "Allied forces of Canada", "", "Soviet Union", "", "", ""), ("side_a", "unique_belligerent_match")),
    # only one side's names occur
    (("", BATTLE, "Decisive Roman victory", "decisive_victory", "Rome", "", "Carthage", "", "", ""), ("side_a", "unique_belligerent_match")),
    (("", BATTLE, "Victory of Hannibal", "victory", "Rome", "", "Carthage", "Hannibal", "", ""), ("side_b", "unique_belligerent_match")),
    (("", BATTLE, "Third party victory, Swedish", "victory", "Denmark", "", "Norway", "", "Sweden", ""), ("side_c", "unique_belligerent_match")),
    # a name inside a longer word is none; names of both sides decide nothing
    (("", BATTLE, "Romanian victory", "victory", "Rome", "", "Carthage", "", "", ""), (None, "unresolved")),
    (("", BATTLE, "Roman and Carthage victory", "victory", "Rome", "", "Carthage", "", "", ""), (None, "unresolved")),
    # the actor of the title wins or loses
    (("French invasion of Spain", W, "Victory", "victory", "French Empire", "", "Spanish rebels", "", "", ""), ("side_a", "generic_actor_title_match")),
    (("French invasion of Spain", W, "Defeat", "victory", "French Empire", "", "Spanish rebels", "", "", ""), ("side_b", "generic_actor_title_match")),
    (("French invasion of Russia", W, "Victory", "victory", "France", "", "Cossacks", "", "", ""), ("side_a", "generic_actor_title_match")),
    (("1848 Danish offensive in Jutland", W, "Victory", "victory", "Prussia", "", "Denmark", "", "", ""), ("side_b", "generic_actor_title_match")),
    # a year before a form that refuses one, a page type without actors, an actor on no side, a defeat among three
    (("1848 Danish expedition to Jutland", W, "Victory", "victory", "Prussia", "", "Denmark", "", "", ""), (None, "unresolved")),
    (("French invasion of Spain", "list_article", "Victory", "victory", "French Empire", "", "Spanish rebels", "", "", ""), (None, "unresolved")),
    (("Swedish landing at Oslo", W, "Victory", "victory", "France", "", "Spain", "", "", ""), (None, "unresolved")),
    (("French occupation of Rome", W, "Defeat", "victory", "France", "", "Spain", "", "Austria", ""), (None, "unresolved")),
    (("Battle of Spain", W, "Victory", "victory", "France", "", "Spain", "", "", ""), (None, "unresolved")),
    # signs of a coalition: the word, more than one member, the stronger one
    (("", BATTLE, "Victory of the alliance", "victory", "League alliance", "", "Ayyubids\nZengids", "", "", ""), ("side_a", "unique_belligerent_match")),
    (("", BATTLE, "Combined victory", "victory", "Holy coalition", "", "Ayyubids\nZengids", "", "", ""), ("side_a", "coalition_label_match")),
    (("", BATTLE, "Combined victory", "victory", "Venice", "", "Ayyubids\nZengids", "", "", ""), ("side_b", "coalition_side_heuristic")),
    (("", BATTLE, "Combined victory", "victory", "Venice*", "", "Ayyubids", "", "", ""), ("side_a", "coalition_side_heuristic")),
    (("", BATTLE, "Combined victory", "victory", "French and Spanish crown", "", "Ayyubids", "", "", ""), ("side_a", "coalition_side_heuristic")),
    (("", BATTLE, "Combined victory", "victory", "Genoa\nPisa", "", "Ayyubids\nZengids\nSeljuks\nArtuqids", "", "", ""), ("side_b", "coalition_strength_heuristic")),
    (("", BATTLE, "Combined victory", "victory", "Genoa\nPisa", "", "Ayyubids\nZengids\nSeljuks", "", "", ""), (None, "unresolved")),
    (("", BATTLE, "Combined victory", "victory", "Venice", "", "Ayyubids", "", "", ""), (None, "unresolved")),
    # cells: repeated names, stop words, sizes and flags are no members
    (("", BATTLE, "Combined victory", "victory", "Genoa | genoa; Army", "", "Ayyubids (900 men) / Flag.svg Zengids", "", "", ""), ("side_b", "coalition_side_heuristic")),
    # phrases and hyphens
    (("", BATTLE, "Dano-Norwegian victory", "victory", "Denmark-Norway", "", "Sweden", "", "", ""), ("side_a", "unique_belligerent_match")),
    (("", BATTLE, "Turkish victory[3]", "victory", "Ottoman Empire", "", "Venice", "", "", ""), ("side_a", "unique_belligerent_match")),
    # no sides at all
    (("", BATTLE, "Combined victory", "victory", None, None, None, None, None, None), (None, "unresolved")),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(n, *cells) for n, (cells, _) in enumerate(CASES)], COLUMNS)
    return {r.n: (r.win_side, r.method) for r in winners(df).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(found, n):
    assert found[n] == CASES[n][1], CASES[n][0]


def test_every_method_is_met(found):
    assert {m for _, m in found.values()} == {"unresolved", "negated_target_match", "allied_marker_match", "unique_belligerent_match", "generic_actor_title_match", "coalition_label_match", "coalition_side_heuristic", "coalition_strength_heuristic"}


def test_lists_are_whole():
    sizes = {"META": 19, "PERSON_CATEGORY": 35, "NON_PERSON_CATEGORY": 40, "NON_PERSON_TITLE": 34, "FALSE_TITLES": 6}
    assert {k: len(set(getattr(curation, k))) for k in sizes} == sizes
    assert {"pharaohs", "chieftains", "viziers", "censors", "magistri", "patricians"} <= set(curation.PERSON_CATEGORY)
    assert {"sultanate", "despotate", "sanjak", "media group", "reliefweb", "politico", "naval flag", "observer force"} <= set(curation.NON_PERSON_TITLE)
