"""Links by container and by segment on small pages with the answers written out."""

import pytest

from lodestar.functions.links import candidates, entries, links
from lodestar.plans import catalog

PAGES = [
    (1, '<p><a href="/Out">Out</a></p><ul><li><a href="/A_b#part">A b</a> and <a href="/C" title="See  C">c</a><ul><li><a href="/D">D</a></li></ul></li><li><a href="/a_B">again</a></li></ul>'),
    (2, '<table><tr><td><a href="/E">E <b>bold</b></a></td></tr><tr><td><a href="http://x.org/F">F</a><a href="/File:G.png">G</a><a class="x" href="/H">H</a></td></tr></table><a href="/I">I</a>'),
    (3, '</li><li><a href="/J">J</a></li></tr><LI><A HREF="/K">K</A>'),
    (4, ""),
    (5, None),
]


def test_links_by_container(spark):
    found = links(spark.createDataFrame(PAGES, "page_id int, html string"), "page_id", "html")
    got = {(r.page_id, r.title): (r.container, r.href, r.text) for r in found.collect()}
    assert got == {
        (1, "Out"): (None, "/Out", "Out"), (1, "A b"): (1, "/A_b", "A b"), (1, "See C"): (1, "/C", "c"), (1, "D"): (1, "/D", "D"), (1, "a B"): (2, "/a_B", "again"),
        (2, "E"): (1, "/E", "E bold"), (2, "H"): (2, "/H", "H"), (2, "I"): (None, "/I", "I"),
        (3, "J"): (1, "/J", "J"), (3, "K"): (2, "/K", "K"),
    }
    assert sorted(r.title for r in candidates(found, "page_id").collect()) == ["A b", "D", "E", "H", "J", "K", "See C"]


LINK = "struct<title:string,url:string,text:string>"
CELLS = [
    # more links than segments: one segment takes two links, a link that fits none is left out
    (1, ["Gen. John Smith and Ann Lee", "Bob"], [("John Smith", "/js", "Smith"), ("Ann Lee", "/al", "Ann Lee"), ("Carl", "/c", "Carl")]),
    # more segments than links: those without a link go, as the cell has links
    (2, ["Alpha", "Beta Gamma", "Delta"], [("Beta", "/b", "")]),
    # a link in two segments stands once; the same name by another url stays
    (3, ["King Otto", "Otto II"], [("Otto", "/o", "Otto"), ("Otto", "/o2", "Otto")]),
    # no links: cleaned segments, each once, no generic ones
    (4, ["Captain Hook†", "captain hook", "Unknown", "42 men", "XIV corps", "x", "Henry VIII (dead)"], []),
    # the text matches, the title does not
    (5, ["Old Blucher rode"], [("Gebhard Leberecht", "/gl", "Blucher")]),
    (6, [], [("A", "/a", "A")]),
    (7, [], []),
]


def test_links_by_segment(spark):
    df = spark.createDataFrame(CELLS, f"k int, segments array<string>, links array<{LINK}>")
    got = sorted((r.k, r.place, r.raw, r.name, r.url, r.method[:6]) for r in entries(df, "k").collect())
    assert got == [
        (1, 0, "Smith", "John Smith", "/js", "linked"), (1, 1, "Ann Lee", "Ann Lee", "/al", "linked"),
        (2, 0, "Beta Gamma", "Beta", "/b", "linked"),
        (3, 0, "Otto", "Otto", "/o", "linked"), (3, 1, "Otto", "Otto", "/o2", "linked"),
        (4, 0, "Hook", "Hook", "", "cleane"), (4, 1, "Henry VIII", "Henry VIII", "", "cleane"),
        (5, 0, "Blucher", "Gebhard Leberecht", "/gl", "linked"),
    ]


def test_words_end_at_letters_beyond_ascii(spark):
    """As in the comparison's language, whatever the version of Java: an i between accented letters stands alone."""
    cells = [(1, ["Lesèviètion of 1204", "Oiaeu of 1204"], []), (2, ["éc.a Otto", "ca.èla Otto"], [])]
    df = spark.createDataFrame(cells, f"k int, segments array<string>, links array<{LINK}>")
    assert sorted((r.k, r.name) for r in entries(df, "k").collect()) == [(1, "Lesèviètion of 1204"), (2, "ca.èla Otto"), (2, "éa Otto")]


@pytest.mark.parametrize("name", ["text_container_links", "text_cell_links"])
def test_queries_grow_with_the_pages(spark, sf_dir, name):
    rows = catalog.queries()[name](spark, sf_dir)
    assert rows.select("page_id").distinct().count() > 0.5 * spark.read.parquet(f"{sf_dir}/pages.parquet").count()
