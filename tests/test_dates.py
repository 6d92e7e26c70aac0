"""Date texts of forty forms and more, with both ends written out."""

import pytest

from lodestar.functions.dates import with_date_span

N = None
CASES = [
    ("2 December 1805", (1805, 12, 2), (1805, 12, 2)), ("December 2, 1805", (1805, 12, 2), (1805, 12, 2)), ("1805-12-02", (1805, 12, 2), (1805, 12, 2)), ("2/12/1805", (1805, 12, 2), (1805, 12, 2)),
    ("2nd of December, 1805", (1805, 12, 2), (1805, 12, 2)), ("2 Dec 1805", (1805, 12, 2), (1805, 12, 2)), ("Dec. 2 1805", (1805, 12, 2), (1805, 12, 2)), ("2 Sept 1805", (1805, 9, 2), (1805, 9, 2)),
    ("December 1805", (1805, 12, N), (1805, 12, N)), ("1805", (1805, N, N), (1805, N, N)), ("c. 1250", (1250, N, N), (1250, N, N)), ("early 476 AD", (476, N, N), (476, N, N)),
    ("3–5 May 1805", (1805, 5, 3), (1805, 5, 5)), ("3-5 May 1805", (1805, 5, 3), (1805, 5, 5)), ("3 – 5 May 1805", (1805, 5, 3), (1805, 5, 5)), ("May 3–5, 1805", (1805, 5, 3), (1805, 5, 5)),
    ("3 May – 5 June 1805", (1805, 5, 3), (1805, 6, 5)), ("May 3 – June 5, 1805", (1805, 5, 3), (1805, 6, 5)), ("3 May 1805 – 5 June 1806", (1805, 5, 3), (1806, 6, 5)), ("3 May to 5 June 1805", (1805, 5, 3), (1805, 6, 5)),
    ("3 May 1805 until 5 June 1806", (1805, 5, 3), (1806, 6, 5)), ("1805-05-03 to 1805-06-05", (1805, 5, 3), (1805, 6, 5)), ("3/5/1805 – 5/6/1805", (1805, 5, 3), (1805, 6, 5)),
    ("May – June 1805", (1805, 5, N), (1805, 6, N)), ("May 1805 – June 1806", (1805, 5, N), (1806, 6, N)), ("May–June 1805", (1805, 5, N), (1805, 6, N)), ("12 March 1805 – 14", (1805, 3, 12), (1805, 3, 14)),
    ("1805–1807", (1805, N, N), (1807, N, N)), ("1914–18", (1914, N, N), (1918, N, N)), ("1939–45", (1939, N, N), (1945, N, N)), ("1899–02", (1899, N, N), (1902, N, N)), ("1989–90", (1989, N, N), (1990, N, N)), ("1898–00", (1898, N, N), (1900, N, N)), ("1805 to 1807", (1805, N, N), (1807, N, N)), ("1805 – June 1806", (1805, N, N), (1806, 6, N)),
    ("490 BC", (-490, N, N), (-490, N, N)), ("490–479 BC", (-490, N, N), (-479, N, N)), ("44 BC", (-44, N, N), (-44, N, N)), ("31 BC", (-31, N, N), (-31, N, N)), ("15 March 44 BC", (-44, 3, 15), (-44, 3, 15)),
    ("44 BC – 14 AD", (-44, N, N), (14, N, N)), ("AD 9", (9, N, N), (9, N, N)), ("AD 66–70", (66, N, N), (70, N, N)), ("2 September 31 BCE", (-31, 9, 2), (-31, 9, 2)), ("August 216 B.C.", (-216, 8, N), (-216, 8, N)),
    ("2 December 1805 (O.S. 20 November)", (1805, 12, 2), (1805, 12, 2)), ("2 December 1805[3]", (1805, 12, 2), (1805, 12, 2)), ("Summer of 1805", (1805, N, N), (1805, N, N)),
    ("unknown", (N, N, N), (N, N, N)), ("", (N, N, N), (N, N, N)), (None, (N, N, N), (N, N, N)), ("– 1805", (1805, N, N), (1805, N, N)), ("12 March", (N, 3, 12), (N, 3, 12)),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(CASES)], "n int, raw string")
    return {r.n: (tuple(r.s)[:3], tuple(r.s)[3:]) for r in with_date_span(df, "raw", "s").collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_form(found, n):
    assert found[n] == CASES[n][1:], CASES[n][0]
