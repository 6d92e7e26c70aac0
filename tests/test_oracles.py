"""Every registered query against its SQL; those without SQL must run and give rows."""

import pytest

from lodestar.plans import catalog
from lodestar.plans.oracle import connection, difference

NO_ROWS = {"io_optional", "text_fuzzy_aliases"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    sql = catalog.oracles().get(name)
    if sql:
        assert difference(df, con, sql) == ""
    else:
        rows = df.collect()
        assert rows or name in NO_ROWS
