import os

import pytest

from corpusmill.plans import catalogue
from tests.compare import FOLDER, both

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, want = both(spark, catalogue.queries()[name], SQL[name])
    assert got == want


#: Without rows in the test tables, whose tokens have no relative clauses; compared on a sentence in test_structures.
EMPTY = {"relative_resolutions"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_gives_rows(spark, name):
    df = catalogue.queries()[name](spark, FOLDER)
    rows = df.limit(1000).collect()
    assert df.columns and (len(rows) > 0) is (name not in EMPTY)
    assert name in EMPTY or any(v is not None for r in rows for v in r)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
