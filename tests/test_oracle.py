"""Every query of the library against its SQL, and those without SQL for rows."""

from __future__ import annotations

import pytest
from compare import connection, differences

from panemill import queries as library


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, sf, name):
    df = library.QUERIES[name](spark, sf)
    if sql := library.ORACLE.get(name):
        assert differences(df, connection(sf), sql) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).where("error > 1e-6").count() == 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
