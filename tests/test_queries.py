"""Every named query of the library against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from rubrica import queries as library

from .conftest import SMALL, rows_of

NAMES = sorted(library.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ours = library.queries()[name](spark, SMALL).toPandas()
    sql = library.oracle_sql().get(name)
    if sql is None:
        assert len(ours) > 0
        return
    theirs = duck.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id"] and out.count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
