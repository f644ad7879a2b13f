import pytest

import __spark_entry__ as entry
from fraglight.plans import queries as core
from fraglight.plans import records

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")


@pytest.mark.parametrize("name", sorted(core.SQL | records.SQL))
def test_equals_sql(compare, name):
    ours, theirs = compare((core.QUERIES | records.QUERIES)[name], (core.SQL | records.SQL)[name])
    assert ours == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
