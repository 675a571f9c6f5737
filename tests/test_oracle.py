"""Every registered query against its SQL counterpart on the smallest tables; rows only where there is none."""

import pytest

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
# topic models are compared by shape elsewhere
SLOW = {"F14_lda_topics"}


@pytest.fixture(scope="module")
def sql():
    from compare import connect

    return connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", [n for n in queries() if n not in SLOW])
def test_query(spark, sql, name):
    from compare import compare

    status, _rows, _took, note = compare(spark, sql, FOLDER, name, oracle_sql().get(name))
    assert status in ("ok", "rows-only"), note
