import pytest
from differential import connect, same

import __spark_entry__
from tallyloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf_dir, con, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"text_similarity"}))
def test_rows_only(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 5 and all(0 < r["score"] < 1 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
