"""Every query against its SQL on the smallest tables; the others run and give rows."""

import os

import pytest
from compare import assert_same, connection

from seqspark.plans import files, reads, signals, sites, streams, training  # noqa: F401
from seqspark.plans.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
