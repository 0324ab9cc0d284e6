"""The registered training-data queries against their SQL on small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import assert_same, connection  # noqa: E402

from seqspark.llm import registry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        assert_same(df, connection(SF), registry.oracle_sql()[name])
    else:
        assert df.count() > 0
