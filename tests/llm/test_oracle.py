"""Queries that SQL can express give the SQL's rows."""

import pytest

from spindrift.llm.queries import oracle_sql, queries
from tests.conftest import SF
from tests.parity import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, con, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) == ""
