"""Every query with an oracle gives the oracle's rows."""

import pytest

from spindrift.plans.catalogue import oracle_sql, queries
from tests.conftest import SF
from tests.parity import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, con, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
