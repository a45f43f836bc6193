"""Every query of the core against its SQL; those without SQL must run."""

import pytest

from tests.compare import differences
from wobble import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, sf, name):
    assert differences(core.queries()[name](spark, sf), sf, SQL[name]) == []


@pytest.mark.parametrize("name", [n for n in core.queries() if n not in SQL])
def test_runs(spark, sf, name):
    assert core.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert "rho_f" in core.flagship(spark, sf).columns
