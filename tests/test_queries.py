"""Every annotation query with SQL equals it on the smallest tables; the others give rows."""

import pytest

from annolake.plans import registry
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, con, name):
    check(spark, con, SF, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
