"""Every query against its SQL twin on the driver's smallest tables."""

import os

import pytest

from checks.compare import connect, difference
from checks.oracles import ORACLES, full_sql
from checks.queries import QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def sql():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"r2_fit_bt"}


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows_as_sql(spark, sql, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, sql.execute(full_sql(name)).df()) is None
