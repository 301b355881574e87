"""Every query against its SQL, over whole tables; those without SQL have to give rows of a stable schema."""

import pytest
from oracle import connect, compare

from tidemark.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        compare(df, con, ORACLE_SQL[name])
    else:
        assert df.count() > 0 and df.schema == QUERIES[name](spark, sf).schema
