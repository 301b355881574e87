"""The queries that have SQL, over whole small tables, against it."""

import pytest
from oracle import compare, connect

from tidemark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    compare(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_of_queries_without_sql(spark, sf, name):
    """One row for each document; what they hold is tested against plain versions elsewhere."""
    rows = QUERIES[name](spark, sf)
    assert rows.select("doc_id").distinct().count() == rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
