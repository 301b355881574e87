"""Keys of a folder that is named twice at one place of an order."""

import duckdb
from oracle import rows_of

from tidemark.plans import catalog


def test_the_first_row_of_a_place_counts(spark, tmp_path):
    path = f"{tmp_path}/lineitem.parquet"
    rows = [(o, p, s, 3) for p in range(40) for o, s in ((5, p + 7), (5, p + 1), (5, p + 9), (6, p))]
    values = ", ".join(map(str, rows))
    duckdb.sql(f"COPY (SELECT a::BIGINT AS l_orderkey, b::BIGINT AS l_partkey, c::BIGINT AS l_suppkey, d::INTEGER AS l_linenumber FROM (VALUES {values}) AS v(a, b, c, d)) TO '{path}' (FORMAT parquet)")
    found = catalog.QUERIES["drive_folder_keys"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    cur = con.execute(catalog.ORACLE_SQL["drive_folder_keys"])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == want
    assert {r.resource_key for r in found.collect()} == {f"k{p + 7}" for p in range(40)}
