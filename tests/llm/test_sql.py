"""The queries against their SQL over whole small tables."""

import duckdb
import pytest

from mapforge.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    told = con.sql(Q.oracle_sql()[name])
    found = Q.queries()[name](spark, SF)
    columns = sorted(found.columns)
    assert columns == sorted(told.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect())))
    assert mine == sorted(map(repr, told.select(*columns).fetchall()))
