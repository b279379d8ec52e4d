import pytest
from compare import duck, kinds, rows_of

import __spark_entry__
from factspark import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_is_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    found = con.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, want)
    types = {r[0]: r[1] for r in con.execute(f"describe {queries.SQL[name]}").fetchall()}
    assert kinds(df.dtypes) == types


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
