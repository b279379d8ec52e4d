import pytest
from compare import duck, kinds, rows_of

from factspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con, sql = duck(SF), queries.oracle_sql()[name]
    df = queries.queries()[name](spark, SF)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    assert len(want) and rows_of(df.columns, df.collect()) == rows_of(columns, want)
    assert kinds(df.dtypes) == {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
