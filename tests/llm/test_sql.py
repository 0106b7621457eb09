import duckdb
import pytest
from manybody.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    got = QUERIES[name](spark, D)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, (got.sparkSession.createDataFrame(want.df(), got.select(names).schema)).collect()))
