import duckdb
import pytest

import __spark_entry__
from graphloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame, columns):
    whole = lambda v: "~" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(whole(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL if not n.startswith("louvain")])
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)
