import math
import os

import pytest

from docmill.plans import reference_queries, store_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def normal(rows):
    return sorted((tuple(f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=str)


SQL = reference_queries.oracle_sql() | store_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = (reference_queries.queries() | store_queries.queries())[name](spark, SF)
    rows = duck.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(got.columns) == sorted(names)
    assert normal(got.select(*names).collect()) == normal(rows.fetchall())


def test_json(spark):
    row = reference_queries.queries()["doc_to_json"](spark, SF).orderBy("doc_id").first()
    assert '"Fields" : {' in row["json"] and '"lang"' in row["json"]
