import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_names_and_sql():
    import __spark_entry__ as e

    from tessera.llm import queries

    q = e.queries()
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in queries.QUERIES} and "pipeline" in q
    assert set(queries.SQL) <= set(queries.QUERIES) and set(e.oracle_sql()) <= set(q)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_exact_topk", "op5_substring_dedup", "op6_sharding", "op7_decontaminate", "op8_near_duplicates", "op10_url_filter"])
def test_query_is_its_sql(spark, name):
    import duckdb

    from tessera.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    r = con.execute(queries.SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted((tuple(x[c] for c in cols) for x in got.collect()), key=str) == sorted(r.fetchall(), key=str)
