import os

import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def near(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    r = con.execute(catalogue.SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(got.columns)
    assert near(tuple(x[c] for c in cols) for x in got.collect()) == near(r.fetchall())


def test_entry_works_without_the_corpus_operators(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) >= 40 and not any(x.startswith('op') for x in q)"
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
