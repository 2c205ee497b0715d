import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import search

SYMBOLS = [
    ("m", "s1", "PaymentService.process", "method", "(order)", "src/pay/service.ts"),
    ("c", "s1", "PaymentService", "class", None, "src/pay/service.ts"),
    ("o", "s1", "load_user profile", "function", "(user id)", "src/user/load.ts"),
    ("p", "s2", "PaymentService.process", "method", "(order)", "src/pay/service.ts"),
    ("q", "s2", "user profile load", "function", "process", "src/x.ts"),
]
SCHEMA = "id string, snapshot_id string, qualified_name string, kind string, signature string, path string"


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, SCHEMA)


@pytest.mark.parametrize("query", ["payment process", "proc", "user", "user.profile", "load_user", "src pay", "nothing", "user profile load"])
def test_bm25_is_that_of_fts5(symbols, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, qualified_name, path, signature)")
    db.executemany("INSERT INTO f VALUES (?,?,?,?)", [(r[0], r[2], r[5], r[4]) for r in SYMBOLS])
    match = " ".join('"' + t.replace('"', '""') + '"*' for t in query.split())
    want = dict(db.execute("SELECT id, bm25(f, 0, 5, 2, 1) FROM f WHERE f MATCH ?", (match,)).fetchall())
    got = {r["id"]: r["score"] for r in search.search_symbols(symbols, query).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


def test_snapshot_filters_rows_not_statistics(symbols):
    every = {r["id"]: r["score"] for r in search.search_symbols(symbols, "process").collect()}
    one = {r["id"]: r["score"] for r in search.search_symbols(symbols, "process", "s1").collect()}
    assert set(one) == {"m"} and one["m"] == every["m"]
    assert search.search_symbols(symbols, "  ").count() == 0


def letters(t):
    return [float(t.lower().count(chr(97 + i))) for i in range(26)]


def test_hybrid_degrades_and_reranks(spark, symbols):
    edges = spark.createDataFrame([("c", "m", "CALLS")], "source_id string, target_id string, edge_type string")
    only = search.hybrid_search(symbols, edges, "payment process", snapshot_id="s1").collect()
    assert only[0]["id"] == "m" and only[0]["sources"] == ["fts", "graph"]
    points = spark.createDataFrame([(r[0], r[1], letters(r[2])) for r in SYMBOLS], "id string, snapshot_id string, vector array<double>")
    full = search.hybrid_search(symbols, edges, "payment process", points, letters("payment process"), search.keyword_reranker, "s1").collect()
    assert full[0]["id"] == "m" and {"fts", "rerank", "vector"} <= set(full[0]["sources"]) and full[0]["score"] == 1.0
    assert {r["id"] for r in full} == {"m", "c", "o"}


def test_fusion_arithmetic(spark):
    lists = spark.createDataFrame([("a", "fts", 1), ("a", "graph", 2), ("b", "vector", 1)], "id string, source string, rank int")
    got = {r["id"]: (r["score"], r["sources"]) for r in search.fuse(lists).collect()}
    assert got["a"] == (pytest.approx(1 / 61 + 0.5 / 62), ["fts", "graph"]) and got["b"][0] == pytest.approx(1 / 61)


def test_embedding_reuse(spark):
    calls = []

    def embed(df):
        calls.append(df.count())
        return df.withColumn("vector", F.array(F.length("text").cast("double")))

    def snap(names, sid):
        return spark.createDataFrame([(f"sym_{n:>032}", sid, n, "function", None, "a.ts") for n in names], SCHEMA)

    cache = spark.createDataFrame([], "point_id string, text_hash string, model string, vector array<double>")
    total = []
    for names, sid, model in ((["a", "b", "c"], "1", "m"), (["a", "b", "d"], "2", "m"), (["a", "b"], "3", "m"), (["a", "b"], "3", "n")):
        points, new = search.index_symbols(snap(names, sid), cache, model, embed)
        assert {r["snapshot_id"] for r in points.collect()} == {sid} and points.count() == len(names)
        cache = spark.createDataFrame(cache.unionByName(new.select(*cache.columns)).collect(), cache.schema)
        total.append(cache.count())
    assert total == [3, 4, 4, 6] and calls == [3, 1, 0, 2]


def test_federated(spark):
    hits = spark.createDataFrame([("r", "a", 1.0), ("s", "b", 2.0), ("s", "c", 0.5)], "repo string, id string, score double")
    got = search.federated(hits, 2).collect()
    assert [(r["id"], r["shown"], r["total"]) for r in got] == [("b", 2, 3), ("a", 2, 3)]
