import random
from collections import Counter

import pytest

from tessera.operators import graph, history

E = "source_id string, target_id string, edge_type string, confidence double, analyzer string"
S = "id string, qualified_name string, kind string, path string, start_line int, signature string, end_line int"


def make(spark, seed, n=25, m=70):
    rng = random.Random(seed)
    kinds = ["CALLS", "DEPENDS_ON", "CONTAINS"]
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(kinds), 0.9, "x") for _ in range(m)]
    symbols = [(f"n{i}", rng.choice(["loadUser", "saveUser", "run"]) + str(i), rng.choice(["function", "endpoint"]), "a.ts", i, None, i) for i in range(n)]
    return edges, symbols, spark.createDataFrame(edges, E), spark.createDataFrame(symbols, S)


def plain_rank(symbols, edges, query, seeds):
    words = {w.lower() for w in query.split()}
    rel = {}
    for s in symbols:
        own = set(s[1].replace("U", " U").lower().split())
        rel[s[0]] = 20 * (s[0] in seeds) + 10 * (s[1].lower() == query.lower()) + len(words & own)
    w = {s[0]: 1 + 10 * rel[s[0]] + 2 * (s[2] == "endpoint") for s in symbols}
    total = sum(w.values())
    pref = {k: v / total for k, v in w.items()}
    out = {k: set() for k in pref}
    for a, b, t, *_ in edges:
        if t != "CONTAINS" and a in out and b in out:
            out[a].add(b)
    r = dict(pref)
    for _ in range(20):
        lost = sum(r[k] for k in r if not out[k])
        new = {k: 0.15 * pref[k] + 0.85 * lost * pref[k] for k in r}
        for a in r:
            for b in out[a]:
                new[b] += 0.85 * r[a] / len(out[a])
        r = new
    return rel, r


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_is_power_iteration(spark, seed):
    edges, symbols, ed, sd = make(spark, seed)
    rel, want = plain_rank(symbols, edges, "load user5", {"n3"})
    got = {r["id"]: (r["relevance"], r["rank"]) for r in graph.personalized_rank(sd, ed, "load user5", ["n3"]).collect()}
    for k, v in want.items():
        assert got[k][1] == pytest.approx(v, abs=1e-12)
        assert got[k][0] == rel[k]
    assert sum(v for _, v in got.values()) == pytest.approx(1)


@pytest.mark.parametrize("seed", [3, 4])
def test_callers_are_breadth_first(spark, seed):
    edges, _, ed, _ = make(spark, seed, m=40)
    seen, front, want = {"n0"}, {"n0"}, {}
    for d in range(1, 6):
        front = {a for a, b, t, *_ in edges if t == "CALLS" and b in front} - seen
        seen |= front
        want |= {x: d for x in front}
    got = {r["id"]: r["depth"] for r in graph.callers_by_depth(ed, spark.createDataFrame([("n0",)], "id string"), 5).collect()}
    assert got == want
    with pytest.raises(ValueError):
        graph.callers_by_depth(ed, ed.select("source_id"), 6)


def test_neighbourhood_expand_induced_boundary(spark):
    e = spark.createDataFrame([("a", "b", "CALLS", 0.5, "x"), ("a", "c", "IMPORTS", 0.9, "x"), ("d", "a", "CALLS", 0.9, "x"), ("a", "e", "CONTAINS", 1.0, "x")], E)
    s = spark.createDataFrame([("b", "B", "f", "p", 1, None, 1)], S)
    n = graph.neighbourhood(e, s, "a", 2).orderBy("direction", "rank").collect()
    assert [(r["direction"], r["label"], r["total"]) for r in n] == [("in", "d", 1), ("out", "B", 3), ("out", "e", 3)]
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r["id"] for r in graph.expand(e, seeds).collect()} == {"a", "b", "c", "d"}
    assert {r["id"] for r in graph.expand(e, seeds, True).collect()} == {"a", "b", "c"}
    scope = spark.createDataFrame([("a",), ("b",), ("e",)], "id string")
    assert [(r["source_id"], r["target_id"]) for r in graph.induced(e, scope).collect()] == [("a", "b")]
    own = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted((r["target_id"], r["place"]) for r in graph.boundary(e, own).collect()) == [("a", "incoming"), ("b", "internal"), ("c", "outgoing"), ("e", "outgoing")]
    got = {r["id"]: r["label"] for r in graph.label(spark.createDataFrame([("b",), ("f",), ("z",)], "id string"), s, spark.createDataFrame([("f", "x.ts")], "id string, path string")).collect()}
    assert got == {"b": "B", "f": "x.ts", "z": "z"}


def test_history_goes_by_position(spark):
    log = spark.createDataFrame([("p", "new", "2020", 0), ("p", "old", "2024", 5), ("q", "x", "1", 2)], "path string, author string, at string, position int")
    got = {r["path"]: tuple(r)[1:] for r in history.file_history(log).collect()}
    assert got["p"] == (2, "new", "2020", "2024")


def test_co_change_bounds(spark):
    rows = [(c, p) for c in "xyz" for p in ("a", "b")] + [("x", "a"), ("w", "a")] + [("big", f"f{i}") for i in range(31)] + [("big", "a"), ("big", "b")]
    got = history.co_change(spark.createDataFrame(rows, "commit string, path string"), least=2).collect()
    assert [tuple(r) for r in got] == [("a", "b", 3)]


def test_keep_and_fingerprint(spark):
    d = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, o int, v string")
    assert history.keep_first(d, ["key"], "o").first()["v"] == "a" and history.keep_first(d, ["key"], "o", last=True).first()["v"] == "b"
    from pyspark.sql import functions as F

    f1 = history.fingerprint(d, "key", {"x": F.col("v")}).first()[1]
    f2 = history.fingerprint(d.orderBy(F.desc("o")), "key", {"x": F.col("v")}).first()[1]
    assert f1 == f2 and len(f1) == 64


def test_savings(spark):
    c = spark.createDataFrame([(1859, 717, 434, 6, 6), (1287, 1302, 553, 10, 10)], "baseline long, context long, map_only long, complete long, requested long")
    r = history.savings(c).first()
    assert (r["saved"], float(r["percent"])) == (1127, 35.8)


def test_co_change_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(history, "_RUN", 20, raising=False)
    rng = random.Random(6)
    rows = [(c, f"f{rng.randrange(9)}") for c in range(80) for _ in range(rng.randrange(1, 6))]
    got = history.co_change(spark.createDataFrame(rows, "commit long, path string"), least=2, limit=None)
    assert got.rdd.getNumPartitions() == -(-len(rows) // 20)
    sets = {c: {p for k, p in rows if k == c} for c in range(80)}
    want = Counter((a, b) for s in sets.values() for a in s for b in s if a < b)
    assert {(r["a"], r["b"]): r["commits"] for r in got.collect()} == {k: n for k, n in want.items() if n >= 2}


def test_links_stay_where_they_are_in_a_round(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    _, _, ed, sd = make(spark, 5)
    conf = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    graph.personalized_rank(sd, ed, "load user5", ["n3"], rounds=3).collect()
    assert [p.count("Exchange hashpartitioning") for p in plans[-3:]] == [1, 1, 1]
    assert conf == {k: spark.conf.get(k) for k in conf}
